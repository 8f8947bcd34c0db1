"""Queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, embeddings, exact, language, lexical, lm, mixing, packing, secret_scan, simhash, toxicity, trie, urls
from lectern.llm.common import remainder

# Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.numbered(_table(spark, sf_dir, "conversations"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_near_dedup, op2_lm_scoring, op3_toxicity, op4_url_filters, op5_language_id, op6_packing, op7_mixing, op8_exact_dedup, op9_secret_scan, op10_simhash, op11_prefix_trie, op12_byte_bpe, op13_lexical_search)
} | {"pipeline": corpus_pipeline.run}

# Kind, pattern for RE2 (letters of either case spelled out), group of the value, least length.
_SECRET_KINDS = [
    ("assign", "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
]


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _secret_sql() -> str:
    texts = "(SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"
    kinds = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS kind, {o} AS o, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g FROM d"
        for o, (kind, p, g, least) in enumerate(_SECRET_KINDS)
    )
    listed = "coalesce(string_agg(kind || ':' || a || ':' || (a + len(w)), ',' ORDER BY a, o){}, '')"
    return f"""
        WITH d AS MATERIALIZED {texts}, k AS ({kinds}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
             s AS (SELECT r, kind, o, m[i] AS w, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a
                   FROM i WHERE len(v[i]) >= least)
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256({listed.format(" FILTER (o < 3)")}) AS base_sha256, {listed.format("")} AS spans
        FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
             g AS (SELECT *, sha256(body) AS text_sha256,
                          first_value(doc_id) OVER (PARTITION BY body ORDER BY len DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY body) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op4_url_filters": r"""
        WITH r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
             s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
             m AS (SELECT p.page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
                   FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY 1)
        SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op9_secret_scan": _secret_sql(),
    "op11_prefix_trie": r"""
        WITH RECURSIVE bits AS (SELECT range AS b, 0 AS i, range AS v FROM range(256)
                                UNION ALL SELECT b, i + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE i < 8),
             crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
             t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
             z AS (SELECT DISTINCT c, c::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS v FROM t
                   UNION ALL SELECT c, s, i + 1, xor(v >> 8, crc.t[(xor(v, ord(s[i + 1])) & 255) + 1]) FROM z, crc WHERE i < len(s)),
             k AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM z WHERE i = len(s)),
             r AS (SELECT k.c, 0 AS part, p, role, text FROM k JOIN t ON t.c = k.c - k.c % 5 WHERE p <= h
                   UNION ALL SELECT k.c, 1, p, role, text FROM k JOIN t ON t.c = k.c WHERE p > h),
             s AS (SELECT c, strlen(text) AS b, sha256(strlen(role) || ':' || role || text) AS id, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM r),
             w AS (SELECT c, d, b, string_agg(id, '') OVER (PARTITION BY c ORDER BY d) AS path FROM s UNION ALL SELECT c, 0, 0, '' FROM k),
             m AS (SELECT path, any_value(d) AS d, any_value(b) AS b, min(c) AS low, count(*) AS n, left(path, greatest(len(path) - 64, 0)) AS up FROM w GROUP BY path),
             f AS (SELECT up AS path, count(*) AS fan FROM m WHERE d > 0 GROUP BY up),
             a AS (SELECT m.*, coalesce(fan, 0) AS fan FROM m LEFT JOIN f USING (path)),
             u AS (SELECT left(path, 64 * x) AS path, sum((n - 1) * b)::BIGINT AS kept, count(*) FILTER (fan = 0) AS leaves
                   FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM a) GROUP BY 1),
             l AS (SELECT c, arg_max(path, d) AS path FROM w GROUP BY c),
             e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM l GROUP BY path)
        SELECT a.low AS conv_id, a.d AS depth, q.low AS parent_conv_id, a.n AS n_convs, a.fan AS n_children, leaves AS n_leaves, kept AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM a JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN a q ON a.d > 0 AND q.path = a.up""",
    "op13_lexical_search": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
             q AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
             s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
             f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
             g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, docs),
             b AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
             m AS (SELECT r, doc_id, 25 + (75 * len(w) * docs) // terms AS m FROM d, s),
             h AS (SELECT i, item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
                   FROM b JOIN g USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
             o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank FROM h WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op1_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                             WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
             r AS (SELECT vec_id, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.vec_id),
             n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(low) AS component_id, vec_id = min(low) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
}
