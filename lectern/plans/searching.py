"""Search, ranking, concordance and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import aggregates, fuzzy
from lectern.plans.catalog import query
from lectern.tables import table

WORD = r"(^|[^\p{L}\p{N}])%s($|[^\p{L}\p{N}])"


def _re(*words: str) -> str:
    return " AND ".join("regexp_matches(text, '(?i)" + WORD % w + "')" for w in words)


@query(f"SELECT doc_id FROM documents WHERE {_re('the', 'idiot')}")
def search_words_and(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(tx.words_query(F.col("text"), "the idiot")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])path')")
def search_prefix(spark, d):
    return table(spark, d, "documents").where(tx.words_query(F.col("text"), "path*")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])of[\s\p{P}]+the($|[^\p{L}\p{N}])')")
def search_phrase(spark, d):
    return table(spark, d, "documents").where(tx.phrase_query(F.col("text"), '"of the"')).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def search_blank(spark, d):
    """A query without a word finds nothing, never everything."""
    docs, found = table(spark, d, "documents"), tx.words_query(F.col("text"), " .. ")
    return docs.where(F.lit(False) if found is None else found).select("doc_id")


@query(f"SELECT lang, count(*) AS n FROM documents WHERE {_re('the', 'and')} GROUP BY lang")
def search_facet_counts(spark, d):
    docs = table(spark, d, "documents")
    return aggregates.counted(docs.where(tx.words_query(F.col("text"), "the and")), "lang")


@query(f"SELECT coalesce(lang, 'all') AS lang, count(*) AS n FROM documents WHERE {_re('de')} GROUP BY ROLLUP(lang)")
def search_facet_total(spark, d):
    docs = table(spark, d, "documents").where(tx.words_query(F.col("text"), "de"))
    return docs.rollup("lang").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "n")


@query(f"SELECT doc_id, source FROM documents WHERE {_re('the')} ORDER BY doc_id LIMIT 50 OFFSET 50")
def search_page2(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(tx.words_query(F.col("text"), "the")).select("doc_id", "source").orderBy("doc_id").offset(50).limit(50)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)idiot|moron')) AS hits, true AS whole
           FROM documents WHERE regexp_matches(text, '(?i)idiot|moron')""")
def search_highlight(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?i)idiot|moron"))
    runs = docs.select("doc_id", "text", tx.highlight(F.col("text"), "(?i)idiot|moron").alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["t"]), "")
    return runs.select("doc_id", F.size(F.filter("r", lambda x: x["hit"])).cast("long").alias("hits"), (joined == F.col("text")).alias("whole"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(trim(p_brand), '^[GHgh][0-9]{1,4}[A-Za-z]?$') THEN 'id'
           WHEN regexp_matches(trim(p_brand), '^["“].+["”]$') THEN 'phrase' ELSE 'words' END AS mode FROM part""")
def mode_dispatch(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.query_mode(F.col("p_brand")).alias("mode"))


@query("SELECT p_partkey, 'H' || CAST(p_partkey % 10000 AS VARCHAR) AS id FROM part")
def lexicon_ids(spark, d):
    raw = F.concat(F.lit("h"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("G"))
    return table(spark, d, "part").select("p_partkey", tx.lexicon_id(raw).alias("id"))


TOKENS = r"SELECT doc_id, t AS token FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> ''"


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS places FROM ({TOKENS}) GROUP BY token")
def conc_token_counts(spark, d):
    return aggregates.concordance_of_rows(table(spark, d, "documents"), tx.tokens(F.col("text")))


@query("SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def conc_renderings(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.counted(items, "p_brand", "p_type")


@query("""SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rank
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE rank <= 8""")
def conc_top_rendering(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.leading(aggregates.counted(items, "p_brand", "p_type"), "p_brand", "p_type", 8).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT p_partkey, p_name, s AS score FROM (SELECT *, CASE WHEN lower(p_name) = 're' THEN 0 WHEN starts_with(lower(p_name), 're') THEN 1
          WHEN contains(lower(p_name), 're') THEN 2 END AS s FROM part) WHERE s IS NOT NULL AND (s < 2 OR length('re') >= 3) ORDER BY s * 100000 + p_partkey, p_partkey LIMIT 60""")
def lex_topk(spark, d):
    return _topk(table(spark, d, "part"), "re")


@query("""SELECT p_partkey, p_name, s AS score FROM (SELECT *, CASE WHEN lower(p_name) = 'part' THEN 0 WHEN starts_with(lower(p_name), 'part') THEN 1
          WHEN contains(lower(p_name), 'part') THEN 2 END AS s FROM part) WHERE s IS NOT NULL ORDER BY s * 100000 + p_partkey, p_partkey LIMIT 60""")
def lex_topk_contains(spark, d):
    return _topk(table(spark, d, "part"), "part")


def _topk(parts, needle):
    """Equal, then prefix, then (for three characters or more) contained; 60 rows by score and number."""
    name = F.lower("p_name")
    score = F.when(name == needle, 0).when(name.startswith(needle), 1)
    if len(needle) >= 3:
        score = score.when(name.contains(needle), 2)
    found = parts.select("p_partkey", "p_name", score.alias("score")).where("score is not null")
    return found.orderBy(F.col("score") * 100000 + F.col("p_partkey"), "p_partkey").limit(60)


@query(r"""SELECT p_partkey, r AS rank FROM (SELECT p_partkey, CASE WHEN lower(p_type) = 'small' THEN 0 WHEN starts_with(lower(p_type), 'small') THEN 1
          WHEN regexp_matches(lower(p_type), '[\s(-]small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 3 END AS r FROM part) WHERE r IS NOT NULL""")
def dict_ranked(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.rank_of(F.col("p_type"), "small").alias("rank")).where("rank is not null")


@query("""SELECT s_suppkey, s_name, coalesce(m, 0) AS mentions, CASE WHEN starts_with(lower(s_name), 'supp') THEN 0 ELSE 1 END AS part
          FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS m FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey WHERE contains(lower(s_name), 'supp')
          ORDER BY part, mentions DESC, s_name, s_suppkey LIMIT 50""")
def name_search(spark, d):
    mentions = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("m"))
    name = F.lower("s_name")
    found = table(spark, d, "supplier").where(name.contains("supp")).join(mentions, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    out = found.select("s_suppkey", "s_name", F.coalesce("m", F.lit(0)).alias("mentions"), F.when(name.startswith("supp"), 0).otherwise(1).alias("part"))
    return out.orderBy("part", F.desc("mentions"), "s_name", "s_suppkey").limit(50)


@query("SELECT DISTINCT upper(left(p_type, 1)) AS letter FROM part")
def letter_index(spark, d):
    return table(spark, d, "part").select(tx.index_letter(F.col("p_type")).alias("letter")).distinct()


@query("SELECT count(*) AS n FROM part WHERE upper(left(p_type, 1)) = 'S'")
def letter_facet(spark, d):
    return table(spark, d, "part").where(tx.index_letter(F.col("p_type")) == "S").agg(F.count("*").alias("n"))


@query(r"""SELECT source, count(*) AS n FROM (SELECT source, lower(source || ' ' || lang || ' ' || text) AS hay FROM documents)
          WHERE contains(hay, 'the') AND contains(hay, 'en') AND contains(hay, 'src1') GROUP BY source""")
def all_words_contained(spark, d):
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    words = F.array(*[F.lit(w) for w in ("the", "en", "src1")])
    return aggregates.counted(table(spark, d, "documents").where(F.forall(words, lambda w: F.contains(hay, w))), "source")


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query(r"""WITH c AS (SELECT doc_id, text, substr(text, 1, 160) AS cut FROM documents), b AS (SELECT *, regexp_extract(cut, '(?s)^(.*)\s', 1) AS head FROM c)
          SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(CASE WHEN length(head) > 96 THEN head ELSE cut END, '[\s\p{P}]+$', '') || '…' END AS preview FROM b""")
def truncate_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.headline(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS words, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def token_stats(spark, d):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, d, "documents").select("doc_id", count(r"[\p{L}\p{N}]+").alias("words"), count("[0-9]+").alias("numbers"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.without_tags(F.col("html")).alias("body"))


@query(r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def link_extract(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return aggregates.counted(links, "page_id", "link")


@query(r"""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
          WHERE levenshtein(a.p_name, b.p_name) <= 1""")
def edit_distance_pairs(spark, d):
    """Names one edit apart among parts of one type and brand."""
    return fuzzy.one_edit_pairs(table(spark, d, "part"), "p_partkey", "p_name", "p_type", "p_brand")


@query(f"SELECT trim(strip_accents(token)) AS fold, sum(n)::BIGINT AS n, count(*) AS spellings FROM (SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY 1) GROUP BY 1")
def fold_words(spark, d):
    """Distinct words without marks."""
    words = table(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").count()
    return words.groupBy(tx.folded(F.col("token")).alias("fold")).agg(F.sum("count").alias("n"), F.count("*").alias("spellings"))
