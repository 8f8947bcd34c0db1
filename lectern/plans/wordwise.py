"""Queries on words, practice, paths, markup and lexicon tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import building, markup, paths, practice, words
from lectern.operators import lexicon
from lectern.plans.catalog import query
from lectern.tables import table


@query(r"SELECT page_id, len(regexp_extract_all(html, '[\p{L}\p{M}\p{N}]+(?:[''’-][\p{L}\p{M}\p{N}]+)*')) AS n, true AS placed FROM pages")
def tokenise_placed(spark, d):
    found = table(spark, d, "pages").select("page_id", "html", words.placed(F.col("html")).alias("w"))
    right = F.forall("w", lambda x: F.substring(F.col("html"), x["start"] + 1, F.length(x["word"])) == x["word"])
    return found.select("page_id", F.size("w").cast("long").alias("n"), right.alias("placed"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_type), '[^\p{L}\p{N}]', '', 'g') AS plain FROM part")
def plain_words(spark, d):
    return table(spark, d, "part").select("p_partkey", words.plain(F.col("p_type")).alias("plain"))


@query("""WITH n AS (SELECT event_id, user_id % 40 AS n FROM events), a AS (SELECT *, least(n, greatest(1, ceil(n * 0.2::DOUBLE))) AS a FROM n), b AS (SELECT *, least(n, greatest(a + 1, ceil(n * 0.4::DOUBLE))) AS b FROM a),
          c AS (SELECT *, least(n, greatest(b + 1, ceil(n * 0.6::DOUBLE))) AS c FROM b), d AS (SELECT *, least(n, greatest(c + 1, ceil(n * 0.8::DOUBLE))) AS d FROM c)
          SELECT event_id, array_to_string(list_transform(list_sort(list_distinct([0, a, b, c, d, n])), lambda x: x::INT), ',') AS counts FROM d""")
def hide_start(spark, d):
    """How many words are hidden in each round."""
    counts = practice.hide_counts((F.col("user_id") % 40).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(counts.cast("array<string>"), ",").alias("counts"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY 1),
               r AS (SELECT conv_id, l AS o, l, len(l) - 1 AS i, 1 AS k FROM t
                     UNION ALL SELECT conv_id, o, [CASE WHEN p = i + 1 THEN l[j + 1] WHEN p = j + 1 THEN l[i + 1] ELSE l[p] END FOR p IN range(1, len(l) + 1)], i - 1, k + 1
                     FROM (SELECT *, (xor(t2, t2 >> 14)::HUGEINT * (i + 1) >> 32)::BIGINT AS j FROM (
                             SELECT *, xor(t1, ((t1 + (xor(t1, t1 >> 7)::HUGEINT * (t1 | 61) % 4294967296)) % 4294967296)::BIGINT) AS t2 FROM (
                               SELECT *, (xor(a, a >> 15)::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t1 FROM (SELECT *, (conv_id + k::BIGINT * 1831565813) % 4294967296 AS a FROM r WHERE i > 0)))))
          SELECT conv_id, array_to_string(CASE WHEN l = o AND len(l) > 1 THEN list_append(l[2:], l[1]) ELSE l END, ',') AS turns FROM r WHERE i <= 0""")
def shuffled_turns(spark, d):
    """Turns of each conversation in a seeded order that is never the given one, unless there is one alone."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.array_join(practice.scrambled(F.col("turns"), F.col("conv_id")), ",").alias("turns"))


@query("SELECT vec_id, 8 AS points, true AS same FROM embeddings")
def path_round_trip(spark, d):
    ring = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    found = table(spark, d, "embeddings").select("vec_id", ring.alias("r")).withColumn("back", paths.decoded(paths.encoded(F.col("r"), True)))
    close = F.forall(F.zip_with("r", "back", lambda p, q: (F.abs(p["x"] - q["x"]) < 0.0501) & (F.abs(p["y"] - q["y"]) < 0.0501)), lambda b: b)
    return found.select("vec_id", F.size("back").alias("points"), close.alias("same"))


@query()
def html_blocks(spark, d):
    found = table(spark, d, "pages").select("page_id", markup.blocks(F.col("html")).alias("b"))
    return found.select("page_id", F.size("b").alias("blocks"), F.size(F.filter("b", lambda x: x["kind"] == "h")).alias("headings"), F.size(markup.links(F.col("b"))).alias("links"), F.length(markup.block_text(F.col("b"))).alias("chars"))


@query(r"""SELECT event_id, user_id, event_type || '-' || CAST(n AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1
          UNION ALL SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def numbered_event_ids(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("base"))
    out = lexicon.numbered_ids(events, "base", "event_id")
    return out.select("event_id", "user_id", F.regexp_replace("id", "^[0-9]+/", "").alias("id"))


@query("""WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM conversations),
               r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
          SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM r GROUP BY 1, 2, 3""")
def consecutive_roles(spark, d):
    out = lexicon.consecutive(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", "turn")
    return out.select("conv_id", "run", "role", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("turns"))


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), p AS (SELECT p_type, unnest(string_split(p_type, ' ')) AS w, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM t)
          SELECT p_type, string_agg(CASE w WHEN 'STEEL' THEN 'iron with carbon' ELSE w END, '; ' ORDER BY i) AS text FROM p GROUP BY 1""")
def codes_described(spark, d):
    known = spark.createDataFrame([("STEEL", "iron with carbon")], "code string, text string")
    types = table(spark, d, "part").select("p_type").distinct()
    return lexicon.described(types, "p_type", F.split("p_type", " "), known)


@query("SELECT c_custkey, namesakes FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS namesakes FROM customer)")
def name_frequency(spark, d):
    return lexicon.shared_names(table(spark, d, "customer"), "c_mktsegment").select("c_custkey", "namesakes")


@query("""SELECT DISTINCT l_partkey AS k, l_suppkey AS t FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE l_linenumber = best""")
def strong_before_weak(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("t"), "l_linenumber")
    return lexicon.strong_or_weak(items, "k", "t", "l_linenumber")


@query(r"""WITH u AS (SELECT page_id, string_split(substr(url, strpos(url, '://') + 3), '/') AS t FROM pages),
                m AS (SELECT page_id, t, [CASE WHEN regexp_matches(x, '^[0-9]') THEN 'J' WHEN x = '' THEN '' ELSE 'T' || len(x) END FOR x IN t] AS g FROM u)
           SELECT page_id, CASE WHEN page_id % 7 > 0 THEN array_to_string([t[i] || ':' || g[i] || ':' || CASE WHEN page_id % 3 = 0 AND i = 1 THEN '' ELSE 'Hc' || len(t[i]) END || ':' || upper(t[i]) FOR i IN range(1, len(t) + 1) IF g[i] NOT IN ('', 'J')], '|') END AS parts,
                  CASE WHEN page_id % 5 > 0 THEN g[1] END AS root, CASE WHEN page_id % 7 = 0 THEN 'uneven' WHEN page_id % 5 = 0 THEN 'no root' END AS problem FROM m""")
def words_built(spark, d):
    """Parts of each address as those of a word: tags by length, digits as joiners, codes and glosses beside them."""
    k = F.col("page_id")
    pages = table(spark, d, "pages").withColumn("t", F.split(F.substring_index("url", "://", -1), "/"))
    joined = lambda f: F.array_join(F.transform("t", f), "/")
    tags = joined(lambda x, i: F.when(x.rlike("^[0-9]"), "J").when(x == "", "").otherwise(F.concat(F.when((i == 0) & (k % 5 > 0), "{T").otherwise("T"), F.length(x).cast("string"), F.when((i == 0) & (k % 5 > 0), "}").otherwise(""))))
    codes = F.concat(F.lit("H"), joined(lambda x, i: F.when((k % 3 == 0) & (i == 0), " ").otherwise(F.concat(F.lit("c"), F.length(x).cast("string")))), F.when(k % 7 == 0, "/more").otherwise(""))
    found = pages.select("page_id", building.parts(F.array_join("t", "/"), tags, codes, joined(lambda x: F.upper(x)), ["J"]).alias("w"))
    shown = F.transform("w.parts", lambda p: F.concat(p["text"], F.lit(":"), p["tag"], F.lit(":"), F.coalesce(p["code"], F.lit("")), F.lit(":"), F.coalesce(p["gloss"], F.lit(""))))
    return found.select("page_id", F.array_join(shown, "|").alias("parts"), "w.root", "w.problem")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(u, '//', ' '), '\=', ' ='), '/', ''), '\', ''), '\s+', ' ', 'g')) AS surface, replace(u, '\', '') AS bare, translate(p, 'áàâéèêíìîóòôúùû', 'aaaeeeiiiooouuu') AS sound
           FROM (SELECT page_id, replace(replace(url, '=', '\='), '?', '\?') AS u, left(html, 400) AS p FROM pages)""".replace("\\\\", "\\"))
def marks_held(spark, d):
    """Addresses as words with marks held to their parts: as printed, and without what holds them; pages' beginnings without accents."""
    u = F.replace(F.replace("url", F.lit("="), F.lit("\\=")), F.lit("?"), F.lit("\\?"))
    return table(spark, d, "pages").select("page_id", building.surface(u, "=").alias("surface"), building.without_marks(u, ";").alias("bare"), building.plain_sound(F.left("html", F.lit(400))).alias("sound"))
