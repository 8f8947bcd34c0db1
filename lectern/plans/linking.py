"""Queries on references in running text, agreement of sources and rules with conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import agreeing, linking
from lectern.plans.catalog import query
from lectern.tables import table

_BOOKS = {"alpha": "A", "beta": "B", "gamma": "C"}
_CHAPTERS = [(b, c, 10 * (i + 1) + 5 * c) for i, b in enumerate("ABC") for c in range(1, 6)]
_TEXT_SQL = "CASE l_partkey % 8 WHEN 0 THEN 'Alpha ' || c || ':' || n WHEN 1 THEN 'beta ' || c || ':' || n WHEN 3 THEN n || '' WHEN 4 THEN 'Delta ' || c || ':' || n WHEN 5 THEN 'Gamma' WHEN 6 THEN 'as said there' ELSE c || ':' || n END"
_LINKED = f"""
    WITH s(book, chapter, verses) AS (VALUES {", ".join(map(str, _CHAPTERS))}),
         l AS (SELECT l_suppkey AS e, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 100 + l_quantity::INT AS place, l_partkey % 8 AS k, l_linenumber AS c, l_quantity::INT AS n,
                      CASE WHEN l_partkey % 5 > 0 THEN substr('ABC', l_orderkey % 3 + 1, 1) END AS tb, l_linenumber AS tc, l_quantity::INT + l_orderkey % 2 AS tv FROM lineitem),
         r AS (SELECT *, k IN (0, 1, 4, 5) AS named, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 5 THEN 'C' END AS rb, CASE WHEN k IN (0, 1, 2, 4, 7) THEN c END AS rc, CASE WHEN k IN (0, 1, 2, 3, 4, 7) THEN n END AS rv FROM l),
         x AS (SELECT *, last_value(CASE WHEN named THEN coalesce(rb, '-') END IGNORE NULLS) OVER w AS xb,
                      last_value(CASE WHEN named THEN coalesce(rc, 1) ELSE rc END IGNORE NULLS) OVER w AS xc
               FROM r WINDOW w AS (PARTITION BY e ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         y AS (SELECT *, nullif(xb, '-') AS cb, CASE WHEN xb <> '-' THEN xc END AS cc FROM x),
         o AS (SELECT *, CASE WHEN named THEN rb ELSE cb END AS ob, coalesce(rc, CASE WHEN NOT named THEN cc END) AS oc FROM y),
         f AS (SELECT o.*, coalesce(tv BETWEEN 1 AND a.verses, false) AS tf, rv IS NOT NULL AND coalesce(rv BETWEEN 1 AND b.verses, false) AS rf
               FROM o LEFT JOIN s a ON a.book = tb AND a.chapter = tc LEFT JOIN s b ON b.book = ob AND b.chapter = oc),
         g AS (SELECT *, CASE WHEN rv IS NULL THEN CASE WHEN rb IS NOT NULL THEN 'book' ELSE 'dropped' END WHEN tf AND rf THEN CASE WHEN tb = ob AND tc = oc AND tv = rv THEN 'ok' ELSE 'fixed' END
                              WHEN rf THEN 'fixed' WHEN tf AND CASE WHEN named THEN rb ELSE coalesce(cb, tb) END = tb THEN 'unchecked' ELSE 'dropped' END AS status FROM f)"""


def _references(spark, d):
    """References tagged in the lines of suppliers, the text of each by its part."""
    c, n, k = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey") % 8
    both = F.concat(c, F.lit(":"), n)
    text = F.when(k == 0, F.concat(F.lit("Alpha "), both)).when(k == 1, F.concat(F.lit("beta "), both)).when(k == 3, n).when(k == 4, F.concat(F.lit("Delta "), both)).when(k == 5, "Gamma").when(k == 6, "as said there").otherwise(both)
    tag = F.struct(F.substring(F.lit("ABC"), (F.col("l_orderkey") % 3 + 1).cast("int"), F.lit(1)).alias("book"), F.col("l_linenumber").cast("int").alias("chapter"), (F.col("l_quantity").cast("int") + F.col("l_orderkey") % 2).cast("int").alias("verse"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("place"), text.alias("text"), F.when(F.col("l_partkey") % 5 > 0, tag).alias("tag"))
    chapters = spark.createDataFrame(_CHAPTERS, "book string, chapter int, verses int")
    return linking.linked(rows, "entry", "place", "text", "tag", _BOOKS, chapters, F.expr("place div 1000000000000"))


@query(f"{_LINKED} SELECT status, count(*) AS n FROM g GROUP BY 1")
def links_by_status(spark, d):
    return _references(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_LINKED} SELECT e AS entry, place, status, CASE status WHEN 'fixed' THEN ob || '.' || oc || '.' || rv WHEN 'ok' THEN tb || '.' || tc || '.' || tv WHEN 'unchecked' THEN tb || '.' || tc || '.' || tv END AS ref FROM g")
def links_arbitrated(spark, d):
    """What each reference means, by its tag, its text and the context before it."""
    found = _references(spark, d)
    return found.select("entry", "place", "status", F.when(F.col("ref").isNotNull(), F.concat_ws(".", "ref.book", "ref.chapter", "ref.verse")).alias("ref"))


@query("""WITH k AS (SELECT unnest(range(1, (SELECT max(c_custkey) FROM customer) + 3)) AS k), a AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer),
               c AS (SELECT l_partkey AS k, count(*) AS v FROM lineitem GROUP BY 1),
               m AS (SELECT coalesce(k.k, a.k, b.k, c.k) AS k, k.k IS NOT NULL AS expected, a.v AS a, b.v AS b, c.v AS c FROM k FULL JOIN a ON a.k = k.k FULL JOIN b ON b.k = coalesce(k.k, a.k) FULL JOIN c ON c.k = coalesce(k.k, a.k, b.k))
          SELECT count(*) AS keys, count(*) FILTER (expected) AS expected, count(*) FILTER (NOT expected) AS unexpected, count(*) FILTER (expected AND a IS NULL AND b IS NULL AND c IS NULL) AS without, count(a) AS in_a, count(b) AS in_b, count(c) AS in_c,
                 count(*) FILTER (a = b) AS agree_a_b, count(*) FILTER (a <> b) AS differ_a_b, count(*) FILTER (a = c) AS agree_a_c, count(*) FILTER (a <> c) AS differ_a_c, count(*) FILTER (b = c) AS agree_b_c, count(*) FILTER (b <> c) AS differ_b_c FROM m""")
def sources_agree(spark, d):
    """Three sources of numbers on one spine of keys: what each holds, what none has, and where two agree."""
    last = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    spine = spark.range(1, last + 3).select(F.col("id").alias("k"))
    sources = {
        "a": table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v")),
        "b": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v")),
        "c": table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("v")),
    }
    return agreeing.accounted(agreeing.on_spine(spine, "k", sources, "v"), list(sources))


_RULES = [(1, "move", 1, 1, "lines", 3, None), (1, "move", 1, 1, "day", None, 20), (2, "swap", 2, 2, "lines", 2, 5), (3, "swap", 3, -1, "lines", 1, None), (4, "near", 1, 5, "lines", None, 6), (5, "skip", 4, 0, "day", 10, 10)]


@query(f"""WITH r(rule, kind, grp, shift, measure, least, most) AS (VALUES {", ".join("(" + ", ".join("NULL::INT" if v is None else repr(v) for v in row) + ")" for row in _RULES)}),
               f AS (SELECT o_orderkey AS k, o_orderkey % 5 AS grp, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, day(o_orderdate) AS day FROM orders),
               t AS (SELECT k, rule, kind, shift, bool_and(coalesce(CASE measure WHEN 'lines' THEN lines ELSE day END BETWEEN coalesce(least, -1) AND coalesce(most, 1000), false)) AS holds FROM f JOIN r USING (grp) GROUP BY ALL),
               b AS (SELECT k, min_by(shift, rule) AS shift, min(rule) AS rule FROM t WHERE holds GROUP BY k)
          SELECT f.k AS o_orderkey, f.k + coalesce(b.shift, 0) AS target, rule FROM f LEFT JOIN b USING (k)""")
def rules_conditioned(spark, d):
    """Orders moved by the first rule of their group whose conditions all hold, on their lines and their day; others stay."""
    rules = spark.createDataFrame(_RULES, "rule int, kind string, grp long, shift int, measure string, least int, most int")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("grp"), F.dayofmonth("o_orderdate").cast("long").alias("day"))
    facts = orders.join(lines, "k", "left").select("k", "grp", F.stack(F.lit(2), F.lit("lines"), F.coalesce("lines", F.lit(0).cast("long")), F.lit("day"), F.col("day")).alias("measure", "value"))
    conditions = rules.select("rule", "grp", "measure", "least", "most")
    chosen = agreeing.rules_holding(facts, "k", "grp", conditions).join(rules.select("rule", "shift").distinct(), "rule")
    return orders.join(chosen.select("k", "rule", "shift"), "k", "left").select(F.col("k").alias("o_orderkey"), (F.col("k") + F.coalesce("shift", F.lit(0))).alias("target"), "rule")
