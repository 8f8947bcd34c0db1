"""Queries on aliases, spans, coded descriptions, locations and aligned segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import codes, geo
from lectern.operators import aggregates, ordered, resolving, spatial
from lectern.plans.catalog import query
from lectern.tables import table


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_size > 12 THEN p_partkey * 3 % 2100 + 1 END AS l FROM part),
               a AS (SELECT k, coalesce(l, k) AS t, CASE WHEN l IS NULL THEN 0 ELSE 1 END AS s FROM r),
               b AS (SELECT a.k, coalesce(r.l, a.t) AS t, s + CASE WHEN r.l IS NULL THEN 0 ELSE 1 END AS s FROM a LEFT JOIN r ON s > 0 AND r.k = a.t),
               c AS (SELECT b.k, coalesce(r.l, b.t) AS t, s + CASE WHEN r.l IS NULL THEN 0 ELSE 1 END AS s FROM b LEFT JOIN r ON s > 0 AND r.k = b.t),
               d AS (SELECT c.k, coalesce(r.l, c.t) AS t, s + CASE WHEN r.l IS NULL THEN 0 ELSE 1 END AS s FROM c LEFT JOIN r ON s > 0 AND r.k = c.t),
               e AS (SELECT d.k, coalesce(r.l, d.t) AS t, s + CASE WHEN r.l IS NULL THEN 0 ELSE 1 END AS s FROM d LEFT JOIN r ON s > 0 AND r.k = d.t)
          SELECT e.k AS p_partkey, t AS target, s AS steps, CASE WHEN r.k IS NULL THEN 'broken' WHEN r.l IS NOT NULL AND s > 0 THEN 'loop' ELSE 'ok' END AS status FROM e LEFT JOIN r ON r.k = e.t""")
def alias_chains(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 12, F.col("p_partkey") * 3 % 2100 + 1).alias("link"))
    return resolving.alias_targets(part, "p_partkey", "link")


@query("""SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1""")
def fallback_agreed(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return resolving.agreed_targets(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", known)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2),
               b AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM c GROUP BY 1),
               r AS (SELECT l_orderkey, lo, hi, l_orderkey % 4 AS kind FROM b)
          SELECT r.l_orderkey AS book, CAST(sum(n) - CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END
                 - CASE WHEN kind = 2 THEN max(CASE WHEN l_linenumber = hi THEN n END) - 1 WHEN kind = 3 THEN max(n) - 1 ELSE 0 END AS BIGINT) AS covered
          FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND l_linenumber BETWEEN lo AND CASE WHEN kind = 3 THEN lo ELSE hi END
          WHERE NOT (kind IN (1, 2) AND lo = hi) GROUP BY r.l_orderkey, kind""")
def verses_covered(spark, d):
    """Whole chapters, from verse 2 on, from verse 2 to verse 1 of the last chapter, and one verse."""
    chapters = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("chapter")).agg(F.max(F.col("l_quantity").cast("long")).alias("verses"))
    kind = F.col("book") % 4
    refs = chapters.groupBy("book").agg(F.min("chapter").alias("chapter"), F.max("chapter").alias("hi")).where(~kind.isin(1, 2) | (F.col("chapter") < F.col("hi")))
    refs = refs.select("book", "chapter", F.when(kind.isin(1, 2), 2).when(kind == 3, 1).alias("verse"), F.when(kind < 3, F.col("hi")).alias("end_chapter"), F.when(kind == 2, 1).alias("end_verse"))
    return resolving.covered_verses(refs, chapters).select("book", "covered")


@query("""WITH t AS (SELECT p_partkey, p_size, p_partkey + 100 AS a, (p_partkey + 100) // 100 * 100 + (p_partkey + 100 + p_size) % 100 AS b FROM part),
               u AS (SELECT p_partkey, a || '-' || lpad(CAST(b % 100 AS VARCHAR), 2, '0') AS item,
                            CASE WHEN b < a THEN [] WHEN b - a > 12 THEN [a, b] ELSE range(a, b + 1) END AS got, b < a OR b - a > 12 AS odd, p_size, p_size * 10 + 1 AS marked FROM t),
               v AS (SELECT *, list_concat(CASE WHEN odd THEN [item] ELSE [] END, list_transform(list_filter(got, lambda x: x > 8674), lambda x: CAST(x AS VARCHAR)), ['x' || p_size]) AS irregular,
                            list_concat(list_filter(got, lambda x: x <= 8674), [marked, p_size]) AS nums FROM u)
          SELECT p_partkey, array_to_string(list_sort(list_distinct(nums)), ' ') AS nums, array_to_string(irregular, ' ') AS irregular FROM v""")
def numbers_listed(spark, d):
    a = F.col("p_partkey") + 100
    text = F.concat(a.cast("string"), F.lit("-"), F.lpad(((a + F.col("p_size")) % 100).cast("string"), 2, "0"), F.lit(", "), F.col("p_size").cast("string"), F.lit("l + x"), F.col("p_size").cast("string"), F.lit(", etc."))
    found = table(spark, d, "part").select("p_partkey", codes.numbers_listed(text).alias("f"))
    return found.select("p_partkey", F.array_join(F.array_sort("f.nums").cast("array<string>"), " ").alias("nums"), F.array_join("f.irregular", " ").alias("irregular"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN CAST(l_quantity AS BIGINT) + 1 ELSE 2 END AS n,
                 CASE l_linenumber % 3 WHEN 0 THEN l_suppkey || ':' || l_linenumber WHEN 1 THEN l_suppkey || ':' || l_linenumber || '-' || (l_linenumber + CAST(l_quantity AS BIGINT))
                 ELSE l_suppkey || ':' || l_linenumber || '-' || (l_suppkey + 1) || ':' || 1 END AS span FROM lineitem""")
def spans_round_trip(spark, d):
    s, n, q = F.col("l_suppkey").cast("string"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    head = F.concat_ws(":", s, n.cast("string"))
    text = F.when(n % 3 == 0, head).when(n % 3 == 1, F.concat_ws("-", head, (n + q).cast("string"))).otherwise(F.concat(head, F.lit("-"), (F.col("l_suppkey") + 1).cast("string"), F.lit(":1")))
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.verses_named(text).alias("v"))
    return found.select("l_orderkey", "l_linenumber", F.size("v").cast("long").alias("n"), codes.verse_span(F.col("v")).alias("span"))


@query("""SELECT p_partkey, '“' || p_name || '” (“' || p_type || '”)—“' || p_brand || '” <i t="a--b">“x”</i>' AS text FROM part""")
def quotes_directed(spark, d):
    text = F.concat(F.lit('"'), F.col("p_name"), F.lit('" ("'), F.col("p_type"), F.lit('")--"'), F.col("p_brand"), F.lit('" <i t="a--b">"x"</i>'))
    return table(spark, d, "part").select("p_partkey", codes.typographic(text).alias("text"))


@query("""WITH n AS (SELECT p_partkey, p_size, p_size % 7 AS m FROM part),
               t AS (SELECT *, CASE WHEN p_size % 2 = 0 AND p_size <> 2 THEN 'Aramaic ' || p_size WHEN p_size = 2 THEN 'own' END AS x, CASE WHEN m % 2 = 0 AND m > 0 THEN 'Hebrew ' || m END AS y FROM n)
          SELECT p_partkey, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE x || ' OR ' || y || ' + Hebrew 4' END AS text FROM t""")
def briefs_described(spark, d):
    known = spark.range(1, 26).select(F.concat(F.lit("H:"), (F.col("id") * 2).cast("string")).alias("code"), F.concat(F.lit("Hebrew "), (F.col("id") * 2).cast("string")).alias("text"))
    known = known.unionByName(spark.createDataFrame([("A:2", "own")], "code string, text string"))
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("A:"), F.col("p_size").cast("string"), F.lit(" / H:"), (F.col("p_size") % 7).cast("string"), F.lit("+ H:4")).alias("code"))
    return part.join(resolving.briefs_described(part, "code", known), "code").select("p_partkey", "text")


@query("""SELECT s_suppkey AS id, CASE WHEN k = 0 OR k = 1 THEN NULL WHEN s_suppkey % 10 = 3 THEN 1.5 ELSE CAST(s_suppkey AS DOUBLE) END AS lon,
                 CASE WHEN k = 0 OR k = 1 THEN NULL WHEN s_suppkey % 10 = 3 THEN 2.5 ELSE CAST(s_nationkey AS DOUBLE) END AS lat,
                 CASE WHEN k = 0 OR k = 1 THEN NULL ELSE CAST(greatest(0, least(1000, round(s_acctbal / 4))) AS INTEGER) END AS score,
                 k > 1 AND s_suppkey % 10 = 3 AS custom, CASE k WHEN 0 THEN 'no identification' WHEN 1 THEN 'unknown' END AS reason
          FROM (SELECT *, s_suppkey % 5 AS k FROM supplier)""")
def places_located(spark, d):
    empty = F.lit(None).cast("string")
    own = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))
    resolution = lambda lonlat, special: F.struct(lonlat.alias("lonlat"), F.concat(F.lit("m"), (F.col("s_suppkey") % 10).cast("string")).alias("basis"), special.alias("special"))
    k = F.col("s_suppkey") % 5
    listed = F.array(F.struct((F.col("s_acctbal") / 4).alias("score"), empty.alias("special"), F.when(k == 1, F.array(resolution(empty, F.lit("unknown")))).otherwise(F.array(resolution(empty, empty), resolution(own, empty))).alias("resolutions")))
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k > 0, listed).otherwise(F.slice(listed, 1, 0)).alias("identifications"))
    return resolving.located(places, spark.createDataFrame([("m3", "1.5,2.5")], "basis string, custom_lonlat string"))


@query("""SELECT c_custkey, lag(c_custkey) OVER w AS prev, lead(c_custkey) OVER w AS next FROM customer WINDOW w AS (ORDER BY c_nationkey, c_custkey)""")
def adjacent_across_parents(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.struct("c_nationkey", "c_custkey").alias("at"))
    return ordered.neighbours(customers, "at", F.struct("c_nationkey", F.floor(F.col("c_custkey") / 1024)), "c_custkey").select("c_custkey", "prev", "next")


@query("""SELECT p_partkey, p_size AS start, greatest(CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size % 17 END, p_size + 1) AS end_year FROM part""")
def bar_years(spark, d):
    size = F.col("p_size")
    end = F.when(size % 3 == 0, F.lit(None)).otherwise(size % 17)
    return table(spark, d, "part").select("p_partkey", codes.bar(size, end).alias("b")).select("p_partkey", "b.start", F.col("b.end").alias("end_year"))


@query("""SELECT user_id, coalesce(min(ts) FILTER (event_type = 'signup'), min(ts)) AS at, coalesce(min(ts) FILTER (event_type = 'signup') IS NOT NULL, false) AS own FROM events GROUP BY 1""")
def preferred_dates(spark, d):
    own = F.min(F.when(F.col("event_type") == "signup", F.col("ts")))
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(own, F.min("ts")).alias("at"), own.isNotNull().alias("own"))


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def counts_by_rule(spark, d):
    return aggregates.counted(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.coalesce(F.sum("n"), F.lit(0))).select("l_suppkey", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query()
def segments_aligned(spark, d):
    """Places of the next turn's words (as numbers) that the words of a turn take."""
    from pyspark.sql import Window

    from lectern.functions import text as tx

    turns = table(spark, d, "conversations").withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    segments = F.transform(tx.tokens(F.col("text")), lambda w: F.struct(F.array(w).alias("numbers"), F.lit(False).alias("again")))
    words = F.transform(tx.tokens(F.col("after")), lambda w: F.array(w))
    found = turns.select("conv_id", "turn", resolving.segment_words(segments, words).alias("s"))
    return found.select("conv_id", "turn", F.size("s").alias("segments"), F.size(F.filter("s", lambda x: F.size(x) > 0)).alias("matched"))


@query("SELECT p_partkey, 0.59::DOUBLE AS x, 0.59::DOUBLE AS y, true AS inside FROM part")
def label_points(spark, d):
    """The inner point farthest from the edges of an L with arms one wide and sides drawn from a part.

    That is where a circle touches both outer sides and the inner corner, at 2 - sqrt(2) from the outer corner.
    """
    w, h = F.col("p_size").cast("double") + 2, (F.col("p_partkey") % 13).cast("double") + 2
    points = [(F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, F.lit(1.0)), (F.lit(1.0), F.lit(1.0)), (F.lit(1.0), h), (F.lit(0.0), h)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    found = spatial.label_points(table(spark, d, "part").select("p_partkey", F.array(ring).alias("rings")), "rings", "p", 1e-6)
    return found.select("p_partkey", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"), geo.in_ring(F.col("p.x"), F.col("p.y"), F.get("rings", F.lit(0))).alias("inside"))
