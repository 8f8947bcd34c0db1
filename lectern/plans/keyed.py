"""Joins, set operations and grouped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates, joins
from lectern.plans.catalog import query
from lectern.tables import table

RANGES = "(SELECT p_partkey AS rk, p_partkey AS lo, p_partkey + p_size AS hi, p_brand AS r_brand FROM part)"


def _ranges(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rk"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"), F.col("p_brand").alias("r_brand"))


def _stabs(spark, d, on=None):
    points = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return joins.stabbed(points, "p_partkey", _ranges(spark, d).withColumnRenamed("r_brand", "r_brand"), "lo", "hi", 64, on)


@query("""SELECT p_brand, s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
          LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def star_lookup(spark, d):
    met = joins.star(table(spark, d, "lineitem"), (table(spark, d, "part"), "l_partkey", "p_partkey"), (table(spark, d, "supplier"), "l_suppkey", "s_suppkey"))
    return met.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT o_orderkey, coalesce(c.c_name, 'region ' || n.n_name, 'none') AS label FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey AND c.c_acctbal > 0
          LEFT JOIN nation n ON o_custkey % 40 = n.n_nationkey""")
def lookup_fallback(spark, d):
    customers = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 40).alias("nk"))
    met = joins.star(orders, (customers, "o_custkey", "c_custkey"), (table(spark, d, "nation"), "nk", "n_nationkey"))
    return met.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("region "), F.col("n_name")), F.lit("none")).alias("label"))


@query("""WITH q AS (SELECT DISTINCT l_partkey AS k FROM lineitem),
               r1 AS (SELECT l_partkey AS k, min(l_suppkey) AS t FROM lineitem WHERE l_quantity > 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1),
               r2 AS (SELECT l_partkey AS k, min(l_suppkey) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1),
               r3 AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS t FROM part WHERE p_size < 10)
          SELECT q.k, coalesce(r1.t, r2.t, r3.t) AS target, CASE WHEN r1.t IS NOT NULL THEN 'large' WHEN r2.t IS NOT NULL THEN 'returned' WHEN r3.t IS NOT NULL THEN 'size' END AS rule
          FROM q LEFT JOIN r1 USING (k) LEFT JOIN r2 USING (k) LEFT JOIN r3 USING (k)""")
def cascade_resolve(spark, d):
    items, part = table(spark, d, "lineitem"), table(spark, d, "part")
    pairs = lambda c: items.where(c).select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("target"))
    small = part.where("p_size < 10").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("target"))
    queries = items.select(F.col("l_partkey").alias("k")).distinct()
    return joins.first_match(queries, "k", [("large", pairs("l_quantity > 45")), ("returned", pairs("l_returnflag = 'R'")), ("size", small)])


@query("""WITH f AS (SELECT substr(c_name, 1, 17) AS prefix, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1),
               q AS (SELECT DISTINCT substr(c_name, 1, 17) AS prefix FROM customer) SELECT prefix, c_custkey FROM q LEFT JOIN f USING (prefix)""")
def unique_or_null(spark, d):
    found = table(spark, d, "customer").select(F.substring("c_name", 1, 17).alias("prefix"), "c_custkey")
    return joins.unique_or_null(found.select("prefix").distinct(), "prefix", found, "c_custkey").select("prefix", "c_custkey")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_confirm(spark, d):
    good = table(spark, d, "labels").where("quality = 1")
    return table(spark, d, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_uncovered(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_ratio(spark, d):
    out = aggregates.coverage(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return out.withColumn("share", F.round(F.col("covered") / F.col("total"), 6))


@query(f"SELECT p_partkey, count(*) AS n, min(rk) AS first FROM part JOIN {RANGES} ON p_partkey BETWEEN lo AND hi GROUP BY 1")
def interval_stab(spark, d):
    return _stabs(spark, d).groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("rk").alias("first"))


@query(f"""SELECT p_partkey, rk, hi - lo AS width FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN lo = p_partkey + 3 THEN 0 ELSE 1 END, hi - lo, rk) AS k
          FROM part JOIN {RANGES} ON p_partkey + 3 BETWEEN lo AND hi AND p_brand = r_brand) WHERE k = 1""")
def interval_argmin(spark, d):
    """The best range of its brand at the point three behind each part."""
    points = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") + 3).alias("at"), F.col("p_brand").alias("brand"))
    stabs = joins.stabbed(points, "at", _ranges(spark, d), "lo", "hi", 64).where("brand = r_brand")
    return joins.best_range(stabs, ["p_partkey"], "at", "lo", "hi", "rk").select("p_partkey", "rk", (F.col("hi") - F.col("lo")).alias("width"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN 'equal' WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 'inside' WHEN a.lo <= b.lo AND a.hi >= b.hi THEN 'around'
          WHEN a.lo <= b.hi AND b.lo <= a.hi THEN 'overlap' ELSE 'apart' END AS kind FROM {RANGES} a JOIN {RANGES} b ON a.r_brand = b.r_brand AND a.rk <> b.rk) GROUP BY 1""")
def overlap_classify(spark, d):
    """How all pairs of ranges of a brand lie."""
    return joins.overlaps_counted(_ranges(spark, d), "r_brand", "rk", "lo", "hi", 64)


@query("""SELECT p.user_id, p.ts, p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
          ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_latest(spark, d):
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.latest_before(buys, views, "user_id", "ts", ["view_id"], F.date_trunc("week", "ts"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 + 1 AS b FROM lineitem) SELECT x.a, x.b FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""")
def swap_pairs(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"))
    return joins.swapped(pairs, "a", "b")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS item FROM lineitem),
               s AS (SELECT id, count(*) AS size FROM a GROUP BY 1), c AS (SELECT a.id AS "left", b.id AS "right", count(*) AS common FROM a JOIN b USING (item) GROUP BY 1, 2),
               h AS (SELECT "left", "right", common / size::DOUBLE AS share, max(common / size::DOUBLE) OVER (PARTITION BY "left") AS best FROM c JOIN s ON c."left" = s.id)
          SELECT "left", min("right") AS "right", round(max(share), 6) AS share FROM h WHERE share = best AND share >= 0.5 GROUP BY 1 HAVING count(*) = 1""")
def best_overlap(spark, d):
    """The supplier that has delivered most of an order's parts."""
    items = table(spark, d, "lineitem")
    a = items.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    b = items.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("item"))
    return joins.best_overlap(a, b).withColumn("share", F.round("share", 6))


@query("""SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey
          JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def two_hop(spark, d):
    near = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = near.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = aggregates.counted(table(spark, d, "orders"), "o_custkey").withColumnRenamed("n", "m")
    return met.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("r_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("m"), F.lit(0)).alias("orders"))


LINKS = "(SELECT l_suppkey AS a, l_partkey % 100 AS b, CAST(l_quantity AS BIGINT) - 10 AS votes FROM lineitem)"


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), (F.col("l_quantity").cast("long") - 10).alias("votes"))


@query(f"SELECT a, b, max(votes) AS votes FROM {LINKS} WHERE votes > 0 AND a <> b GROUP BY 1, 2")
def xref_max_merge(spark, d):
    return aggregates.strongest(_links(spark, d), "a", "b", "votes")


@query(f"""SELECT count(*) AS "rows", count(*) FILTER (votes <= 0) AS low, count(*) FILTER (votes > 0 AND a = b) AS self, count(*) FILTER (votes > 0 AND a <> b AND b = 0) AS bad,
          count(*) FILTER (votes > 0 AND a <> b AND b <> 0) AS kept FROM {LINKS}""")
def xref_accounting(spark, d):
    return aggregates.accounted(_links(spark, d), low=F.col("votes") <= 0, self=F.col("a") == F.col("b"), bad=F.col("b") == 0)


@query("""SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY first, l_partkey) AS items FROM
          (SELECT l_suppkey, l_partkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def first_mention_list(spark, d):
    return aggregates.first_mentions(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS items FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, d):
    return aggregates.first_mentions(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text)) AS chars, count(*) FILTER (role = 'user') AS asked,
          round(count(*) FILTER (role = 'assistant') / count(*)::DOUBLE, 6) AS share FROM conversations GROUP BY 1""")
def session_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_distinct("role").alias("roles"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("role") == "user").alias("asked"),
        F.round(F.count_if(F.col("role") == "assistant") / F.count("*"), 6).alias("share"),
    )


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def upsert_latest(spark, d):
    return aggregates.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_type", "ts")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang <> 'en'")
def union_distinct(spark, d):
    return table(spark, d, "labels").select("doc_id").union(table(spark, d, "documents").where("lang <> 'en'").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("SELECT l_returnflag, l_linenumber, count(*) AS n, sum(l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE(l_returnflag, l_linenumber)")
def lineitem_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("suppliers"))


@query("SELECT r_name, n_regionkey, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY CUBE(r_name, n_regionkey)")
def region_cube(spark, d):
    met = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return met.cube("r_name", "n_regionkey").agg(F.count("*").alias("n"))


@query("""SELECT sha256(string_agg(c_name || ' ' || sha256(c_name), chr(10) ORDER BY c_name)) AS sha256, count(*) AS files FROM customer""")
def manifest_hash(spark, d):
    """One digest over the names and digests of all customers, as of a list of files."""
    listed = F.array_sort(F.collect_list(F.concat("c_name", F.lit(" "), F.sha2("c_name", 256))))
    return table(spark, d, "customer").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("sha256"), F.count("*").alias("files"))
