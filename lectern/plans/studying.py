"""Queries on pages, indexes, periods and aligned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import ordered, sequences, study
from lectern.plans.catalog import query
from lectern.tables import table


@query("""SELECT w.p_partkey AS wanted, p.p_partkey, row_number() OVER (PARTITION BY w.p_partkey ORDER BY CASE WHEN p.p_partkey = w.p_partkey THEN 0 ELSE 1 END, p.p_partkey) AS place
          FROM part w JOIN part p ON p.p_partkey % 200 = w.p_partkey % 200 WHERE w.p_partkey % 20 = 0""")
def senses_in_order(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("number"))
    wanted = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("wanted"), F.col("number").alias("base"))
    return study.senses(part, "number", "p_partkey", wanted).withColumn("place", F.col("place").cast("long"))


@query("""SELECT o_orderkey, min(r_name) AS r_name FROM orders JOIN region ON year(o_orderdate) BETWEEN 1991 + r_regionkey AND 1992 + r_regionkey GROUP BY 1 HAVING count(*) = 1""")
def single_period(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    periods = table(spark, d, "region").select("r_name", (F.col("r_regionkey") + 1991).alias("lo"), (F.col("r_regionkey") + 1992).alias("hi"))
    return study.single_period(orders, "o_orderkey", "year", periods, "r_name", "lo", "hi")


@query("""SELECT u.conv_id, u.turn, length(u.text) AS asked, length(a.text) AS answered FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def parallel_turns(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return turns.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked")).join(answers, ["conv_id", "turn"], "left")


@query("""SELECT level, count(*) AS n FROM (SELECT CASE WHEN p_size >= 35 THEN 'high' WHEN p_size >= 15 THEN 'medium' ELSE 'low' END AS level FROM part) GROUP BY 1""")
def score_buckets(spark, d):
    level = F.when(F.col("p_size") >= 35, "high").when(F.col("p_size") >= 15, "medium").otherwise("low")
    return table(spark, d, "part").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT 0 AS place, 'types' AS index, p_partkey AS key, CASE WHEN starts_with(lower(p_type), 'st') THEN 1 ELSE 3 END AS rank FROM part WHERE contains(lower(p_type), 'st')
          UNION ALL SELECT 1, 'names', p_partkey, CASE WHEN starts_with(lower(p_name), 'st') THEN 1 WHEN regexp_matches(lower(p_name), '[\\s(-]st') THEN 2 ELSE 3 END FROM part WHERE contains(lower(p_name), 'st')""")
def indexes_searched(spark, d):
    part = table(spark, d, "part")
    of = lambda c: part.select(F.col("p_partkey").alias("key"), F.col(c).alias("title"))
    return study.indexes_searched([("types", of("p_type")), ("names", of("p_name"))], "key", lambda t: tx.rank_of(t, "st"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def first_pages(spark, d):
    return study.first_pages(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2")
def first_uses(spark, d):
    return study.first_uses(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, turn AS upto FROM conversations")
def cumulative_prefixes(spark, d):
    return study.prefixes(table(spark, d, "conversations"), "conv_id", "turn").withColumn("step", F.col("step").cast("long"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def numeric_collation(spark, d):
    """The place of each title in an order where Title 10 follows Title 9."""
    titles = table(spark, d, "part").select("p_partkey", study.by_number(F.concat(F.lit("Title "), F.col("p_partkey").cast("string"))).alias("k"))
    placed = ordered.positions(titles, "k", F.substring("k", 1, 15))
    return placed.select("p_partkey", (F.col("pos") + 1).alias("place"))


@query("""SELECT p_partkey, greatest(p_partkey, b * 10) AS part_low, least(p_partkey + p_size, b * 10 + 9) AS part_high
          FROM (SELECT *, unnest(range(p_partkey // 10, (p_partkey + p_size) // 10 + 1)) AS b FROM part)""")
def range_split(spark, d):
    ranges = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return study.split_ranges(ranges, "lo", "hi", 10).select("p_partkey", "part_low", "part_high")


@query("SELECT CAST(floor(min(p_size) / 7.0) * 7 AS BIGINT) AS low, CAST(ceil(max(p_size) / 7.0) * 7 AS BIGINT) AS high FROM part")
def axis_range(spark, d):
    return study.axis(table(spark, d, "part"), "p_size", "p_size", 7)


@query("""SELECT user_id, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
          FROM (SELECT user_id, ts, max(CASE WHEN event_type = 'signup' THEN event_id END) AS v FROM events GROUP BY 1, 2)""")
def extend_to_cover(spark, d):
    events = table(spark, d, "events")
    marks = events.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("v"))
    return study.covered_to(marks, "user_id", "ts", "v", events)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
               r AS (SELECT conv_id, turn, n, k, 0 AS chunk, n AS load FROM t WHERE k = 1 UNION ALL
                     SELECT t.conv_id, t.turn, t.n, t.k, r.chunk + CASE WHEN load > 0 AND load + t.n > 1500 THEN 1 ELSE 0 END, CASE WHEN load > 0 AND load + t.n > 1500 THEN t.n ELSE load + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1),
               s AS (SELECT conv_id, chunk, sum(n) AS load, max(chunk) OVER (PARTITION BY conv_id) AS last FROM r GROUP BY 1, 2),
               f AS (SELECT conv_id, any_value(last) AS last, sum(load) FILTER (chunk = last) AS a, sum(load) FILTER (chunk = last - 1) AS b FROM s GROUP BY 1)
          SELECT conv_id, turn, CASE WHEN last > 0 AND a < 375 AND a + b <= 2000 THEN least(chunk, last - 1) ELSE chunk END AS bucket FROM r JOIN f USING (conv_id)""")
def bin_pack(spark, d):
    """Bucket of each turn of a conversation for buckets of about 1,500 characters."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    buckets = study.buckets_of(F.transform("turns", lambda t: t["n"]), 1500, 2000)
    return listed.select("conv_id", F.explode(F.arrays_zip(F.transform("turns", lambda t: t["turn"]).alias("turn"), buckets.alias("bucket"))).alias("e")).select("conv_id", "e.turn", "e.bucket")


@query()
def tags_carried(spark, d):
    """Places of a turn's words on the words of the next turn of the same role."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    words, other = tx.tokens(F.col("before")), tx.tokens(F.col("text"))
    tags = F.transform(words, lambda x, i: i.cast("string"))
    found = turns.select("conv_id", "turn", sequences.tag_transfer(words, tags, other).alias("t"))
    return found.select("conv_id", "turn", F.size("t").alias("words"), F.size(F.filter("t", lambda x: x.isNotNull())).alias("tagged"))
