"""Running totals, islands, runs, gaps, neighbours and greedy orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ordered
from lectern.plans.catalog import query
from lectern.tables import table


@query("SELECT o_orderkey, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders")
def prefix_sum_slots(spark, d):
    price = F.floor("o_totalprice")
    orders = table(spark, d, "orders").select("o_orderkey", price.alias("price"))
    return ordered.running_total(orders, "o_orderkey", "price", F.floor(F.col("o_orderkey") / 4096)).select("o_orderkey", "before")


@query("SELECT p_partkey, lag(p_name) OVER (ORDER BY p_partkey) AS prev, lead(p_name) OVER (ORDER BY p_partkey) AS next FROM part")
def neighbors(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return ordered.neighbours(part, "p_partkey", F.floor(F.col("p_partkey") / 1024), "p_name").select("p_partkey", "prev", "next")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def canonical_positions(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return ordered.positions(orders, "o_orderkey", F.floor(F.col("o_orderkey") / 4096))


@query("""WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
          SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY user_id, g""")
def gaps_islands(spark, d):
    days = table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return ordered.islands(days, ["user_id"], "day")


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
               r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
          SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def rle_groups(spark, d):
    runs = ordered.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.date_trunc("week", "ts"))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""SELECT brand, reach + 1 AS gap_from, lo - 1 AS gap_to FROM (SELECT p_brand AS brand, p_partkey AS lo, max(p_partkey + p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey, p_partkey + p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM part) WHERE lo > reach + 1""")
def interval_complement(spark, d):
    ranges = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    return ordered.gaps(ranges, ["brand"], "lo", "hi")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS w FROM lineitem")
def ordinal_in_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("w"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events""")
def fill_previous(spark, d):
    marked = table(spark, d, "events").withColumn("since", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ordered.filled(marked, ["user_id"], ["ts", "event_id"], "since", F.date_trunc("week", "ts")).select("event_id", "since")


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) AS part FROM lineitem")
def range_explode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("long"), F.col("l_linenumber").cast("long"))).alias("part"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
               r AS (SELECT conv_id, turn, k, 0 AS chunk, n AS load FROM t WHERE k = 1 UNION ALL
                     SELECT t.conv_id, t.turn, t.k, r.chunk + CASE WHEN load > 0 AND load + n > 600 THEN 1 ELSE 0 END, CASE WHEN load > 0 AND load + n > 600 THEN n ELSE load + n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
          SELECT conv_id, turn, chunk FROM r""")
def greedy_chunks(spark, d):
    """Turns of a conversation in chunks of at most 600 characters; a longer turn stands alone."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    chunks = ordered.chunked(F.transform("turns", lambda t: t["n"]), 600)
    return listed.select("conv_id", F.posexplode(F.arrays_zip(F.transform("turns", lambda t: t["turn"]).alias("turn"), chunks.alias("chunk")))).select("conv_id", F.col("col.turn").alias("turn"), F.col("col.chunk").alias("chunk"))


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
               r AS (SELECT user_id, event_id, lo, k, 0 AS row, [lo + 4200] AS free FROM t WHERE k = 1 UNION ALL
                     SELECT user_id, event_id, lo, k, i - 1, list_concat(free[1:i - 1], [lo + 4200], free[i + 1:]) FROM (
                       SELECT t.*, free, CAST(coalesce(nullif(list_position(list_transform(free, lambda x: x <= t.lo), true), 0), len(free) + 1) AS INTEGER) AS i FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1))
          SELECT user_id, event_id, lo, lo + 3600 AS hi, row FROM r""")
def pack_rows(spark, d):
    """Display rows of each user's events, each an hour long with a gap of ten minutes."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = table(spark, d, "events").select("user_id", "event_id", seconds.alias("lo"), (seconds + 3600).alias("hi"))
    return ordered.rows_packed(spans, ["user_id"], "lo", "hi", 600, "event_id", F.floor(F.col("lo") / 604_800))


@query("""SELECT user_id, CAST(n AS BIGINT) AS session, min(event_id) AS first_event, count(*) AS events FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM
          (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2""")
def pause_sessions(spark, d):
    """Stretches of a user's events without a pause of more than a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 1 day")
    marked = table(spark, d, "events").withColumn("c", F.when(late, 0).otherwise(1)).withColumn("session", F.sum("c").over(w))
    return marked.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS n FROM orders), x AS (SELECT o_orderkey, unnest(range(1, n + 1)) AS i FROM k),
               f AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND i BETWEEN l_linenumber AND l_linenumber + l_quantity::INT % 3 - 1)),
               g AS (SELECT *, i - row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS g FROM f)
          SELECT o_orderkey, min(i) AS gap_from, max(i) AS gap_to FROM g GROUP BY o_orderkey, g""")
def numbers_uncovered(spark, d):
    """Numbers of an order, up to its count, that no line's range holds."""
    keys = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("n"))
    ranges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3 - 1).alias("hi"))
    return ordered.uncovered(keys, ranges, "o_orderkey", "n", "lo", "hi")
