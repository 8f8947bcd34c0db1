"""Scalar queries: years, durations, geometry, buckets, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import geo, years
from lectern.functions import text as tx
from lectern.operators import sequences
from lectern.plans.catalog import query
from lectern.tables import table


@query("""SELECT era, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) < 1993 THEN 'early' WHEN year(o_orderdate) < 1996 THEN 'middle' WHEN o_totalprice >= 200000 THEN 'late, large' ELSE 'late' END AS era FROM orders) GROUP BY 1""")
def era_buckets(spark, d):
    year = F.year("o_orderdate")
    era = F.when(year < 1993, "early").when(year < 1996, "middle").when(F.col("o_totalprice") >= 200000, "late, large").otherwise("late")
    return table(spark, d, "orders").groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, round(CAST(p_size AS DOUBLE) + (p_partkey % 12) / 12.0 + 7 * (p_partkey % 4) / 365.25 + 3 / 365.25, 6) AS years FROM part""")
def duration_parse(spark, d):
    text = F.format_string("%sY%sM%sW3D", "p_size", F.col("p_partkey") % 12, F.col("p_partkey") % 4)
    return table(spark, d, "part").select("p_partkey", F.round(years.duration(text), 6).alias("years"))


@query("""SELECT o_orderkey, CASE WHEN y <= 0 THEN y - 1 ELSE y END AS year, CASE WHEN y <= 0 THEN CAST(1 - y AS VARCHAR) || ' BC' ELSE 'AD ' || CAST(y AS VARCHAR) END AS spelled FROM (SELECT o_orderkey, o_orderkey % 4000 - 2000 AS y FROM orders)""")
def year_shift(spark, d):
    year = years.historical(F.col("o_orderkey") % 4000 - 2000)
    return table(spark, d, "orders").select("o_orderkey", year.alias("year"), years.spelled(year).alias("spelled"))


@query("""SELECT vec_id, round((embedding[1]::DOUBLE - 0.1) * (cos(radians(30)) * 40), 4) AS x, round((30 - embedding[2]::DOUBLE) * 40, 4) AS y FROM embeddings""")
def project_xy(spark, d):
    at = geo.projected(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), 0.1, 30, 40)
    return table(spark, d, "embeddings").select("vec_id", at.alias("p")).select("vec_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings) SELECT a.vec_id, b.vec_id AS near, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance
          FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND floor(a.x / 0.02) - floor(b.x / 0.02) BETWEEN -1 AND 1 AND floor(a.y / 0.02) - floor(b.y / 0.02) BETWEEN -1 AND 1
          WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02""")
def nearest_within(spark, d):
    """Points of a label within a radius, through a grid of that width."""
    r = 0.02
    points = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    points = points.withColumn("gx", F.floor(F.col("x") / r)).withColumn("gy", F.floor(F.col("y") / r))
    around = points.select(F.col("vec_id").alias("near"), F.col("label").alias("l"), F.col("x").alias("nx"), F.col("y").alias("ny"), "gx", "gy")
    step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    around = around.withColumn("dx", step).withColumn("dy", step).withColumn("hx", F.col("gx") + F.col("dx")).withColumn("hy", F.col("gy") + F.col("dy")).drop("gx", "gy")
    met = points.join(around, (F.col("label") == F.col("l")) & (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")) & (F.col("vec_id") != F.col("near")))
    far = geo.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return met.where(far <= r).select("vec_id", "near", F.round(far, 6).alias("distance"))


def _ring():
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))


@query("""SELECT vec_id, round(list_sum(list_transform(range(8), lambda i: embedding[i * 2 + 1]::DOUBLE * embedding[(i + 1) % 8 * 2 + 2]::DOUBLE - embedding[(i + 1) % 8 * 2 + 1]::DOUBLE * embedding[i * 2 + 2]::DOUBLE)) / 2, 6) AS area FROM embeddings""")
def ring_area(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(geo.signed_area(_ring()), 6).alias("area"))


@query("SELECT vec_id, round(list_min(list_transform(range(8), lambda i: embedding[i * 2 + 1]))::DOUBLE, 6) AS x0, round(list_max(list_transform(range(8), lambda i: embedding[i * 2 + 2]))::DOUBLE, 6) AS y1 FROM embeddings")
def ring_bounds(spark, d):
    box = geo.bounds(_ring())
    return table(spark, d, "embeddings").select("vec_id", F.round(box["x0"], 6).alias("x0"), F.round(box["y1"], 6).alias("y1"))


@query()
def rings_simplified(spark, d):
    ring = geo.simplified(geo.clipped_ring(geo.oriented(_ring()), -0.15, -0.15, 0.15, 0.15), 0.02)
    return table(spark, d, "embeddings").select("vec_id", F.size(ring).alias("points"), F.round(geo.signed_area(ring), 6).alias("area"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations),
               p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(before), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS b FROM t WHERE before IS NOT NULL),
               r AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM p UNION ALL
                     SELECT conv_id, turn, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda k: list_max(now[1:k])) FROM (
                       SELECT *, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE row[j + 1] END)) AS now FROM r WHERE i < len(a)))
          SELECT conv_id, turn, ok, len(a) - ok AS missed, len(b) - ok AS extra, round(ok / nullif(len(a) + len(b) - ok, 0)::DOUBLE, 6) AS accuracy FROM (SELECT *, row[len(b) + 1] AS ok FROM r WHERE i = len(a))""")
def lcs_diff(spark, d):
    """Each turn of a conversation against the one before it in the same role."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("now"), F.lag("text").over(w).alias("before"))
    result = sequences.word_diff(tx.tokens(F.col("before")), F.col("now"))
    found = turns.where("before is not null").select("conv_id", "turn", result.alias("r"))
    return found.select("conv_id", "turn", "r.ok", "r.missed", "r.extra", F.round(sequences.accuracy(F.col("r")), 6).alias("accuracy"))
