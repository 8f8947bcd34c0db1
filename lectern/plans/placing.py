"""Queries on places: points and boxes on rings, members of archives, titles in a reader's order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lectern.operators import spatial, study
from lectern.plans.catalog import query
from lectern.sources import archives
from lectern.tables import scratch, table

_TURNS = [(round(math.cos(k * math.pi / 4), 6), round(math.sin(k * math.pi / 4), 6)) for k in range(8)]
_RING_SQL = "[" + ", ".join(f"{{'x': 4 * e[{2 * 1 + 1}] + (0.05 + abs(e[{5 + k}])) * {c}, 'y': 4 * e[{2 * 1 + 2}] + (0.05 + abs(e[{5 + k}])) * {s}}}" for k, (c, s) in enumerate(_TURNS)) + "]"
_CROSSED = "list_sum([((r[k].y > p.y) <> (r[k % 8 + 1].y > p.y) AND p.x < (r[k % 8 + 1].x - r[k].x) * (p.y - r[k].y) / CASE WHEN r[k % 8 + 1].y <> r[k].y THEN r[k % 8 + 1].y - r[k].y ELSE 1 END + r[k].x)::INT FOR k IN range(1, 9)])"


def _shapes(spark, d):
    """A point, and a ring of eight corners around another one, for each embedding."""
    rows = table(spark, d, "embeddings")
    at = lambda k: F.element_at("embedding", k).cast("double")
    reach = lambda k: F.lit(0.05) + F.abs(at(5 + k))
    ring = F.array(*[F.struct((F.lit(4.0) * at(3) + reach(k) * c).alias("x"), (F.lit(4.0) * at(4) + reach(k) * s).alias("y")) for k, (c, s) in enumerate(_TURNS)])
    return rows.select(F.col("vec_id").alias("spot"), (F.lit(4.0) * at(1)).alias("x"), (F.lit(4.0) * at(2)).alias("y")), rows.select("vec_id", ring.alias("ring"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id, {_RING_SQL} AS r FROM v), p AS (SELECT 4 * e[1] AS x, 4 * e[2] AS y FROM v)
           SELECT vec_id, count(*) AS points, round(sum(p.x), 6) AS sum_x FROM r, p WHERE {_CROSSED} % 2 = 1 GROUP BY 1""")
def points_on_rings(spark, d):
    """How many points of all lie inside each ring."""
    points, rings = _shapes(spark, d)
    return spatial.sums_in_rings(points, rings, "vec_id", "x").select("vec_id", F.col("n").alias("points"), F.round("total", 6).alias("sum_x"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id, {_RING_SQL} AS r FROM v),
                b AS (SELECT vec_id, list_min([p.x FOR p IN r]) AS x0, list_max([p.x FOR p IN r]) AS x1, list_min([p.y FOR p IN r]) AS y0, list_max([p.y FOR p IN r]) AS y1 FROM r)
           SELECT a.vec_id, count(*) AS meeting, max(b.vec_id) AS last FROM b a, b WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY 1""")
def boxes_met(spark, d):
    """How many rings' bounds meet those of each ring, its own among them."""
    boxes = _shapes(spark, d)[1].select("vec_id", F.struct(F.array_min("ring.x").alias("x0"), F.array_min("ring.y").alias("y0"), F.array_max("ring.x").alias("x1"), F.array_max("ring.y").alias("y1")).alias("box"))
    return spatial.boxes_counted(boxes, boxes, "vec_id").groupBy("vec_id").agg(F.sum("n").alias("meeting"), F.max("last").alias("last"))


@query("""SELECT 'b' || p_size AS archive, 'm' || p_partkey AS member, length(p_name) AS size, sha256(p_name) AS sha256, NULL::VARCHAR AS problem FROM part""")
def archives_read(spark, d):
    """Archives of the parts of a size, a member a part, written and read member by member."""
    path = scratch(spark)
    parts = table(spark, d, "part").select(F.concat(F.lit("b"), "p_size").alias("a"), F.concat(F.lit("m"), "p_partkey").alias("m"), F.col("p_name").alias("t"))
    archives.write_archives(parts, path, "a", "m", "t").count()
    found = archives.zip_members(spark, path, share_bytes=4096)
    return found.select(F.regexp_extract("archive", "([^/]+)[.]zip$", 1).alias("archive"), "member", "size", F.sha2("content", 256).alias("sha256"), "problem")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY (CASE p_partkey % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'É' ELSE 'f' END) COLLATE NOCASE.NOACCENT, regexp_extract(p_brand, '[0-9]+')::INT, p_size, p_partkey) AS place FROM part""")
def titles_collated(spark, d):
    """The place of each title by base letters and numbers: e, E and É are one, size 9 comes before 10."""
    letter = F.when(F.col("p_partkey") % 3 == 0, "e").when(F.col("p_partkey") % 3 == 1, "É").otherwise("f")
    brand = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    titles = table(spark, d, "part").select("p_partkey", F.concat(letter, brand, F.lit(" "), "p_size").alias("title"))
    return study.collated_places(titles, "title", "p_partkey").select("p_partkey", "place")
