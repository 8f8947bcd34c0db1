"""Queries on years, scales, lines and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import geo, paths, years
from lectern.plans.catalog import query
from lectern.tables import table


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


@query("""SELECT o_orderkey, CASE WHEN y <= 0 THEN y - 1 ELSE y END AS end_year FROM (SELECT o_orderkey, CAST(CASE WHEN s < 0 THEN s + 1 ELSE s END + n + (o_orderkey % 3) // 2 AS BIGINT) AS y
          FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 90 = 45 THEN -46 ELSE o_orderkey % 90 - 45 END AS s, o_orderkey % 50 AS n FROM orders))""")
def end_years(spark, d):
    """The year in which a duration of years and months ends; no year is 0."""
    k = F.col("o_orderkey")
    start = F.when(k % 90 == 45, -46).otherwise(k % 90 - 45).cast("int")
    text = F.concat((k % 50).cast("string"), F.lit("Y"), F.when(k % 3 == 2, "12M").otherwise("6M"))
    return table(spark, d, "orders").select("o_orderkey", years.end_year(start, text).cast("long").alias("end_year"))


@query("""SELECT o_orderkey, CASE WHEN lo = hi THEN '' ELSE CASE WHEN lo <= 0 THEN greatest(-lo, 1) || ' BC' ELSE 'AD ' || lo END || ' – ' END || CASE WHEN hi <= 0 THEN greatest(-hi, 1) || ' BC' ELSE 'AD ' || hi END AS span
          FROM (SELECT o_orderkey, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT o_orderkey, o_orderkey % 60 - 30 AS a, o_custkey % 60 - 30 AS b FROM orders))""")
def spans_spelled(spark, d):
    return table(spark, d, "orders").select("o_orderkey", years.spelled_span(F.col("o_orderkey") % 60 - 30, F.col("o_custkey") % 60 - 30).alias("span"))


@query("SELECT event_id, ['first', 'second', 'third', 'fourth', 'fifth'][(dayofyear(ts) - 1) % 5 + 1] AS pick FROM events")
def rotating_pick(spark, d):
    """An item for the day of the year of each event."""
    items = F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth", "fifth")])
    return table(spark, d, "events").select("event_id", years.rotating(F.dayofyear("ts"), items).alias("pick"))


@query("""SELECT p_partkey, coalesce(array_to_string(range(CAST(ceil(lo / 7.0) * 7 AS BIGINT), CAST(floor(hi / 7.0) * 7 AS BIGINT) + 1, 7), ' '), '') AS ticks FROM (SELECT p_partkey, p_partkey % 100 - 50 AS lo, p_partkey % 100 - 50 + p_size % 30 AS hi FROM part)""")
def ticks(spark, d):
    """Multiples of 7 in a range of each part."""
    low = (F.col("p_partkey") % 100 - 50).cast("int")
    found = years.ticks(low, (low + F.col("p_size") % 30).cast("int"), 7)
    return table(spark, d, "part").select("p_partkey", F.array_join(found.cast("array<string>"), " ").alias("ticks"))


@query("SELECT p_partkey, round(pow(2.0, round(log2(p_size + 0.25) * 3) / 3), 6) AS scale FROM part")
def label_scales(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(geo.label_scale(F.col("p_size") + 0.25), 6).alias("scale"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 30 AS DOUBLE) AS y FROM lineitem)
          SELECT l_orderkey, l_linenumber, round(least(sqrt(pow(x - greatest(0, least(20, x)), 2) + y * y), sqrt(pow(x - 20, 2) + pow(y - greatest(0, least(10, y)), 2))), 6) AS far FROM t""")
def line_distances(spark, d):
    """Distance of points to a line with one corner."""
    line = F.array(*[_point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (20, 0), (20, 10))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(paths.to_line((F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double"), line), 6).alias("far"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 13 - 3 AS y, p_partkey % 17 - 4 AS x0, p_partkey % 17 - 4 + p_size % 12 + 1 AS x1 FROM part)
          SELECT p_partkey, CASE WHEN y BETWEEN 0 AND 8 AND x1 >= 0 AND x0 <= 10 THEN greatest(x0, 0) || ' ' || least(x1, 10) ELSE '' END AS xs FROM t""")
def lines_clipped(spark, d):
    """Where level lines run within a box."""
    k = F.col("p_partkey")
    y, x0 = k % 13 - 3, k % 17 - 4
    runs = paths.clipped_line(F.array(_point(x0, y), _point(x0 + F.col("p_size") % 12 + 1, y)), 0, 0, 10, 8)
    found = table(spark, d, "part").select("p_partkey", F.flatten(runs).alias("points"))
    return found.select("p_partkey", F.array_join(F.transform("points", lambda p: p["x"].cast("long").cast("string")), " ").alias("xs"))


@query("""SELECT p_partkey, CAST(len(list_filter(range(1, 6), lambda i: i = 1 OR g[i] <> g[i - 1])) AS BIGINT) AS points, CAST(round(list_sum(g)) AS BIGINT) AS total
          FROM (SELECT p_partkey, list_transform(range(5), lambda i: round((p_size + i * (p_partkey % 4)) / 4.0) * 4) AS g FROM part)""")
def points_quantised(spark, d):
    """Points on a grid of 4, without repeats, and the sum over all points before repeats go."""
    step = F.col("p_partkey") % 4
    points = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: _point(F.col("p_size") + i * step, F.lit(0)))
    grid = F.transform(points, lambda p: F.round(p["x"] / 4) * 4)
    total = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "part").select("p_partkey", F.size(geo.quantised(points, 4)).cast("long").alias("points"), F.round(total).cast("long").alias("total"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS polygons, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS rings, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE CAST(p_size + 0.5 AS DOUBLE) END AS x FROM part""")
def shapes_scanned(spark, d):
    """Polygons of GeoJSON features: one, several, or another shape."""
    ring = F.format_string("[[%s.5,0],[1,0],[1,1],[%s.5,0]]", "p_size", "p_size")
    kind = F.col("p_partkey") % 3
    shape = (
        F.when(kind == 0, F.format_string('{"type":"Polygon","coordinates":[%s,%s]}', ring, ring))
        .when(kind == 1, F.format_string('{"type":"MultiPolygon","coordinates":[[%s],[%s,%s]]}', ring, ring, ring))
        .otherwise('{"type":"Point","coordinates":[1,2]}')
    )
    found = table(spark, d, "part").select("p_partkey", geo.polygons(F.concat(F.lit('{"type":"Feature","properties":{"name":"x"},"geometry":'), shape, F.lit("}"))).alias("p"))
    first = F.get(F.get(F.get(F.get("p", F.lit(0)), F.lit(0)), F.lit(0)), F.lit(0))
    return found.select("p_partkey", F.size("p").cast("long").alias("polygons"), F.size(F.flatten("p")).cast("long").alias("rings"), first.alias("x"))


@query("""SELECT p_partkey, greatest(0, least(w, 10) - 1) * greatest(0, least(h, 8) - 1) AS area FROM (SELECT p_partkey, CAST(p_size % 14 AS DOUBLE) AS w, CAST(p_partkey % 11 AS DOUBLE) AS h FROM part)""")
def rings_clipped(spark, d):
    """Area of rectangles, given clockwise with a point too many, in a box."""
    w, h = (F.col("p_size") % 14).cast("double"), (F.col("p_partkey") % 11).cast("double")
    ring = F.array(*[_point(x, y) for x, y in ((F.lit(0), F.lit(0)), (F.lit(0), h), (w, h), (w, F.lit(0)), (w / 2, F.lit(0)))])
    clipped = geo.simplified(geo.clipped_ring(geo.oriented(ring), 1, 1, 10, 8), 0.001)
    return table(spark, d, "part").select("p_partkey", F.round(F.coalesce(geo.signed_area(clipped), F.lit(0.0)), 6).alias("area"))
