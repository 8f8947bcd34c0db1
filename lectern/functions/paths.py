"""Lines and drawn paths.  Each function is one sequential pass over a row's points, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def encoded(points: Column, closed: bool) -> Column:
    """M with the first point, l with steps in tenths from one point to the next, z if closed."""
    tenth = lambda v: F.round(v * 10).cast("long")
    grid = F.transform(points, lambda p: F.struct(tenth(p["x"]).alias("x"), tenth(p["y"]).alias("y")))
    shown = lambda v: F.regexp_replace(F.format_string("%.1f", v / 10), r"\.0$", "")
    steps = F.zip_with(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), F.slice(grid, 1, F.greatest(F.size(grid) - 1, F.lit(0))), lambda q, p: F.concat(shown(q["x"] - p["x"]), F.lit(","), shown(q["y"] - p["y"])))
    head = F.concat(F.lit("M"), shown(grid[0]["x"]), F.lit(","), shown(grid[0]["y"]))
    body = F.when(F.size(grid) > 1, F.concat(F.lit("l"), F.array_join(steps, " "))).otherwise("")
    return F.when(F.size(points) > 0, F.concat(head, body, F.lit("z" if closed else "")))


def decoded(path: Column) -> Column:
    """The points of a path made by encoded."""
    number = lambda t, k: F.split(t, ",")[k].cast("double")
    first = F.regexp_extract(path, r"^M([^lz]+)", 1)
    steps = F.filter(F.split(F.regexp_extract(path, r"l([^z]+)", 1), " "), lambda s: s != "")
    start = F.array(F.struct(number(first, 0).alias("x"), number(first, 1).alias("y")))

    def step(acc, s):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(F.round(last["x"] + number(s, 0), 1).alias("x"), F.round(last["y"] + number(s, 1), 1).alias("y"))))

    return F.when(path.isNotNull(), F.aggregate(steps, start, step))


def to_segment(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Distance of a point to the segment from p to q."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / F.when(size == 0, 1.0).otherwise(size))))
    return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)


def to_line(x: Column, y: Column, points: Column) -> Column:
    """Smallest distance of a point to the segments of a line."""
    short = F.greatest(F.size(points) - 1, F.lit(0))
    return F.array_min(F.zip_with(F.slice(points, 1, short), F.slice(points, 2, short), lambda p, q: to_segment(x, y, p, q)))


def clipped_line(points: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The runs of a line within a box."""

    def inside(p, q):
        low, high = 0.0, 1.0
        for d, a, lo, hi in ((q[0] - p[0], p[0], x0, x1), (q[1] - p[1], p[1], y0, y1)):
            if d == 0:
                if not lo <= a <= hi:
                    return None
                continue
            s, t = sorted(((lo - a) / d, (hi - a) / d))
            low, high = max(low, s), min(high, t)
        return (low, high) if low <= high else None

    def run(pts):
        out = []
        points = [(p["x"], p["y"]) for p in pts or []]
        for p, q in zip(points, points[1:]):
            part = inside(p, q)
            if not part:
                continue
            a, b = ((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for t in part)
            if out and out[-1][-1] == a:
                out[-1].append(b)
            else:
                out.append([a, b])
        return [[{"x": x, "y": y} for x, y in line] for line in out]

    return F.udf(run, f"array<{POINTS}>", useArrow=True)(points)
