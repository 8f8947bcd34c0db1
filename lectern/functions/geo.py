"""Plane geometry over arrays of struct<x,y>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _turned(ring: Column) -> Column:
    """The ring from its second point on, ending with the first."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace area; the sign tells the direction."""
    return F.aggregate(F.zip_with(ring, _turned(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, t: s + t) / 2


def oriented(ring: Column, positive: bool = True) -> Column:
    area = signed_area(ring)
    return F.when((area >= 0) if positive else (area <= 0), ring).otherwise(F.reverse(ring))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    crossed = F.zip_with(ring, _turned(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]).otherwise(1.0) + p["x"]))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1>, null without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def polygons(feature: Column) -> Column:
    """array<array<array<array<double>>>>: the polygons (rings of points) of a GeoJSON feature, none for other shapes."""
    shape = F.from_json(feature, "struct<geometry:struct<type:string,coordinates:string>>")["geometry"]
    one = F.array(F.from_json(shape["coordinates"], "array<array<array<double>>>"))
    many = F.from_json(shape["coordinates"], "array<array<array<array<double>>>>")
    return F.when(shape["type"] == "Polygon", one).when(shape["type"] == "MultiPolygon", many).otherwise(F.array().cast("array<array<array<array<double>>>>"))


def projected(lon: Column, lat: Column, lon0: float, lat0: float, scale: float) -> Column:
    """Equirectangular with the cosine of lat0, y downwards."""
    import math

    return F.struct(((lon - lon0) * (math.cos(math.radians(lat0)) * scale)).alias("x"), ((lat0 - lat) * scale).alias("y"))


def quantised(points: Column, step: float = 0.1) -> Column:
    """Points on a grid, without repeats of the point before."""
    grid = F.transform(points, lambda p: F.struct((F.round(p["x"] / step) * step).alias("x"), (F.round(p["y"] / step) * step).alias("y")))
    before = F.concat(F.array(F.lit(None).cast("struct<x:double,y:double>")), F.slice(grid, 1, F.greatest(F.size(grid) - 1, F.lit(0))))
    pairs = F.filter(F.zip_with(grid, before, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: ~z["p"].eqNullSafe(z["q"]))
    return F.transform(pairs, lambda z: z["p"])


def label_scale(s: Column) -> Column:
    return F.pow(F.lit(2.0), F.round(F.log2(s) * 3) / 3)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def simplified(points: Column, tolerance: float) -> Column:
    """Douglas-Peucker; the recursion is sequential, so it runs row by row in Arrow batches."""

    def keep(pts):
        if pts is None or len(pts) < 3:
            return pts
        kept, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
        while todo:
            a, b = todo.pop()
            ax, ay, dx, dy = pts[a]["x"], pts[a]["y"], pts[b]["x"] - pts[a]["x"], pts[b]["y"] - pts[a]["y"]
            norm, worst, at = dx * dx + dy * dy, tolerance, None
            for i in range(a + 1, b):
                t = max(0.0, min(1.0, ((pts[i]["x"] - ax) * dx + (pts[i]["y"] - ay) * dy) / norm)) if norm else 0.0
                d = ((pts[i]["x"] - ax - t * dx) ** 2 + (pts[i]["y"] - ay - t * dy) ** 2) ** 0.5
                if d > worst:
                    worst, at = d, i
            if at is not None:
                kept.add(at)
                todo += [(a, at), (at, b)]
        return [pts[i] for i in sorted(kept)]

    return F.udf(keep, "array<struct<x:double,y:double>>", useArrow=True)(points)


def clipped_ring(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Polygon clipping against a box, one side after the other."""

    def side(pts, inside, meet):
        out = []
        for i, q in enumerate(pts):
            p = pts[i - 1]
            if inside(p) != inside(q):
                out.append(meet(p, q))
            if inside(q):
                out.append(q)
        return out

    def at_x(x):
        return lambda p, q: (x, p[1] + (q[1] - p[1]) * (x - p[0]) / (q[0] - p[0]))

    def at_y(y):
        return lambda p, q: (p[0] + (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]), y)

    def clip(pts):
        if pts is None:
            return None
        out = [(p["x"], p["y"]) for p in pts]
        for inside, meet in ((lambda p: p[0] >= x0, at_x(x0)), (lambda p: p[0] <= x1, at_x(x1)), (lambda p: p[1] >= y0, at_y(y0)), (lambda p: p[1] <= y1, at_y(y1))):
            out = side(out, inside, meet) if out else out
        return [{"x": x, "y": y} for x, y in out]

    return F.udf(clip, "array<struct<x:double,y:double>>", useArrow=True)(ring)


def label_point(rings: Column, precision: float = 1e-3) -> Column:
    """struct<x,y>: the inner point (even-odd rule over all rings of three points or more) farthest from any edge, or null.

    Squares that cover the bounds are halved again and again: a square can't hold a point farther from the
    edges than its middle's signed distance plus half its diagonal, and goes when that can't beat the best
    point so far by more than ``precision`` of the larger side.
    """

    def find(given):
        import numpy as np

        rings = [np.array([(p["x"], p["y"]) for p in r], float) for r in given or [] if len(r) > 2]
        if not rings:
            return None
        a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
        low, high = a.min(axis=0), a.max(axis=0)
        edge = b - a
        long = np.maximum((edge**2).sum(axis=1), 1e-300)
        rising = np.where(edge[:, 1] == 0, 1.0, edge[:, 1])

        def signed(at):
            """Distance of each point to the nearest edge, negative outside."""
            d = at[:, None, :] - a
            along = np.clip((d * edge).sum(axis=2) / long, 0, 1)
            far = np.sqrt(((d - along[..., None] * edge) ** 2).sum(axis=2).min(axis=1))
            above = at[:, 1, None] < a[:, 1]
            cuts = (above != (at[:, 1, None] < b[:, 1])) & (d[..., 0] < edge[:, 0] * d[..., 1] / rising)
            return np.where(cuts.sum(axis=1) % 2 == 1, far, -far)

        long_side = float((high - low).max())
        side = max(float((high - low).min()), long_side / 64)
        if (high - low).min() <= 0:
            return None
        half = side / 2
        at = np.array([(x, y) for x in np.arange(low[0] + half, high[0] + half, side) for y in np.arange(low[1] + half, high[1] + half, side)])
        best_at, best = at[0], -np.inf
        while len(at):
            d = np.concatenate([signed(at[k : k + 4096]) for k in range(0, len(at), 4096)])
            k = int(d.argmax())
            if d[k] > best:
                best_at, best = at[k], float(d[k])
            at, half = at[d + half * 2**0.5 > max(best, 0) + precision * long_side], half / 2
            at = (at[:, None, :] + half * np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])).reshape(-1, 2)
        return {"x": float(best_at[0]), "y": float(best_at[1])} if best > 0 else None

    return F.udf(find, "struct<x:double,y:double>", useArrow=True)(rings)
