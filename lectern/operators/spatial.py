"""Spatial joins: shapes meet on the cells of grids that their bounds touch, then exact tests follow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geo

#: Grids have cells of a power of two; bounds smaller than the finest share its cells.
FINEST, COARSEST = -40, 60
#: Stands for no number.
LEAST = -(1 << 63)


def _level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The finest grid whose cells are no smaller than the bounds, which then touch four cells at most."""
    size = F.greatest(x1 - x0, y1 - y0)
    level = F.when(size > 0, F.ceil(F.log2(size))).otherwise(F.lit(FINEST)).cast("int")
    level = F.when(F.pow(F.lit(2.0), level.cast("double")) < size, level + 1).otherwise(level)  # a rounded logarithm
    return F.least(F.greatest(level, F.lit(FINEST)), F.lit(COARSEST))


def _cells(df: DataFrame, box: Column, levels: Column) -> DataFrame:
    """df with a row for each cell (level, cx, cy) that the box touches in the grids of its own level and the coarser ones of levels."""
    at = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level.cast("double")))
    own = df.withColumn("_b", box).withColumn("_own", _level(*[F.col(f"_b.{c}") for c in ("x0", "y0", "x1", "y1")]))
    grids = own.select("*", F.explode(F.filter(F.array_union(levels, F.array("_own")), lambda n: n >= F.col("_own"))).alias("level"))
    wide = grids.select("*", F.explode(F.sequence(at(F.col("_b.x0"), F.col("level")), at(F.col("_b.x1"), F.col("level")))).alias("cx"))
    return wide.select("*", F.explode(F.sequence(at(F.col("_b.y0"), F.col("level")), at(F.col("_b.y1"), F.col("level")))).alias("cy"))


def boxes_meeting(left: DataFrame, right: DataFrame, salts: int = 8) -> DataFrame:
    """Pairs of rows whose boxes (column ``box``: struct<x0,y0,x1,y1>) share a point, each once, with the columns of both sides.

    Columns of the two sides must differ but for box, which goes.  A pair meets in the coarser of the
    two grids that fit the boxes, in the cell of the lower corner of what they share.  Rows of the left side
    are dealt to salts copies of the right side's, so one cell may hold most of either.  Null boxes meet nothing.
    """
    used = left.select(F.col("box")).unionByName(right.select("box")).where("box IS NOT NULL")
    levels = sorted(r[0] for r in used.select(_level(*[F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("n")).distinct().collect())  # at most 101
    grids = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    a = _cells(left.where("box IS NOT NULL").withColumn("_row", F.struct(*[c for c in left.columns if c != "box"])).select("_row", "box"), F.col("box"), grids)
    b = _cells(right.where("box IS NOT NULL").withColumn("_row", F.struct(*[c for c in right.columns if c != "box"])).select("_row", "box"), F.col("box"), grids)
    a = a.select(F.col("_row").alias("_l"), F.col("_b").alias("_lb"), F.col("_own").alias("_ll"), "level", "cx", "cy", F.pmod(F.xxhash64("_row"), F.lit(salts)).alias("_salt"))
    b = b.select(F.col("_row").alias("_r"), F.col("_b").alias("_rb"), F.col("_own").alias("_rl"), "level", "cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    size = F.pow(F.lit(2.0), F.col("level").cast("double"))
    low = lambda c: F.floor(F.greatest(F.col(f"_lb.{c}"), F.col(f"_rb.{c}")) / size)
    share = (F.col("_lb.x0") <= F.col("_rb.x1")) & (F.col("_rb.x0") <= F.col("_lb.x1")) & (F.col("_lb.y0") <= F.col("_rb.y1")) & (F.col("_rb.y0") <= F.col("_lb.y1"))
    met = a.join(b, ["level", "cx", "cy", "_salt"]).where((F.col("level") == F.greatest("_ll", "_rl")) & share & (F.col("cx") == low("x0")) & (F.col("cy") == low("y0")))
    return met.select("_l.*", "_r.*")


def points_in_rings(points: DataFrame, rings: DataFrame, x: str = "x", y: str = "y", ring: str = "ring", salts: int = 8) -> DataFrame:
    """Rows of points with the rows of rings (array<struct<x,y>>) that hold them by the even-odd rule.

    Points without a coordinate and rings of fewer than three points hold or meet nothing.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("box", F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1")))
    areas = rings.where(F.size(ring) >= 3).withColumn("box", geo.bounds(F.col(ring)))
    return boxes_meeting(spots, areas, salts).where(geo.in_ring(F.col(x), F.col(y), F.col(ring)))


def _expanded(starts, lengths, block: int = 1 << 20):
    """Blocks of (index, place) of the places starts[i] to starts[i] + lengths[i]."""
    import numpy as np

    ends = np.cumsum(lengths)
    for a in range(0, int(ends[-1]) if len(ends) else 0, block):
        flat = np.arange(a, min(a + block, int(ends[-1])))
        i = np.searchsorted(ends, flat, "right")
        yield i, starts[i] + flat - (ends[i] - lengths[i])


def _sums_in_tile(spots, areas):
    """Arrow table of (key, n, total): what the points of a tile (x, y, n, v) add up to in each ring (key, ring).

    Points lie in bands of y, sorted by x.  Inside a band only points level with an edge are tested one by one; no edge comes between
    those from one such stretch to the next, so the first of them is tested for all, and running sums tell the rest.  Tests
    and ends of stretches use the arithmetic of geo.in_ring, whose crossing never turns back as y rises.
    """
    import numpy as np
    import pyarrow as pa

    kept = areas["ring"].combine_chunks()
    size, corners = np.asarray(kept.value_lengths()), kept.flatten()
    px, py = (np.asarray(corners.field(c)) for c in ("x", "y"))
    x, y, n, v = (np.asarray(spots[c].combine_chunks()) for c in ("x", "y", "n", "v"))
    many, rings = len(x), len(size)
    out_n, out_v = np.zeros(rings, np.int64), np.zeros(rings)
    bands = max(1, math.isqrt(many))
    band = np.empty(many, np.int64)
    band[np.argsort(y, kind="stable")] = np.arange(many) * bands // many
    order = np.lexsort((x, band))
    x, y, n, v, band = x[order], y[order], n[order], v[order], band[order]
    begin = np.searchsorted(band, np.arange(bands))
    low, high = np.minimum.reduceat(y, begin), np.maximum.reduceat(y, begin)
    xs = np.sort(x)
    places = band * (many + 1) + np.searchsorted(xs, x)
    sum_n, sum_v = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(v, dtype=np.longdouble)])
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(rings), size)
    after = np.arange(len(px)) + 1
    after[first + size - 1] = first
    qx, qy = px[after], py[after]
    rise = np.where(qy != py, qy - py, 1.0)
    bottom, top = np.minimum(py, qy), np.maximum(py, qy)
    from_band = np.searchsorted(high, bottom)
    n_bands = np.maximum(np.searchsorted(low, top, "right") - from_band, 0)
    crossing = lambda e, at: (qx[e] - px[e]) * (at - py[e]) / rise[e] + px[e]

    def add(ring, start, end):
        """Add the runs of points from start to end to their rings if their first point is inside."""
        inside = np.zeros(len(ring), bool)
        at_x, at_y = x[start], y[start]
        for k in range(int(size[ring].max()) if len(ring) else 0):
            e = first[ring] + np.minimum(k, size[ring] - 1)
            inside ^= (k < size[ring]) & ((py[e] > at_y) != (qy[e] > at_y)) & (at_x < crossing(e, at_y))
        ring, start, end = ring[inside], start[inside], end[inside]
        np.add.at(out_n, ring, sum_n[end] - sum_n[start])
        np.add.at(out_v, ring, (sum_v[end] - sum_v[start]).astype(float))

    load = np.add.reduceat(n_bands, first) if rings else n_bands
    share = np.cumsum(load) // (1 << 19)
    for some in np.split(np.arange(rings), np.flatnonzero(np.diff(share)) + 1):
        if not len(some):
            continue
        edges = np.arange(first[some[0]], first[some[-1]] + size[some[-1]])
        e = np.repeat(edges, n_bands[edges])
        if not len(e):
            continue
        b = from_band[e] + np.arange(len(e)) - np.repeat(np.cumsum(n_bands[edges]) - n_bands[edges], n_bands[edges])
        one, two = crossing(e, np.maximum(low[b], bottom[e])), crossing(e, np.minimum(high[b], top[e]))
        left, right = np.minimum(one, two), np.maximum(one, two)
        for cx, cy in ((px[e], py[e]), (qx[e], qy[e])):
            held = (low[b] <= cy) & (cy <= high[b])
            left, right = np.where(held, np.minimum(left, cx), left), np.where(held, np.maximum(right, cx), right)
        start = np.searchsorted(places, b * (many + 1) + np.searchsorted(xs, left))
        end = np.searchsorted(places, b * (many + 1) + np.searchsorted(xs, right, "right"))
        group = (of[e] - some[0]) * bands + b
        order = np.argsort(group * (many + 1) + start)
        group, ring, start, end = group[order], of[e][order], start[order], end[order]
        reach = np.maximum.accumulate(group * (many + 1) + end)
        before = start.copy()
        before[1:] = np.where(group[1:] == group[:-1], reach[:-1] - group[1:] * (many + 1), start[1:])
        gap = before < start
        add(ring[gap], before[gap], start[gap])
        level = np.maximum(start, before)
        for i, place in _expanded(level, np.maximum(end - level, 0)):
            add(ring[i], place, place + 1)
    met = out_n > 0
    return pa.table({"key": areas["key"].combine_chunks().filter(pa.array(met)), "n": out_n[met], "total": out_v[met]})


def _ordinary(v: Column) -> Column:
    return F.coalesce(F.abs(v) < 1e150, F.lit(False))


def sums_in_rings(points: DataFrame, rings: DataFrame, key: str, value: str, x: str = "x", y: str = "y", ring: str = "ring", most: int = 1 << 17, shared: int = 1 << 15) -> DataFrame:
    """(key, n, total): how many points each ring holds by the even-odd rule, and the sum of their column value, without a row for each pair.

    Rings that hold none have no row.  Equal points count as one with its number.  Points lie in strips of x with about ``most`` of them, strips with twice as many
    are dealt again; a strip goes, once for each ``shared`` rings that touch it, to tasks that count as _sums_in_tile does.
    Rings with a corner that is null or not finite meet the points one by one.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    all_spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("v"))
    spots = all_spots.where(_ordinary(F.col("x")) & _ordinary(F.col("y"))).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n", F.coalesce("v", F.lit(0.0)).alias("v"))
    fine = F.coalesce(F.forall(ring, lambda p: _ordinary(p["x"]) & _ordinary(p["y"])), F.lit(False))
    areas = rings.where(F.size(ring) >= 3).select(F.col(key).alias("key"), F.col(ring).cast("array<struct<x:double,y:double>>").alias("ring"), fine.alias("fine"))

    strips = math.ceil(spots.count() / most)
    cuts = sorted(set(spots.approxQuantile("x", [i / strips for i in range(1, strips)], 0.1 / strips))) if strips > 1 else []
    known = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    strip = lambda v: F.size(F.filter(known, lambda c: c <= v))
    box = geo.bounds(F.col("ring"))
    areas_met = areas.where("fine").select("key", "ring", F.explode(F.sequence(strip(box["x0"]), strip(box["x1"]))).alias("strip"))
    spots = spots.withColumn("strip", strip(F.col("x")))
    parts = {s: math.ceil(c / (2 * most)) for s, c in spots.groupBy("strip").count().collect()}  # a row a strip
    asked = dict(areas_met.groupBy("strip").count().collect())
    shared = min(shared, max(1 << 11, sum(asked.values()) // (4 * cores)))
    per_strip = lambda number: F.element_at(F.array(*[F.lit(max(1, number(s))) for s in range(len(cuts) + 1)]), F.col("strip") + 1)
    n_parts, n_shares = per_strip(lambda s: parts.get(s, 1)), per_strip(lambda s: math.ceil(asked.get(s, 0) / shared))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = spots.select("x", "y", "n", "v", "strip", F.pmod(F.xxhash64("x", "y"), n_parts).cast("int").alias("part"), upto(n_shares).alias("share"))
    b = areas_met.select("key", "ring", "strip", upto(n_parts).alias("part"), F.pmod(F.xxhash64("ring"), n_shares).cast("int").alias("share"))
    tile = ["strip", "part", "share"]
    tasks = max(cores, min(32 * cores, sum(parts.get(s, 1) * math.ceil(c / shared) for s, c in asked.items())))
    kind = areas.schema["key"].dataType.simpleString()
    empty = f"key {kind}, n long, total double"
    tiled = a.repartition(tasks, *tile).groupBy(*tile).cogroup(b.repartition(tasks, *tile).groupBy(*tile)).applyInArrow(lambda p, r: _sums_in_tile(p, r) if len(p) and len(r) else _no_sums(r), empty)
    odd = all_spots.join(areas.where("NOT fine"), geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("total"))
    return tiled.unionByName(odd).groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _no_sums(areas):
    import pyarrow as pa

    return pa.table({"key": areas["key"].slice(0, 0), "n": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})


def _sums_below(group, u, v, n, ask, most_u, most_v):
    """For each question, the sum of n over the points of group ask whose ranks u and v lie below most_u and most_v.

    u and v are permutations.  A wavelet matrix: points in the order of group and u are split by the bits of v, the highest first.
    """
    import numpy as np

    size = len(u)
    order = np.lexsort((u, group))
    key = group[order] * (size + 1) + u[order]
    start, end = np.searchsorted(key, ask * (size + 1)), np.searchsorted(key, ask * (size + 1) + most_u)
    v, n, out = v[order], n[order], np.zeros(len(start), np.int64)
    for bit in reversed(range(size.bit_length())):
        zero = (v >> bit & 1) == 0
        places, sums = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(n * zero)])
        up = (most_v >> bit & 1) == 1
        out += np.where(up, sums[end] - sums[start], 0)
        start, end = (np.where(up, places[-1] + at - places[at], places[at]) for at in (start, end))
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        v, n = v[order], n[order]
    return out


def _counted_boxes(boxes, asked, few: int = 1 << 13):
    """(n, last) for each box of asked (x0, y0, x1, y1): the sum of n and the greatest last of the boxes (those four, n, last) that share a point with it.

    Of all that begin below an upper bound those are taken off that end below the lower one, which needs no pairs.  The last ones are looked for among
    the greatest; if these leave more than a few questions open, such counts halve the rest for them again and again.
    """
    import numpy as np

    order = np.argsort(boxes[5], kind="stable")
    boxes, size, many = [c[order] for c in boxes], len(order), len(asked[0])
    total, last = np.zeros(many, np.int64), np.full(many, LEAST)
    if not size or not many:
        return total, last
    ranks, below = {}, {}
    for name, mine, theirs, side in (("x0", 0, 2, "right"), ("x1", 2, 0, "left"), ("y0", 1, 3, "right"), ("y1", 3, 1, "left")):
        by = np.argsort(boxes[mine], kind="stable")
        ranks[name] = np.empty(size, np.int64)
        ranks[name][by] = np.arange(size)
        below[name] = np.searchsorted(boxes[mine][by], asked[theirs], side)

    def counts(group, ask, some):
        signed = ((x, y, (1 if x == "x0" else -1) * (1 if y == "y0" else -1)) for x in ("x0", "x1") for y in ("y0", "y1"))
        return sum(sign * _sums_below(group, ranks[x], ranks[y], boxes[4], ask, below[x][some], below[y][some]) for x, y, sign in signed)

    total[:] = counts(np.zeros(size, np.int64), np.zeros(many, np.int64), np.arange(many))
    todo, upto = np.flatnonzero(total > 0), size
    while len(todo) and upto:
        start = max(0, upto - max(1, (1 << 20) // len(todo)))
        level = lambda c: (ranks[c][start:upto], below[c][todo, None])  # noqa: E731, B023
        meet = np.less(*level("x0")) & np.less(*level("y0")) & np.greater_equal(*level("x1")) & np.greater_equal(*level("y1"))
        found = meet.any(1)
        last[todo[found]] = boxes[5][upto - 1 - np.argmax(meet[found, ::-1], 1)]
        slow = 2 * found.sum() < len(found)
        todo, upto = todo[~found], start
        if slow and len(todo) > few:
            break
    else:
        return total, last
    at, half = np.zeros(len(todo), np.int64), 1 << max(0, (upto - 1).bit_length() - 1)
    place = np.arange(size)
    while half:
        upper = at + half
        held = np.flatnonzero(upper < upto)
        group = np.where(place < upto, place // half, size)
        met = counts(group, upper[held] // half, todo[held]) > 0
        at[held[met]] = upper[held[met]]
        half //= 2
    last[todo] = boxes[5][at]
    return total, last


def _strip_counts(boxes, asked):
    """Arrow table (x0, y0, x1, y1, n, last) of the boxes asked of one strip, counting those pairs that share a point and no other strip tells apart."""
    import numpy as np
    import pyarrow as pa

    bounds = ["x0", "y0", "x1", "y1"]
    if not len(boxes) or not len(asked):
        return _no_counts(bounds, pa.float64())
    b, q = ({c: t[c].to_numpy() for c in t.column_names} for t in (boxes, asked))
    corners = ["bx0", "by0", "bx1", "by1"]
    total, last = np.zeros(len(asked), np.int64), np.full(len(asked), LEAST)
    turned = q["bx0"] > q["bx1"]
    for mine, theirs in ((b["lower"], q["upper"]), (b["upper"] & ~b["lower"], q["lower"]), (b["upper"] & b["lower"], q["lower"] & ~q["upper"])):
        for some, these in ((mine & ~b["flat"], theirs), (mine & b["flat"], theirs & ~turned)):
            n, most = _counted_boxes([b[c][some] for c in (*corners, "n", "last")], [q[c][these] for c in corners])
            total[these] += n
            last[these] = np.maximum(last[these], most)
    met = pa.array(total > 0)
    return pa.table({c: asked[c].combine_chunks() for c in bounds} | {"n": total, "last": last}).filter(met)


def _no_counts(keys, kind):
    import pyarrow as pa

    return pa.table({c: pa.array([], kind) for c in keys} | {c: pa.array([], pa.int64()) for c in ("n", "last")})


def _cell_counts(cells, asked, side: int):
    """Arrow table (qx0, qy0, qx1, qy1, n, last): the cells (ax0, ay0, ax1, ay1, n, last) that begin at the upper places asked or below and end at the lower ones or above."""
    import numpy as np
    import pyarrow as pa

    if not len(cells) or not len(asked):
        return _no_counts(["qx0", "qy0", "qx1", "qy1"], pa.int32())
    at = lambda t, p: tuple(side - 1 - t[p + c].to_numpy() if c[1] == "1" else t[p + c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
    n, last = np.zeros((side,) * 4, np.int64), np.full((side,) * 4, LEAST)
    n[at(cells, "a")], last[at(cells, "a")] = cells["n"].to_numpy(), cells["last"].to_numpy()
    for axis in range(4):
        n, last = np.cumsum(n, axis), np.maximum.accumulate(last, axis)
    x0, y0, x1, y1 = (asked[c].to_numpy() for c in ("qx0", "qy0", "qx1", "qy1"))
    held = (x1 >= 0) & (y1 >= 0) & (x0 < side) & (y0 < side)
    some = (x1[held], y1[held], side - 1 - x0[held], side - 1 - y0[held])
    out = asked.select(["qx0", "qy0", "qx1", "qy1"]).filter(pa.array(held))
    return out.append_column("n", pa.array(n[some])).append_column("last", pa.array(last[some])).filter(pa.array(n[some] > 0))


def boxes_counted(left: DataFrame, right: DataFrame, value: str, cuts: int = 12) -> DataFrame:
    """Rows of left whose box shares a point with boxes of right, with n, how many those are, and last, the greatest of their whole numbers value, without a row for each pair.

    Boxes (column ``box``) are as for boxes_meeting; those with a null bound or one below its opposite meet nothing.  Equal boxes count as one with its number.  Cuts
    split each axis into strips of like many bounds; a cut is a strip of its own, so that one frequent bound is no long strip.  Two boxes are told apart on
    an axis by strips alone unless one begins in the strip where the other ends.  Pairs told apart on both axes are counted by cells of
    four strips, (2 * cuts + 1)**4 at most, others in the strip of x, or else of y, that does not tell them apart, which two bounds of a box send it to.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    bounds = ["x0", "y0", "x1", "y1"]
    flat = lambda df, *more: df.select(*[F.col(f"box.{c}").cast("double").alias(c) for c in bounds], *more).where("x0 <= x1 AND y0 <= y1")
    boxes = flat(right, F.col(value).cast("long").alias("v")).groupBy(*bounds).agg(F.count("*").alias("n"), F.coalesce(F.max("v"), F.lit(LEAST)).alias("last"))
    asked = flat(left).distinct()

    both = flat(left).unionByName(flat(right)).select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("p.*")
    chosen = both.approxQuantile(["x", "y"], [i / (cuts + 1) for i in range(1, cuts + 1)], 0.1 / cuts)
    known = {axis: F.array(*[F.lit(c) for c in sorted(set(found))]).cast("array<double>") for axis, found in zip("xy", chosen, strict=True)}
    place = lambda c: (F.size(F.filter(known[c[0]], lambda k: k < F.col(c))) + F.size(F.filter(known[c[0]], lambda k: k <= F.col(c)))).cast("int")
    between = lambda c: F.pmod(F.col(c), F.lit(2)) == 0
    boxes = boxes.select("*", *[place(c).alias("a" + c) for c in bounds])
    asked = asked.select("*", *[place(c).alias("a" + c) for c in bounds])
    inner = [F.when(between("a" + c), F.col("a" + c) + (1 if c[1] == "0" else -1)).otherwise(F.col("a" + c)).alias("q" + c) for c in bounds]
    asked = asked.select("*", *inner)

    def dealt(df: DataFrame, coded: str, *more: str) -> DataFrame:
        """df with a row for each strip between cuts where a bound lies; on the axis y the places coded stand for x."""
        at = F.explode(F.array_distinct(F.array(*[F.struct(F.lit(c[0]).alias("axis"), F.col("a" + c).alias("strip")) for c in bounds])))
        rows = df.select("*", at.alias("at")).where("at.strip % 2 = 0")
        on_x = F.col("at.axis") == "x"
        here = lambda k: (F.when(on_x, F.col("ax" + k)).otherwise(F.col("ay" + k)) == F.col("at.strip"))
        seen = [F.when(on_x, F.col(c)).otherwise(F.col(coded + c).cast("double")).alias("b" + c) for c in ("x0", "x1")]
        return rows.select("at.*", here("0").alias("lower"), here("1").alias("upper"), *seen, F.col("y0").alias("by0"), F.col("y1").alias("by1"), (~on_x & (F.col("ax0") == F.col("ax1"))).alias("flat"), *more)

    strip = ["axis", "strip"]
    a = dealt(boxes, "a", "n", "last").repartition(8 * cores, *strip).groupBy(*strip)
    b = dealt(asked, "q", *bounds).drop("flat").repartition(8 * cores, *strip).groupBy(*strip)
    in_strips = a.cogroup(b).applyInArrow(_strip_counts, ", ".join(f"{c} double" for c in bounds) + ", n long, last long")

    side, one = 2 * cuts + 1, F.lit(0).alias("one")
    cells = boxes.groupBy(*["a" + c for c in bounds]).agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("*", one).groupBy("one")
    places = ["q" + c for c in bounds]
    wanted = asked.select(*places).distinct().select("*", one).groupBy("one")
    in_cells = cells.cogroup(wanted).applyInArrow(lambda c, q: _cell_counts(c, q, side), ", ".join(f"{c} int" for c in places) + ", n long, last long")
    found = in_strips.unionByName(asked.join(in_cells, places).select(*bounds, "n", "last")).groupBy(*bounds).agg(F.sum("n").alias("n"), F.nullif(F.max("last"), F.lit(LEAST)).alias("last"))
    met = found.select(F.struct(*bounds).alias("_met"), "n", "last")
    rows = left.withColumn("_box", F.struct(*[F.col(f"box.{c}").cast("double").alias(c) for c in bounds]))
    return rows.join(met, F.col("_box") == F.col("_met")).drop("_box", "_met", "box")


def _side(p: Column, q: Column, x: Column, y: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))


def box_meets_ring(box: Column, ring: Column) -> Column:
    """Whether a box and the area of a ring share a point: an edge enters the box, or the box lies inside the ring."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def enters(p: Column, q: Column) -> Column:
        apart = (F.greatest(p["x"], q["x"]) < box["x0"]) | (F.least(p["x"], q["x"]) > box["x1"]) | (F.greatest(p["y"], q["y"]) < box["y0"]) | (F.least(p["y"], q["y"]) > box["y1"])
        corners = [_side(p, q, box[a], box[b]) for a in ("x0", "x1") for b in ("y0", "y1")]
        beside = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
        return ~apart & ~beside

    return F.exists(F.zip_with(ring, shifted, enters), lambda e: e) | geo.in_ring(box["x0"], box["y0"], ring)


def boxes_on_rings(boxes: DataFrame, rings: DataFrame, ring: str = "ring", salts: int = 8) -> DataFrame:
    """Rows of boxes (column ``box``) with the rings that share a point with them; the box comes back as ``shown``."""
    areas = rings.where(F.size(ring) >= 3).withColumn("box", geo.bounds(F.col(ring)))
    return boxes_meeting(boxes.withColumn("shown", F.col("box")), areas, salts).where(box_meets_ring(F.col("shown"), F.col(ring)))


def label_points(shapes: DataFrame, rings: str = "rings", name: str = "point", precision: float = 1e-3) -> DataFrame:
    """shapes with geo.label_point of the column rings (array<array<struct<x,y>>>).

    Equal shapes are computed once, and the distinct ones are dealt to all cores, however few files hold them.
    """
    tasks = 4 * shapes.sparkSession.sparkContext.defaultParallelism
    distinct = shapes.select(F.col(rings).alias("_rings")).where(F.col(rings).isNotNull()).distinct().repartition(tasks, "_rings")
    found = distinct.withColumn(name, geo.label_point(F.col("_rings"), precision))
    return shapes.join(found, F.col(rings) == F.col("_rings"), "left").drop("_rings")
