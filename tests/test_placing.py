"""Spatial joins, archives and collation against brute force."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from lectern.operators import spatial, study
from lectern.sources import archives
from lectern.tables import scratch


def inside(x, y, ring):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def shapes(seed):
    rng = random.Random(seed)
    points = [(i, float(rng.randrange(-40, 40)), rng.uniform(-40, 40)) for i in range(300)] + [(900, None, 1.0), (901, 0.0, 0.0)]
    rings = []
    for k in range(40):
        cx, cy, size = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([0.01, 1, 5, 60])
        rings.append((k, [(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(rng.randrange(3, 9))]))
    rings += [(97, []), (98, [(0.0, 0.0), (1.0, 1.0)]), (99, [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)])]
    return points, rings


def tables(spark, points, rings):
    p = spark.createDataFrame(points, "id int, x double, y double").repartition(3)
    r = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in rings], "k int, ring array<struct<x:double,y:double>>").repartition(2)
    return p, r


def test_points_and_rings_equal_all_pairs(spark):
    points, rings = shapes(1)
    found = spatial.points_in_rings(*tables(spark, points, rings), salts=3)
    assert found.columns == ["id", "x", "y", "k", "ring"]
    got = [(r["id"], r["k"]) for r in found.collect()]
    assert sorted(got) == sorted((i, k) for i, x, y in points if x is not None for k, ring in rings if len(ring) >= 3 and inside(x, y, ring)) and len(got) > 200


def test_boxes_and_rings(spark):
    rng = random.Random(2)
    _, rings = shapes(2)
    boxes = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([0.0, 0.5, 9.0, 100.0])) for i in range(80)]
    b = spark.createDataFrame(boxes, "id int, x double, y double, w double").select("id", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("w") / 2).alias("y1")).alias("box"))
    b = b.unionByName(b.limit(1).select(F.lit(500).alias("id"), F.lit(None).cast(b.schema["box"].dataType).alias("box")))

    def meets(x, y, w, ring):
        """Cut each edge by the box (parametric clipping)."""
        x1, y1 = x + w, y + w / 2
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            low, high = 0.0, 1.0
            for d, a, lo, hi in ((bx - ax, ax, x, x1), (by - ay, ay, y, y1)):
                if d == 0:
                    if not lo <= a <= hi:
                        low, high = 1.0, 0.0
                else:
                    s, t = sorted(((lo - a) / d, (hi - a) / d))
                    low, high = max(low, s), min(high, t)
            if low <= high:
                return True
        return inside(x, y, ring)

    got = sorted((r["id"], r["k"]) for r in spatial.boxes_on_rings(b, tables(spark, [(0, 0.0, 0.0)], rings)[1], salts=2).collect())
    want = sorted((i, k) for i, x, y, w in boxes for k, ring in rings if len(ring) >= 3 and meets(x, y, w, ring))
    assert got == want


def test_empty_sides(spark):
    points, rings = shapes(3)
    p, r = tables(spark, points, rings)
    assert spatial.points_in_rings(p.limit(0), r).count() == 0 and spatial.points_in_rings(p, r.limit(0)).count() == 0


def test_archives_with_broken_members(spark, tmp_path):
    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    (tmp_path / "good.zip").write_bytes(packed([("a.txt", b"one"), ("b/c.txt", b"two" * 5000), ("b/", b"")]))
    (tmp_path / "bad.zip").write_bytes(packed([("a.txt", b"first member"), ("z.txt", b"untouched")]).replace(b"first member", b"FIRST member", 1))
    (tmp_path / "none.zip").write_bytes(b"this is no archive")
    (tmp_path / "other.txt").write_bytes(b"not read")
    for share in (1 << 20, 100):
        rows = {(r["archive"].split("/")[-1], r["member"]): (r["size"], r["content"] and bytes(r["content"]), r["problem"]) for r in archives.zip_members(spark, str(tmp_path), share_bytes=share).collect()}
        assert rows["good.zip", "a.txt"] == (3, b"one", None) and rows["good.zip", "b/c.txt"] == (15000, b"two" * 5000, None)
        assert rows["bad.zip", "z.txt"] == (9, b"untouched", None)
        assert rows["bad.zip", "a.txt"][1] is None and "broken member" in rows["bad.zip", "a.txt"][2]
        assert rows["none.zip", None][2].startswith("no archive") and len(rows) == 5
    assert {r["archive"].split("/")[-1] for r in archives.zip_members(spark, str(tmp_path), member="z.txt").where("problem is null").collect()} == {"bad.zip"}
    assert archives.zip_members(spark, str(tmp_path), share_bytes=100).rdd.getNumPartitions() > 100
    empty = scratch(spark)
    spark.createDataFrame([("x",)], "t string").write.text(empty)
    assert archives.zip_members(spark, empty).count() == 0


def test_titles_by_base_letters_and_numbers(spark):
    titles = [(1, "Title 10"), (2, "title 9"), (3, "TITLE 009"), (4, "Éa"), (5, "ea"), (6, "EB"), (7, None), (8, ""), (9, "Title 9a"), (10, "title 123456789012345678901234567890"), (11, "title 23456789012345678901234567890")]
    df = spark.createDataFrame(titles, "id int, t string").repartition(3)
    got = [r["id"] for r in study.collated_places(df, "t", "id").orderBy("place").collect()]
    assert got == [7, 8, 4, 5, 6, 2, 3, 9, 1, 11, 10]


def test_label_points_computes_equal_shapes_once(spark):
    made = spark.sparkContext.accumulator(0)
    find = spatial.geo.label_point

    def counted(rings, precision):
        one = F.udf(lambda r: made.add(1) or r, "array<array<struct<x:double,y:double>>>")
        return find(one(rings), precision)

    ring = lambda n: [[(0.0, 0.0), (n, 0.0), (n, n), (0.0, n)]]
    rows = [(i, ring(float(i % 3 + 1))) for i in range(60)] + [(60, None), (61, []), (62, [[(0.0, 0.0)]])]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    spatial.geo.label_point = counted
    try:
        got = {r["id"]: r["point"] and tuple(r["point"]) for r in spatial.label_points(df).collect()}
    finally:
        spatial.geo.label_point = find
    assert got == {i: ((i % 3 + 1) / 2,) * 2 if i < 60 else None for i in range(63)}
    assert made.value == 5


def test_archives_of_small_members_have_few_shares(spark, tmp_path):
    """Every share reads the list of all members, so with a share for each few bytes that work would grow with the square."""
    for n in (500, 4000):
        (tmp_path / str(n)).mkdir()
        with zipfile.ZipFile(tmp_path / str(n) / "a.zip", "w") as z:
            for k in range(n):
                z.writestr(f"m{k}", str(k))
        found = archives.zip_members(spark, str(tmp_path / str(n)), share_bytes=4096)
        assert 1 < found.rdd.getNumPartitions() <= 16
        assert {(r["member"], bytes(r["content"])) for r in found.collect()} == {(f"m{k}", str(k).encode()) for k in range(n)}


def test_sums_in_rings_equal_all_pairs(spark):
    """Over strips, parts of strips and shares of rings, with copies of points, flat edges, corners on points and odd coordinates."""
    points, rings = shapes(4)
    points += [(1000 + i, float(i % 7), float(i % 5)) for i in range(200)] + [(2000, float("nan"), 0.0), (2001, 0.0, float("inf"))]
    rings += [(200 + i, [(float(i), 0.0), (float(i + 4), 0.0), (float(i + 4), 3.0), (float(i), float(3 - i % 2))]) for i in range(5)] + [(300, [(0.0, 0.0), (9.0, float("nan")), (9.0, 9.0)]), (301, [(0.0, 0.0), (None, 4.0), (9.0, 9.0), (0.0, 9.0)])]
    p, r = tables(spark, points, rings)
    pairs = p.where("x IS NOT NULL AND y IS NOT NULL").crossJoin(r.where("size(ring) >= 3")).where(spatial.geo.in_ring(F.col("x"), F.col("y"), F.col("ring")))
    want = {row["k"]: (row["n"], row["total"]) for row in pairs.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("id"), 6).cast("double").alias("total")).collect()}
    assert {300, 301} <= set(want) and len(want) > 20
    for most, shared in ((1 << 17, 1 << 15), (40, 7), (5, 1000)):
        got = {row["k"]: (row["n"], row["total"]) for row in spatial.sums_in_rings(p, r, "k", "id", most=most, shared=shared).collect()}
        assert got == want
    assert spatial.sums_in_rings(p.limit(0), r, "k", "id").count() == 0 and spatial.sums_in_rings(p, r.limit(0), "k", "id").count() == 0


def met_by_pairs(left, right):
    """{k: (n, last)} by comparing all pairs; bounds are ordered as in SQL, NaN above all else."""
    up = lambda a, b: b != b or (a == a and a <= b)
    out = {}
    for k, a in left:
        held = [v for v, b in right if None not in a and None not in b and all(up(s[c], s[c + 2]) for s in (a, b) for c in (0, 1)) and all(up(s[c], t[c + 2]) for s, t in ((a, b), (b, a)) for c in (0, 1))]
        if held:
            out[k] = (len(held), max((v for v in held if v is not None), default=None))
    return out


def test_boxes_counted_equal_all_pairs(spark):
    """Boxes of all sizes, on a coarse lattice with frequent bounds, long thin ones, copies, and odd bounds."""
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")

    def some(first, many):
        rows = []
        for k in range(first, first + many):
            x, y, w, h = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.0, 0.1, 2.0, 20.0]), rng.choice([0.0, 0.1, 2.0, 20.0])
            if k % 3 == 0:
                x, y, w, h = float(rng.randrange(3)), float(rng.randrange(-9, 9)), float(rng.randrange(2)), float(rng.randrange(4))
            rows.append((k, (x, y, x + w, y + h)))
        rows += [(first + many + i, rows[0][1]) for i in range(5)]
        odd = [(0.0, 0.0, nan, 1.0), (nan, -1.0, nan, 1.0), (-inf, -1.0, inf, inf), (inf, 0.0, inf, 0.0), (None, 0.0, 1.0, 1.0), (3.0, 0.0, 1.0, 9.0), (-0.0, -0.0, 0.0, 0.0)]
        return rows + [(first + many + 5 + i, b) for i, b in enumerate(odd)]

    left, right = some(0, 150), some(-100, 200)
    right.append((None, (50.0, -51.0, 51.0, -50.0)))
    left.append((999, (50.5, -50.5, 50.5, -50.5)))
    kind = "box struct<x0:double,y0:double,x1:double,y1:double>"
    a, b = spark.createDataFrame(left, f"k int, {kind}").repartition(3), spark.createDataFrame(right, f"v long, {kind}").repartition(2)
    want = met_by_pairs(left, right)
    assert want[999] == (1, None) and len(want) > 140
    for cuts in (1, 3, 12):
        rows = spatial.boxes_counted(a, b, "v", cuts=cuts).collect()
        assert {r["k"]: (r["n"], r["last"]) for r in rows} == want and len(rows) == len(want)
    assert spatial.boxes_counted(a.limit(0), b, "v").count() == 0 and spatial.boxes_counted(a, b.limit(0), "v").count() == 0


def test_last_boxes_are_found_by_halving():
    """With no question left to the greatest numbers alone, the halves of the rest are counted."""
    import numpy as np

    rng = np.random.default_rng(6)
    for many in (1, 2, 3, 37, 64, 200):
        x, y = rng.uniform(0, 1, (2, many)), rng.uniform(0, 1, (2, many))
        boxes, n, last = [np.minimum(*x), np.minimum(*y), np.minimum(*x) + 0.1, np.minimum(*y) + 0.1], rng.integers(1, 4, many), rng.permutation(many) - 50
        meet = (boxes[0] <= boxes[2][:, None]) & (boxes[0][:, None] <= boxes[2]) & (boxes[1] <= boxes[3][:, None]) & (boxes[1][:, None] <= boxes[3])
        for few in (0, 1 << 13):
            total, most = spatial._counted_boxes([*boxes, n, last], boxes, few=few)
            assert (total == (meet * n).sum(1)).all() and (most == np.where(meet, last, spatial.LEAST).max(1)).all()


def test_boxes_met_makes_no_row_for_each_pair(spark, tmp_path):
    """3,000 vectors in two places, where all boxes meet: 4.5 million pairs."""
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-0.01, 0.01) + (i % 2 if k in (2, 3) else 0) for k in range(16)]) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    from lectern.plans import catalog, placing  # noqa: F401

    found = catalog.QUERIES["boxes_met"](spark, str(tmp_path))
    got = {r["vec_id"]: (r["meeting"], r["last"]) for r in found.collect()}
    assert got == {i: (1500, 2998 + i % 2) for i in range(3000)}

    def nodes(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return nodes(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return nodes(plan.plan())
        below = plan.children()
        return [plan] + [n for i in range(below.size()) for n in nodes(below.apply(i))]

    made = [n.metrics().get("numOutputRows") for n in nodes(found._jdf.queryExecution().executedPlan())]
    made = [m.get().value() for m in made if m.isDefined()]
    assert 3000 <= max(made) <= 60_000
