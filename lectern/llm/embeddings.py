"""Operator 1: near-duplicate embeddings by quantised tile products with error bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_rows, components, merge_labels, saved


def _unit(v):
    """Rows of norm 1, in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    import numpy as np

    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _quantised(unit):
    """Int8 steps of unit rows, the step sizes, and the norm of what rounding left out."""
    import numpy as np

    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / step).astype(np.int8)
    return q, step[:, 0], np.linalg.norm(unit - step * q, axis=1)


def _products(a, b, threshold: float, same: bool, block: int = 1024):
    """(rows, columns, open) of index pairs whose cosine may reach the threshold; not open: it surely does.

    a, b: (int8 rows, steps, norms left out).  The cosine differs from the product of the Int8 rows, times their
    steps, by e_a(1 + e_b) + e_b(1 + e_a) + e_a e_b at most, e being the norms left out.  Int8 products
    are whole numbers, which float32 sums hold exactly up to 1,040 dimensions (wider rows: float64).
    """
    import numpy as np

    (qa, sa, ea), (qb, sb, eb) = a, b
    exact = np.float32 if qa.shape[1] <= 1040 else np.float64
    for s in range(0, len(qa), block):
        i = slice(s, s + block)
        rows = qa[i].astype(exact)
        for t in range(s if same else 0, len(qb), block):
            j = slice(t, t + block)
            near = (rows @ qb[j].astype(exact).T) * (sa[i, None] * sb[None, j])  # the same for (a, b) as for (b, a)
            bound = ea[i, None] * (1 + eb[None, j]) + eb[None, j] * (1 + ea[i, None]) + ea[i, None] * eb[None, j] + 1e-9
            possible = near >= threshold - bound
            if same and s == t:
                possible &= np.tri(len(near), k=-1, dtype=bool).T
            r, c = np.nonzero(possible)
            if len(r):
                yield s + r, t + c, near[r, c] < threshold + bound[r, c]


def _sides(lists):
    """rid, m and the quantised rows of each side of a tile pair."""
    import numpy as np

    out = []
    for side in lists:
        rows = side.values
        q = np.frombuffer(b"".join(rows.field("q").to_pylist()), np.int8).reshape(len(rows), -1)
        out.append((rows.field("rid").to_numpy(), rows.field("m").to_numpy(), (q, rows.field("step").to_numpy(), rows.field("left").to_numpy())))
    return out


def _linked(rid, m, pairs):
    """Of index pairs: (rid, how many vectors it links with, the rid that stands for what it links with)."""
    import numpy as np

    found, labels = np.zeros(len(rid), np.int64), np.arange(len(rid))
    for r, c in pairs:
        np.add.at(found, r, m[c])
        np.add.at(found, c, m[r])
        labels = merge_labels(labels, r, c)
    hit = np.nonzero(found)[0]
    return rid[hit], found[hit], rid[labels[hit]]


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, tile: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine reaches the threshold.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
    do vectors of unlike length.  Equal vectors of a label are collapsed first and count as links of
    each other.  A repeated vec_id is a row of its own; a null vec_id is never a component_id unless
    its component has no other.  An empty table gives an empty result; other columns are ignored.

    Vectors are quantised once; tiles of Int8 bytes (with a step and an error for each row) meet each other tile of
    their label.  Pairs that the bounds decide need nothing more.  Of rows in pairs that they leave open the full vectors
    go to that pair of tiles, and those pairs are computed in double precision.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    fine = F.coalesce(
        F.col("label").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    given = given.withColumn("fine", fine)
    usable = given.where("fine")
    distinct = usable.groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("first")).withColumn("rid", F.monotonically_increasing_id())

    def quantise(batches):
        import numpy as np

        for batch in batches:
            v = batch.column("v")
            ends = np.cumsum([0, *(len(x) for x in v)])
            flat, qs, steps, lefts = np.asarray(v.flatten()), [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                q, step, left = _quantised(_unit(flat[None, a:b]))
                qs.append(q.tobytes())
                steps.append(step[0])
                lefts.append(left[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(qs, pa.binary()), pa.array(steps, pa.float64()), pa.array(lefts, pa.float64())], names=[*batch.schema.names, "q", "step", "left"])

    schema = T.StructType([*distinct.schema.fields, T.StructField("q", T.BinaryType()), T.StructField("step", T.DoubleType()), T.StructField("left", T.DoubleType())])
    reps = saved(distinct.mapInArrow(quantise, schema))
    sized = reps.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / tile).cast("int").alias("nt"))
    dealt = reps.select("label", F.size("v").alias("dim"), "rid", "m", "q", "step", "left").join(sized, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("rid"), F.col("nt")).cast("int"))
    tiles = dealt.groupBy("label", "dim", "nt", "t").agg(F.collect_list(F.struct("rid", "m", "q", "step", "left")).alias("rows"))
    pairs = (
        tiles.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
        .groupBy("label", "dim", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"))
        .agg(F.array_sort(F.collect_list(F.struct("t", "rows"))).alias("sides"))
        .select(F.struct("label", "dim", "x", "y").alias("pair"), F.col("sides.rows").alias("sides"))
    )

    def compare(batches):
        """Links that the bounds decide, and (with side) the rows in pairs that they leave open."""
        import numpy as np

        for batch in batches:
            for at, lists in enumerate(batch.column(1)):
                parts = _sides(lists)
                same, split = len(parts) == 1, len(parts[0][0])
                rid = np.concatenate([p[0] for p in parts])
                m = np.concatenate([p[1] for p in parts])
                unsure = np.zeros(len(rid), bool)

                def sure():
                    for r, c, undecided in _products(parts[0][2], parts[-1][2], threshold, same):
                        c = c if same else c + split
                        unsure[r[undecided]] = unsure[c[undecided]] = True
                        if not undecided.all():
                            yield r[~undecided], c[~undecided]

                a, n, root = _linked(rid, m, sure())
                k = np.nonzero(unsure)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([a, rid[k]])), pa.array(np.concatenate([n, np.zeros(len(k), np.int64)])), pa.array(np.concatenate([root, rid[k]])), batch.column(0).take(pa.array([None] * len(a) + [at] * len(k), pa.int64())), pa.array(np.concatenate([np.zeros(len(a), np.int32), (k >= split).astype(np.int32)]))],
                    names=["rid", "n", "root", "pair", "side"],
                )

    with arrow_rows(spark, 2):
        long = T.LongType()
        first = saved(pairs.mapInArrow(compare, T.StructType([T.StructField(n, k) for n, k in (("rid", long), ("n", long), ("root", long), ("pair", pairs.schema["pair"].dataType), ("side", T.IntegerType()))])))

    row = F.struct("rid", "m", "q", "step", "left", "v")
    undecided = first.where("pair is not null").select("rid", "pair", "side").join(reps.select("rid", "m", "q", "step", "left", "v"), "rid")
    sides = undecided.groupBy("pair", "side").agg(F.collect_list(row).alias("rows")).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("side", "rows"))).alias("sides")).select(F.col("sides.rows").alias("sides"))

    def settle(batches):
        import numpy as np

        for batch in batches:
            for lists in batch.column(0):
                parts = _sides(lists)
                units = [_unit(np.asarray(side.values.field("v").flatten()).reshape(len(side.values), -1)) for side in lists]
                same, split = len(parts) == 1, len(parts[0][0])

                def exact():
                    for r, c, undecided in _products(parts[0][2], parts[-1][2], threshold, same):
                        r, c = r[undecided], c[undecided]
                        for k in range(0, len(r), 65536):
                            i, j = r[k : k + 65536], c[k : k + 65536]
                            hit = np.einsum("ij,ij->i", units[0][i], units[-1][j]) >= threshold
                            if hit.any():
                                yield i[hit], j[hit] if same else j[hit] + split

                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), exact())], names=["rid", "n", "root"])

    with arrow_rows(spark, 2):
        second = saved(sides.mapInArrow(settle, "rid long, n long, root long"))
    met = first.where("pair is null").select("rid", "n", "root").unionByName(second)
    counts = met.groupBy("rid").agg(F.sum("n").alias("n"))
    joined = saved(components(met.select(F.col("rid").alias("a"), F.col("root").alias("b"))))
    whole = reps.join(counts, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    lowest = whole.groupBy("component").agg(F.min("first").alias("lowest"))
    by_vector = whole.join(lowest, "component").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "lowest")
    linked = usable.join(by_vector, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", F.coalesce("lowest", "vec_id").alias("component_id"))
    alone = given.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
