"""Operator 10: SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_rows, components, merge_labels, saved


def _fingerprint(text: str | None, words: int, seed: int) -> int:
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), seed)]
    else:
        line, at, starts, ends = b" ".join(tokens), 0, [], []
        for n in map(len, tokens):
            starts.append(at)
            ends.append(at + n)
            at += n + 1
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :])]
    found = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), 8192):
        counts += np.unpackbits(found[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, name: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """docs with the SimHash (long) of every whole text; null and blank texts have fingerprint 0."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            out = np.fromiter((_fingerprint(t, words, seed) for t in texts), np.uint64, batch.num_rows)
            mine = [i for i, n in enumerate(batch.schema.names) if n != "text" or whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in mine), pa.array(out.view(np.int64))], names=[*(batch.schema.names[i] for i in mine), name])

    whole = len(docs.columns) > 2  # of doc_id and text alone, the text is not sent back
    kept = [f for f in docs.schema.fields if f.name != "text" or whole]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long)."""
    return fingerprinted(docs.select("doc_id", "text"), "fp", words, seed)


def _near(a, b, radius: int, same: bool, block: int = 1024):
    """Index pairs of fingerprints at most radius bits apart.

    Both sides are ordered by the population counts of their 16-bit quarters; blocks whose count
    boxes are further apart than the radius cannot hold a pair and are skipped.
    """
    import numpy as np

    def ordered(x):
        q = np.bitwise_count(x.view(np.uint16).reshape(-1, 4))
        order = np.lexsort(q.T[::-1])
        q = q[order].astype(np.int16)
        starts = np.arange(0, len(x), block)
        return order, x[order], starts, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)

    oa, xa, sa, lo_a, hi_a = ordered(a)
    ob, xb, sb, lo_b, hi_b = (oa, xa, sa, lo_a, hi_a) if same else ordered(b)
    for i, s in enumerate(sa):
        apart = np.maximum(0, np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b)).sum(axis=1)
        for j in np.nonzero(apart <= radius)[0]:
            if same and j < i:
                continue
            t = sb[j]
            r, c = np.nonzero(np.bitwise_count(xa[s : s + block, None] ^ xb[None, t : t + block]) <= radius)
            if len(r):
                yield oa[s + r], ob[t + c]


def links(fps: DataFrame, radius: int = 3, tile: int = 32768) -> DataFrame:
    """Spanning links (a, b) of the distinct values of fps.fp at most radius bits apart.

    Fingerprints are cut into tiles of one population count each; a pair of tiles is compared only
    if the counts differ by the radius at most.  A tile pair returns at most a row per fingerprint:
    the links that join what it found, never all pairs of a group.
    """
    import pyarrow as pa

    spark = fps.sparkSession
    bits = F.bit_count("fp").cast("int")
    tiles_of = {r[0]: -(-r[1] // tile) for r in fps.groupBy(bits.alias("p")).count().collect()}  # at most 65 rows
    if not tiles_of:
        return spark.createDataFrame([], "a long, b long")
    counts = F.create_map(*[F.lit(x) for kv in tiles_of.items() for x in kv])
    tiles = (
        fps.select("fp", bits.alias("p"))
        .withColumn("t", F.pmod(F.xxhash64("fp"), counts[F.col("p")]).cast("int"))
        .groupBy("p", "t")
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("me", F.struct("p", "t"))
    )
    others = F.flatten(F.transform(F.sequence(F.col("p") - radius, F.col("p") + radius), lambda p: F.when(F.coalesce(counts[p], F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), counts[p] - 1), lambda t: F.struct(p.alias("p"), t.cast("int").alias("t")))).otherwise(F.array().cast("array<struct<p:int,t:int>>"))))
    pairs = (
        tiles.withColumn("other", F.explode(others))
        .groupBy(F.least("me", "other").alias("x"), F.greatest("me", "other").alias("y"))
        .agg(F.collect_list("fps").alias("sides"))
        .select("sides")
    )

    def run(batches):
        import numpy as np

        for batch in batches:
            for sides in batch.column(0):
                a, *rest = (np.asarray(x.values).astype(np.int64).view(np.uint64) for x in sides)
                same = not rest
                nodes = a if same else np.concatenate([a, rest[0]])
                labels = np.arange(len(nodes))
                for r, c in _near(a, a if same else rest[0], radius, same):
                    labels = merge_labels(labels, r, c if same else c + len(a))
                moved = np.nonzero(labels != np.arange(len(nodes)))[0]
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[labels[moved]].view(np.int64))], names=["a", "b"])

    with arrow_rows(spark, 8):
        return saved(pairs.mapInArrow(run, "a long, b long"))


def groups(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, tile: int = 32768) -> DataFrame:
    """One row per document: doc_id, fp, component (a fingerprint of its group), component_id (the smallest doc_id there)."""
    marked = saved(fingerprints(docs, words, seed))
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = saved(components(links(distinct.select("fp"), radius, tile)))
    grouped = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(grouped.join(lowest, "component").drop("first"), "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, tile: int = 32768) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable by links.

    Texts null, empty or without a word have fingerprint zero and link like any other.  Equal
    fingerprints are collapsed before any comparison.  Repeated doc_ids keep their rows; a null doc_id
    keeps its row and never becomes a component_id unless the component holds no other.  An empty
    table gives an empty result; other columns are ignored.
    """
    found = groups(docs, words, radius, seed, tile)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
