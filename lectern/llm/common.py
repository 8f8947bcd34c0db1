"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may name none: a temporary folder is made then.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by saved() that nothing reads any more."""
    path = getattr(df, "_lectern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows in an Arrow batch while an eager action runs, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_cache(slot: str, version: str, make: Callable[[], object]) -> object:
    """make() once for each Python worker, however many tasks it runs; another version takes the slot over."""
    store = sys.modules.setdefault("lectern_worker_store", types.ModuleType("lectern_worker_store"))
    if getattr(store, slot, (None,))[0] != version:
        setattr(store, slot, (version, make()))
    return getattr(store, slot)[1]


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), component the smallest node.

    Alternates large-star and small-star steps until nothing changes: the edges are stars then, after about as
    many rounds as the logarithm of the longest path.  Hubs are dealt with
    by a grouped minimum (combined before the shuffle) and an equi-join that AQE may split.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        met = both.join(lowest, "a")
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    def same(left: DataFrame, right: DataFrame) -> bool:
        return left.join(right, ["a", "b"], "left_anti").isEmpty() and right.join(left, ["a", "b"], "left_anti").isEmpty()

    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        after = saved(star(star(now, True), False))
        marked = mark(after)
        settled = marked == seen and same(now, after)  # equal sums alone could be chance
        dropped(now)
        now, seen = after, marked
        if settled:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def merge_labels(labels, left, right):
    """Union by repeated minimum: labels (int array) after joining left[i] with right[i]."""
    import numpy as np

    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:  # roots point to themselves again
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
