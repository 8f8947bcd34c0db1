"""Operations on ordered rows.  Whole-table orders are cut into buckets, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, value: str, bucket: Column, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows before each in the order.

    bucket must never fall as order rises: totals of buckets are summed in order (one small row each),
    then every bucket is scanned by itself.
    """
    marked = df.withColumn("_bucket", bucket)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("_bucket").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.join(base, "_bucket").withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_base")


def positions(df: DataFrame, order: str, bucket: Column, out: str = "pos") -> DataFrame:
    """df with the 0-based place of each row in the order."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", bucket, out).drop("_one")


def neighbours(df: DataFrame, order: str, bucket: Column, value: str) -> DataFrame:
    """df with prev and next value in the whole order, by an equi-join on places."""
    placed = positions(df, order, bucket)
    other = placed.select(F.col("pos").alias("_p"), F.col(value).alias("_v"))
    out = placed.join(other.withColumnRenamed("_v", "prev"), F.col("pos") - 1 == F.col("_p"), "left").drop("_p")
    return out.join(other.withColumnRenamed("_v", "next"), F.col("pos") + 1 == F.col("_p"), "left").drop("_p", "pos")


def running(df: DataFrame, key: list[str], order: list[str], bucket: Column | None, before: bool = False, **what: tuple[str, Column]) -> DataFrame:
    """df with running values in each key's order: name=("sum" | "max" | "last", value), last skipping nulls.

    bucket must never fall as order rises in a key.  A key's rows are scanned bucket by bucket, and what
    earlier buckets add up to (one small row each) is combined with it, so one key with most rows still
    spreads over many tasks; without a bucket a key is scanned at once.  before: without the row itself.
    """
    from functools import reduce

    at = F.struct(*[F.col(c) for c in order])
    marked = df.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: F.max(F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))))}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a["v"])}
    earlier = Window.partitionBy(*[f"_{k}" for k in key]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    sums = marked.groupBy(*[F.col(k).alias(f"_{k}") for k in key], F.col("_bucket").alias("_b")).agg(*[whole[kind](v).alias(f"_{n}") for n, (kind, v) in what.items()])
    # totals of buckets: their running maximum is also the latest of structs led by their place
    over = lambda kind, n: F.sum(n).over(earlier) if kind == "sum" else F.max(n).over(earlier)
    sums = sums.select(*[f"_{k}" for k in key], "_b", *[over(kind, f"_{n}").alias(f"_{n}") for n, (kind, _) in what.items()])
    scan = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    marked = marked.withColumns({f"_in_{n}": scan[kind](v).over(inside) for n, (kind, v) in what.items()})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), key, F.col("_bucket").eqNullSafe(F.col("_b")))
    met = marked.join(sums, same)
    return met.select(*df.columns, *[join[kind](F.col(f"_{n}"), F.col(f"_in_{n}")).alias(n) for n, (kind, _) in what.items()])


def islands(df: DataFrame, key: list[str], number: str) -> DataFrame:
    """(key, first, last, n): runs of consecutive whole numbers in each key."""
    distinct = df.select(*key, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*key).orderBy(number))
    return distinct.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")


def runs(df: DataFrame, key: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """df with run: the number of the stretch of equal neighbouring values in the key's order.  bucket: as in running()."""
    seen = running(df, key, order, bucket, before=True, _before=("last", F.struct(F.col(value).alias("v"))))
    changed = F.when(F.col("_before").isNotNull() & F.col("_before.v").eqNullSafe(F.col(value)), 0).otherwise(1)
    return running(seen.withColumn("_changed", changed), key, order, bucket, run=("sum", F.col("_changed"))).drop("_before", "_changed")


def gaps(df: DataFrame, key: list[str], low: str, high: str) -> DataFrame:
    """(key, gap_from, gap_to): whole numbers between a key's ranges that none of them covers."""
    w = Window.partitionBy(*key).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = df.withColumn("_reach", F.max(high).over(w))
    return reach.where(F.col(low) > F.col("_reach") + 1).select(*key, (F.col("_reach") + 1).alias("gap_from"), (F.col(low) - 1).alias("gap_to"))


def filled(df: DataFrame, key: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """df with nulls of value replaced by the last one before them in the key.  bucket: as in running()."""
    return running(df, key, order, bucket, _filled=("last", F.col(value))).withColumn(value, F.col("_filled")).drop("_filled")


def uncovered(keys: DataFrame, ranges: DataFrame, key: str, count: str, low: str, high: str) -> DataFrame:
    """(key, gap_from, gap_to): whole numbers from 1 to a key's count that none of its ranges holds; a key without ranges lacks them all.

    Ranges may overlap, and lie outside; ranges of unknown keys count for nothing.
    """
    ends = keys.where(F.col(count) > 0).select(key, F.explode(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), F.struct((F.col(count) + 1).cast("long").alias("a"), (F.col(count) + 1).cast("long").alias("b")))).alias("r")).select(key, "r.*")
    inside = ranges.join(keys.where(F.col(count) > 0), key).where((F.col(high) >= 1) & (F.col(low) <= F.col(count)) & (F.col(low) <= F.col(high)))
    inside = inside.select(key, F.greatest(F.col(low).cast("long"), F.lit(1).cast("long")).alias("a"), F.least(F.col(high).cast("long"), F.col(count).cast("long")).alias("b"))
    return gaps(ends.unionByName(inside), [key], "a", "b")


def chunked(weights: Column, limit: int, block: int = 512) -> Column:
    """array<int>: the chunk of each weight, in order; a chunk ends where the next would exceed limit.

    A fold, since the greedy rule depends on what came before: over blocks of weights, and inside each, so
    that the arrays that grow stay short.
    """
    kind = "struct<out:array<int>,chunk:int,load:bigint>"
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("load")).cast(kind)

    def step(acc, w):
        over = (acc["load"] > 0) & (acc["load"] + w > limit)
        chunk = F.when(over, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), F.when(over, w.cast("long")).otherwise(acc["load"] + w).alias("load")).cast(kind)

    def blocks(acc, some):
        inner = F.aggregate(some, F.struct(F.array().cast("array<int>").alias("out"), acc["chunk"].alias("chunk"), acc["load"].alias("load")).cast(kind), step)
        grown = lambda r: F.struct(F.concat(acc["out"], r["out"]).alias("out"), r["chunk"].alias("chunk"), r["load"].alias("load")).cast(kind)
        return F.get(F.transform(F.array(inner), grown), F.lit(0))

    last = F.greatest(F.ceil(F.size(weights) / block).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(weights, k * block + 1, block))
    return F.aggregate(parts, begin, blocks, lambda acc: acc["out"])


def rows_packed(df: DataFrame, key: list[str], low: str, high: str, gap: float = 0, tie: str | None = None, bucket: Column | None = None) -> DataFrame:
    """df with row: the first display row that is free when an interval begins (greedy, by key, in the order of low, high and tie).

    Where all intervals before have ended the rows are all free again, so a key is cut there, into groups of
    256 such stretches: one key may hold most intervals.  bucket: as in running(), of the order of low.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("row", T.IntegerType())])
    order = [low, high, *([tie] if tie else [])]
    reach = running(df, key, order, bucket, before=True, _reach=("max", F.col(high)))
    fresh = F.when(F.col("_reach") + F.lit(gap) > F.col(low), 0).otherwise(1)
    cut = running(reach.withColumn("_fresh", fresh), key, order, bucket, _stretch=("sum", F.col("_fresh"))).drop("_reach", "_fresh")
    cut = cut.withColumn("_stretch", F.floor(F.col("_stretch") / 256))

    def pack(pdf):
        import heapq

        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        free, busy, out = [], [], []  # free rows by number; busy ones by when they are free
        for a, b in zip(pdf[low], pdf[high]):
            while busy and busy[0][0] <= a:
                heapq.heappush(free, heapq.heappop(busy)[1])
            row = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (b + gap, row))
            out.append(row)
        pdf["row"] = out
        return pdf[schema.names]

    return cut.groupBy(*key, "_stretch").applyInPandas(pack, schema)
