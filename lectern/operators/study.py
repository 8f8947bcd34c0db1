"""Pages, indexes, periods and lists of study tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def senses(rows: DataFrame, base: str, id: str, wanted: DataFrame, block: int = 4096, run: int = 256) -> DataFrame:
    """(wanted, id, place): all rows of the wanted id's base, the wanted one first, then by id.

    wanted is a table of (wanted, base), a wanted id with one base.  The pairs are as many as the result asks for; they are made
    last, so none of them is sorted or shuffled: what is dealt to all tasks are blocks of rows with blocks of wanted ids.  A row
    meets a run of wanted ids before the next row does, so columns repeat and a written result takes a small part of a byte a pair.
    """
    # rows are numbered once a base; a pair's place follows from the row's number, and how many rows have or precede the wanted id
    placed = rows.withColumnRenamed(base, "_base").where("_base IS NOT NULL").select("_base", F.col(id).alias("_id"), F.row_number().over(Window.partitionBy("_base").orderBy(id)).alias("_n"))
    held = placed.groupBy("_base", "_id").agg(F.count("*").alias("_held"), (F.min("_n") - 1).alias("_before"))
    asked = wanted.join(held, (F.col("base") == F.col("_base")) & (F.col("wanted") == F.col("_id")), "left")
    copies = Window.partitionBy("base", "wanted")
    asked = asked.select(
        "base",
        F.row_number().over(Window.partitionBy("base").orderBy("wanted")).alias("_w"),
        "wanted",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_held", "_before")],
        F.row_number().over(copies.orderBy("wanted")).alias("_copy"),
        F.count("*").over(copies).alias("_copies"),
    )
    block_of = lambda n: F.floor((F.col(n) - 1) / block)
    left = placed.groupBy("_base", block_of("_n").alias("_i")).agg(F.collect_list(F.struct("_n", F.col("_id").alias(id))).alias("_rows"))
    right = asked.groupBy("base", block_of("_w").alias("_j")).agg(F.array_sort(F.collect_list(F.struct("_w", "wanted", "_held", "_before", "_copy", "_copies"))).alias("_asked"))
    tiles = left.join(right, F.col("base") == F.col("_base")).repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "_base", "_i", "_j")
    runs = tiles.select("_rows", "_asked", F.explode(F.sequence(F.lit(1), F.size("_asked"), F.lit(run))).alias("_from")).select("_rows", F.slice("_asked", F.col("_from"), run).alias("_run"))
    # array_sort has no generated code, so this step gives row by row; a generated loop would hold all pairs of a block at once
    met = runs.select("_run", F.inline(F.array_sort("_rows"))).select("_n", id, F.inline("_run"))
    n, before, held = F.col("_n"), F.col("_before"), F.col("_held")
    place = F.when(n > before + held, n).when(n > before, n - before).otherwise(n + held)
    return met.select("wanted", id, ((place - 1) * F.col("_copies") + F.col("_copy")).cast("int").alias("place"))


def single_period(points: DataFrame, key: str, at: str, periods: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """(key, name) of points within just one period; periods is a small table, joined as Spark sees fit."""
    met = points.join(periods, F.col(at).between(F.col(low), F.col(high)))
    return met.groupBy(key).agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")


def indexes_searched(indexes: list[tuple[str, DataFrame]], key: str, rank) -> DataFrame:
    """(place, index, key, rank): hits of several indexes in the given order; indexes without a hit have no rows.

    rank: a function of the title column that is null where it does not match.
    """
    parts = [df.select(F.lit(i).alias("place"), F.lit(name).alias("index"), key, rank(F.col("title")).alias("rank")).where("rank is not null") for i, (name, df) in enumerate(indexes)]
    return reduce(DataFrame.unionByName, parts)


def first_pages(df: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """At most size rows of each group in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= size).drop("_r")


def first_uses(df: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, key, first): distinct keys of a group with where each is used first."""
    return df.groupBy(group, key).agg(F.min(order).alias("first"))


def prefixes(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, step, upto): the first, the first two, ... rows of each group, by order."""
    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    return listed.select(group, F.posexplode("_all").alias("_i", "upto")).select(group, (F.col("_i") + 1).alias("step"), "upto")


def by_number(title: Column, width: int = 12) -> Column:
    """A sort key in which numbers within titles count as numbers: digits are padded."""
    parts = F.regexp_extract_all(F.lower(title), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def split_ranges(ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """ranges cut at multiples of width, as a range over several books becomes one of each; reversed ones go."""
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    cut = ranges.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(first, last)))
    return cut.withColumn("part_low", F.greatest(F.col(low), F.col("_b") * width)).withColumn("part_high", F.least(F.col(high), (F.col("_b") + 1) * width - 1)).drop("_b")


def axis(df: DataFrame, low: str, high: str, step: int) -> DataFrame:
    """One row: the smallest low and the largest high, rounded out to steps."""
    return df.agg((F.floor(F.min(low) / step) * step).alias("low"), (F.ceil(F.max(high) / step) * step).alias("high"))


def covered_to(df: DataFrame, group: str, place: str, item: str, places: DataFrame) -> DataFrame:
    """(group, place, item): every place of the group with the last item at or before it."""
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    met = places.select(group, place).distinct().join(df.select(group, place, item), [group, place], "left")
    return met.withColumn(item, F.last(item, ignorenulls=True).over(w))


def buckets_of(sizes: Column, target: int, most: int) -> Column:
    """array<int>: sequential buckets that end where target would be exceeded; a last one below a quarter
    of target joins the one before if both fit in most."""
    from lectern.operators.ordered import chunked

    chunk = chunked(sizes, target)
    last = F.array_max(chunk)
    load = lambda k: F.aggregate(F.zip_with(sizes, chunk, lambda s, c: F.when(c == k, s).otherwise(0)), F.lit(0).cast("long"), lambda a, s: a + s)
    folds = (last > 0) & (load(last) < target / 4) & (load(last) + load(last - 1) <= most)
    return F.when(folds, F.transform(chunk, lambda c: F.least(c, last - 1))).otherwise(chunk)


def collation_key(title: Column) -> Column:
    """A string that sorts as a title does for readers: by base letters, whatever their case and accents, and numbers by value.

    A run of digits becomes its length and its digits without leading zeros, so numbers of any length compare.
    """
    digits = lambda t: F.ltrim(t, F.lit("0"))
    number = lambda t: F.concat(F.lpad(F.length(digits(t)).cast("string"), 6, "0"), digits(t))
    parts = F.transform(F.regexp_extract_all(title, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda t: F.when(t.rlike("^[0-9]"), number(t)).otherwise(t))
    return F.collate(F.array_join(parts, ""), "UNICODE_CI_AI")


def collated_places(df: DataFrame, title: str, tie: str, out: str = "place") -> DataFrame:
    """df with the place of each row, from 1, by collation_key of title, equal ones by tie (unique ids); null titles first.

    Rows are dealt in ranges of the collation's own order, written, and counted range by range.
    """
    from lectern.tables import scratch

    spark, path = df.sparkSession, scratch(df.sparkSession)
    keyed = df.withColumn("_key", collation_key(F.col(title)))
    ranged = keyed.repartitionByRange("_key", tie).withColumn("_range", F.spark_partition_id())
    ranged.drop("_key").write.parquet(path)
    written = spark.read.parquet(path).withColumn("_key", collation_key(F.col(title)))
    inside = Window.partitionBy("_range").orderBy("_key", tie)
    before = written.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    met = written.withColumn("_in", F.row_number().over(inside)).join(before, F.col("_range") == F.col("_r"))
    return met.select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))
