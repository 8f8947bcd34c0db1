"""Joins by key, by fallback, by interval and by order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import running


def star(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """fact with each (dimension, fact key, dimension key) attached; facts without a match stay."""
    return reduce(lambda df, d: df.join(d[0], df[d[1]] == d[0][d[2]], "left"), dimensions, fact)


def first_match(queries: DataFrame, key: str, rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """queries with target and rule of the first rule that resolves the key to one target.

    Each rule is a (key, target) table; a key with several targets there is ambiguous and resolves to
    nothing by that rule.  target and rule are null where no rule resolves.
    """
    out, names = queries, []
    for i, (name, table) in enumerate(rules):
        one = table.groupBy(F.col("key").alias(f"k{i}")).agg(F.countDistinct("target").alias("n"), F.min("target").alias(f"t{i}")).where("n = 1").drop("n")
        out = out.join(one, out[key] == F.col(f"k{i}"), "left")
        names.append((name, f"t{i}"))
    rule = F.coalesce(*[F.when(F.col(t).isNotNull(), n) for n, t in names])
    return out.select(*[F.col(c) for c in queries.columns], F.coalesce(*[F.col(t) for _, t in names]).alias("target"), rule.alias("rule"))


def stabbed(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int, on: list[str] | None = None) -> DataFrame:
    """points joined to the ranges [low, high] that contain them, of equal ``on`` columns.

    A range is listed in every bin of width it touches and a point in its own, so that an equi-join
    finds the pairs; long ranges should take a larger width.  Columns of the two sides must differ.
    """
    on = on or []
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    met = points.withColumn("_at", F.floor(F.col(point) / width))
    same = reduce(lambda a, c: a & (met[c] == binned[f"r_{c}"]), on, met["_at"] == binned["_bin"])
    return met.join(binned, same & met[point].between(binned[low], binned[high])).drop("_bin", "_at")


def best_range(stabs: DataFrame, key: list[str], point: str, low: str, high: str, tie: str) -> DataFrame:
    """Of each key's ranges: one that begins at the point, else the narrowest, else the smallest tie.

    A grouped minimum, so that equal keys are combined before the shuffle.
    """
    order = F.struct(F.when(F.col(point) == F.col(low), 0).otherwise(1), (F.col(high) - F.col(low)).alias("width"), F.col(tie))
    return stabs.groupBy(*key).agg(F.min(F.struct(order.alias("order"), F.struct(*[F.col(c) for c in stabs.columns if c not in key]).alias("row"))).alias("best")).select(*key, "best.row.*")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How two closed ranges lie: equal, inside, around, overlap or apart."""
    return (
        F.when((a0 == b0) & (a1 == b1), "equal")
        .when((a0 >= b0) & (a1 <= b1), "inside")
        .when((a0 <= b0) & (a1 >= b1), "around")
        .when((a0 <= b1) & (b0 <= a1), "overlap")
        .otherwise("apart")
    )


def overlapping(ranges: DataFrame, key: str, id: str, low: str, high: str, width: int) -> DataFrame:
    """Ordered pairs of different ranges of a key that share a point: the columns of one, and of the other with ``b_``.

    Ranges are listed in every bin of width they touch; a pair is met in the bin where the later one begins.
    """
    a = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns])
    first = F.floor(F.greatest(low, f"b_{low}") / width)
    met = a.join(b, (F.col(key) == F.col(f"b_{key}")) & (F.col("_bin") == F.col("b__bin")) & (F.col(id) != F.col(f"b_{id}")))
    return met.where((F.col("_bin") == first) & (F.col(low) <= F.col(f"b_{high}")) & (F.col(f"b_{low}") <= F.col(high))).drop("_bin", "b__bin")


def overlaps_counted(ranges: DataFrame, key: str, id: str, low: str, high: str, width: int) -> DataFrame:
    """(kind, n): how all ordered pairs of different ranges of a key lie; those apart are counted, not listed."""
    met = overlapping(ranges, key, id, low, high, width)
    kinds = met.groupBy(overlap(F.col(low), F.col(high), F.col(f"b_{low}"), F.col(f"b_{high}")).alias("kind")).agg(F.count("*").alias("n"))
    every = ranges.groupBy(key).agg(F.count("*").alias("m")).select(F.lit("apart").alias("kind"), (F.col("m") * (F.col("m") - 1)).alias("n"))
    parts = every.unionByName(kinds).unionByName(kinds.select(F.lit("apart").alias("kind"), (-F.col("n")).alias("n")))
    return parts.groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], bucket: Column | None = None) -> DataFrame:
    """left with the values of the latest right row of the same key at or before its time (null if none).

    Both sides are united and scanned in time order, right rows first at a tie; a key is scanned bucket
    by bucket (bucket: a Column of the time, as in ordered.running).
    """
    names = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.lit(1).alias("_side"), *names, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(key, time, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *values)
    seen = running(a.unionByName(b), [key], [time, "_side"], bucket, _last=("last", F.when(F.col("_side") == 0, F.struct(*values))))
    return seen.where("_side = 1").select(key, time, *names, *[F.col(f"_last.{v}").alias(v) for v in values])


def swapped(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs a < b that occur in both directions."""
    one = pairs.select(a, b).distinct()
    other = one.select(F.col(a).alias("_b"), F.col(b).alias("_a"))
    return one.join(other, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).where(F.col(a) < F.col(b)).select(a, b)


def best_overlap(left: DataFrame, right: DataFrame, least: float = 0.5, frequent: int = 1024) -> DataFrame:
    """(left, right, share): for each left set the right set that holds most of it.

    Both tables are (id, item).  A best share below least, or that two sets reach, gives no row.  An item brings the list of
    its right sets to each left set, where they are counted, so what is shuffled is a list for each item of a left set, never a
    pair.  Left sets with an item of more than ``frequent`` right sets are met on their rarest items instead.
    """
    sides = right.where("id is not null").select(F.col("id").alias("right"), "item").repartition("item").distinct()
    often = sides.groupBy("item").agg(F.count("*").alias("often"))
    hot = often.where(F.col("often") > frequent).select("item")
    a = left.where("id is not null").select(F.col("id").alias("left"), "item").repartition("item").distinct()
    among = a.join(hot, "item", "left_semi").select("left").distinct()
    return _counted_overlap(a.join(among, "left", "left_anti"), sides.join(hot, "item", "left_anti"), least).unionByName(_rarest_overlap(a.join(among, "left", "left_semi"), sides, often, least))


def _counted_overlap(a: DataFrame, sides: DataFrame, least: float) -> DataFrame:
    """best_overlap of distinct rows whose items have short lists of right sets."""
    id_type = sides.schema["right"].dataType.simpleString()
    lists = sides.groupBy("item").agg(F.sort_array(F.collect_list("right")).alias("rights"))
    met = a.join(lists, "item", "left").groupBy("left").agg(F.count("*").alias("size"), F.sort_array(F.flatten(F.collect_list("rights"))).alias("rights"))

    def longest(state, right):
        """Runs of one set in sorted order: the longest so far, whose it is, and if another is as long."""
        run = F.when(right == state["last"], state["run"] + 1).otherwise(1)
        more = run > state["most"]
        return F.struct(right.alias("last"), run.alias("run"), F.greatest(run, state["most"]).alias("most"), F.when(more, right).otherwise(state["whose"]).alias("whose"), (~more & (state["tied"] | (run == state["most"]))).alias("tied"))

    none = F.lit(None).cast(id_type)
    start = F.struct(none.alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), none.alias("whose"), F.lit(False).alias("tied"))
    best = met.select("left", "size", F.aggregate("rights", start, longest).alias("b"))
    return best.where("b.most > 0 and not b.tied").select("left", F.col("b.whose").alias("right"), (F.col("b.most") / F.col("size")).alias("share")).where(F.col("share") >= least)


def _rarest_overlap(a: DataFrame, sides: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """best_overlap of distinct rows with frequent items.

    A right set that holds k of n items of a left set holds one of its n - k + 1 rarest, so candidates are met on those
    only: a frequent item is joined just where a left set has nothing rarer.
    """
    size = a.groupBy("left").agg(F.count("*").alias("size"))
    ranked = a.join(often, "item", "left").select("left", "item", F.coalesce("often", F.lit(0)).alias("often"))
    place = F.row_number().over(Window.partitionBy("left").orderBy("often", "item"))
    ranked = ranked.join(size, "left").withColumn("place", place)
    rare = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    candidates = rare.select("left", "size", "item").join(sides, "item").select("left", "size", "right").distinct()
    both = candidates.join(a, "left").join(sides, ["right", "item"])
    shares = both.groupBy("left", "right", "size").agg(F.count("*").alias("common")).withColumn("share", F.col("common") / F.col("size")).where(F.col("share") >= least)
    most = shares.groupBy("left").agg(F.max("share").alias("share"), F.max_by(F.struct("right"), "share").alias("_top"))
    tied = shares.select(F.col("left").alias("_l"), F.col("share").alias("_s")).groupBy("_l", "_s").agg(F.count("*").alias("_n")).where("_n = 1")
    return most.join(tied, (F.col("left") == F.col("_l")) & (F.col("share") == F.col("_s"))).select("left", F.col("_top.right").alias("right"), "share")


def unique_or_null(queries: DataFrame, key: str, found: DataFrame, target: str) -> DataFrame:
    """queries with the target if found (key, target) has just one, else null."""
    one = found.groupBy(key).agg(F.min(target).alias(target), F.countDistinct(target).alias("_n")).where("_n = 1").drop("_n")
    return queries.join(one, key, "left")
