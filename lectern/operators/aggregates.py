"""Grouped counts, merges and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concordance(tokens: DataFrame, token: str, place: str) -> DataFrame:
    """(token, n, places): occurrences and distinct places of each token."""
    return tokens.groupBy(token).agg(F.count("*").alias("n"), F.countDistinct(place).alias("places"))


def concordance_of_rows(df: DataFrame, tokens: Column, token: str = "token") -> DataFrame:
    """(token, n, places) where each row of df is a place with an array of tokens.

    A row's distinct tokens are found before the shuffle, so only sums by token travel, not pairs of token and place.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    marked = F.concat(F.transform(tokens, lambda t: F.struct(t.alias("t"), one.alias("n"), none.alias("p"))), F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), none.alias("n"), one.alias("p"))))
    return df.select(F.explode(marked).alias("e")).groupBy(F.col("e.t").alias(token)).agg(F.sum("e.n").alias("n"), F.sum("e.p").alias("places"))


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def leading(counts: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, value, n, rank) of the most frequent values of each key, ties by value."""
    from pyspark.sql import Window

    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("rank") <= most)


def strongest(links: DataFrame, a: str, b: str, votes: str) -> DataFrame:
    """(a, b, votes): the largest votes of each link; links without positive votes and to themselves go."""
    return links.where((F.col(votes) > 0) & (F.col(a) != F.col(b))).groupBy(a, b).agg(F.max(votes).alias(votes))


def accounted(links: DataFrame, **conditions: Column) -> DataFrame:
    """One row: all rows, and how many meet each condition first in the given order; kept is the rest."""
    free, out = F.lit(True), [F.count("*").alias("rows")]
    for name, c in conditions.items():
        out.append(F.count_if(free & F.coalesce(c, F.lit(False))).alias(name))
        free = free & ~F.coalesce(c, F.lit(False))
    return links.agg(*out, F.count_if(free).alias("kept"))


def first_mentions(df: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """(group, items): a group's distinct items, comma-joined by first mention, then item."""
    first = df.groupBy(group, item).agg(F.min(order).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", item)))
    return first.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x[item].cast("string")), ",").alias("items"))


def latest(df: DataFrame, key: str, version: list[str], *values: str) -> DataFrame:
    """Version and values of the last row of each key by version: a grouped maximum, not a sorted window."""
    return df.groupBy(key).agg(F.max(F.struct(*version, *values)).alias("_last")).select(key, *[F.col(f"_last.{v}").alias(v) for v in (*version, *values)])


def coverage(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(total, covered): rows of df, and those whose key is known."""
    marked = df.join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count("_known").alias("covered"))
