"""Several sources on one spine of keys, and rules that apply where all their conditions hold."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_spine(spine: DataFrame, key: str, sources: dict[str, DataFrame], value: str) -> DataFrame:
    """(key, expected, a column a source): all keys of the spine and of the sources, one row each.

    Each source holds a key once at most.  The rows of all sources are stacked and pivoted by one grouping, so there is one
    shuffle however many sources there are; expected: whether the spine holds the key.
    """
    names = list(sources)
    stacked = spine.select(key, F.lit(None).cast("string").alias("_source"), F.lit(None).alias("_value"))
    for name, df in sources.items():
        stacked = stacked.unionByName(df.select(key, F.lit(name).alias("_source"), F.col(value).alias("_value")))
    columns = [F.max(F.when(F.col("_source") == n, F.col("_value"))).alias(n) for n in names]
    return stacked.groupBy(key).agg(F.max(F.col("_source").isNull()).alias("expected"), *columns)


def accounted(joined: DataFrame, names: list[str]) -> DataFrame:
    """One row: keys, expected, unexpected, without any source, held by each source, and for each two how many agree and differ."""
    when = lambda c: F.count(F.when(c, 1))
    none = F.coalesce(*names).isNull()
    pairs = [f(F.col(a), F.col(b)).alias(f"{word}_{a}_{b}") for a, b in combinations(names, 2) for word, f in (("agree", lambda x, y: when(x == y)), ("differ", lambda x, y: when(x != y)))]
    return joined.agg(F.count("*").alias("keys"), when(F.col("expected")).alias("expected"), when(~F.col("expected")).alias("unexpected"), when(F.col("expected") & none).alias("without"), *[F.count(n).alias(f"in_{n}") for n in names], *pairs)


def rules_holding(facts: DataFrame, key: str, group: str, conditions: DataFrame) -> DataFrame:
    """(key, rule): the first rule of each key's group whose conditions all hold.

    facts: (key, group, measure, value), conditions: (rule, group, measure, least, most), with null for no bound.  A rule
    holds if as many of its conditions are met as it has: relational division.  A measure that a key lacks meets none.
    """
    asked = conditions.groupBy("rule", group).agg(F.count("*").alias("_asked"))
    met = facts.join(conditions, [group, "measure"])
    within = (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("most").isNull() | (F.col("value") <= F.col("most"))) & F.col("value").isNotNull()
    counted = met.where(within).groupBy(key, "rule", group).agg(F.count("*").alias("_met"))
    return counted.join(asked, ["rule", group]).where("_met = _asked").groupBy(key).agg(F.min("rule").alias("rule"))
