"""Operations of lexicon and dictionary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import runs


def described(codes: DataFrame, code: str, parts: Column, table: DataFrame) -> DataFrame:
    """codes with text: the parts' descriptions from table (code, text), a part itself where unknown."""
    exploded = codes.select(code, F.posexplode(parts).alias("pos", "part"))
    met = exploded.join(table.select(F.col("code").alias("_code"), F.col("text").alias("_text")), F.col("part") == F.col("_code"), "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_text", "part").alias("t"))))
    return met.groupBy(code).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("text"))


def consecutive(df: DataFrame, key: list[str], order: list[str], value: str, item: str, bucket: Column | None = None) -> DataFrame:
    """(key, run, value, items): neighbours of equal value as one group; a later return starts another.

    Without a key the whole table is one order; bucket (as in ordered.running) keeps it from one task.
    """
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    return runs(df, key, order, value, bucket).groupBy(*key, "run", value).agg(F.transform(listed, lambda x: x["_item"]).alias("items"))


def numbered_ids(df: DataFrame, base: str, order: str) -> DataFrame:
    """df with id: base, then base-2, base-3 for later rows, past numbers that are bases themselves."""
    w = Window.partitionBy(base).orderBy(order)
    placed = df.withColumn("_n", F.row_number().over(w))
    bases = df.select(F.col(base).alias("_taken")).distinct()
    wanted = F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_n").cast("string")))
    met = placed.withColumn("_want", wanted).join(bases, (F.col("_want") == F.col("_taken")) & (F.col("_n") > 1), "left")
    shift = F.sum(F.col("_taken").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    number = F.col("_n") + shift
    return met.withColumn("id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), number.cast("string")))).drop("_n", "_want", "_taken")


def shared_names(people: DataFrame, name: str) -> DataFrame:
    """people with namesakes: how many share the name."""
    counts = people.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("namesakes"))
    return people.join(counts, F.col(name) == F.col("_name"), "left").drop("_name")


def strong_or_weak(candidates: DataFrame, key: str, target: str, rank: str) -> DataFrame:
    """(key, target) of the first rank that a key has; weaker candidates count only without a stronger one."""
    best = candidates.groupBy(F.col(key).alias("_k")).agg(F.min(rank).alias("_r"))
    return candidates.join(best, (F.col(key) == F.col("_k")) & (F.col(rank) == F.col("_r")), "left_semi").select(key, target).distinct()


def units_by_word(units: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, w, word, presence, alts): variant units (key, w, kind, text) of each word of a verse beside the printed word.

    words: (key, w, word).  presence is the one unit of that kind, alts are the other ones in order of their text.
    """
    grouped = units.groupBy(key, "w").agg(F.max(F.when(F.col("kind") == "presence", F.col("text"))).alias("presence"), F.array_sort(F.collect_list(F.when(F.col("kind") != "presence", F.col("text")))).alias("alts"))
    return grouped.join(words, [key, "w"], "left").select(key, "w", "word", "presence", "alts")


def passage_words(verses: DataFrame, key: str, order: str, words: str) -> DataFrame:
    """(key, i, order, word, verse_start): the words of a passage's verses, numbered from 0 across verses.

    verses: a row a verse with an array of words; numbers are a running total over verses, so words of different
    verses need not meet.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = verses.withColumn("_before", F.coalesce(F.sum(F.size(words)).over(w), F.lit(0)))
    return placed.select(key, order, "_before", F.posexplode(words).alias("_k", "word")).select(key, (F.col("_before") + F.col("_k")).alias("i"), order, "word", (F.col("_k") == 0).alias("verse_start"))
