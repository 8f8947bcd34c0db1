"""A written positional index of words: term, document, positions; searched without the texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx

TERM = r"[\p{L}\p{N}]+"
#: What may stand between the words of a phrase is blanks and punctuation; anything else cuts a text into stretches.
BREAK = r"[^\p{L}\p{N}\s\p{P}]+"
SCHEMA = "term string, key {key}, positions array<int>, lead string"


def lead(term: Column) -> Column:
    """The folder of a term: its first character if that is an ASCII letter or digit, else a block of 256 code points."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise(F.concat(F.lit("u"), F.hex(F.floor(F.ascii(first) / 256).cast("long"))))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, positions) of the lower-case words of each row; neighbours in a stretch have positions one apart.

    What cuts a text takes a position of its own.  The words of a row are sorted and grouped inside the row,
    so nothing is shuffled and a word is never a row by itself.
    """
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"{TERM}|{BREAK}"), F.lit(0)), lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    words = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sort_array(found).alias("w"))
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda i: (i == 0) | (F.get("w", i)["term"] != F.get("w", i - 1)["term"]))
    group = lambda i, k: F.struct(F.get("w", i)["term"].alias("term"), F.slice("w", i + 1, F.coalesce(F.get("first", k + 1), F.size("w")) - i)["at"].alias("positions"))
    groups = words.select("key", "w", first.alias("first")).select("key", F.explode(F.transform("first", group)).alias("g"))
    return groups.select("g.term", "key", "g.positions").where(F.col("term").rlike(r"^[\p{L}\p{N}]"))


def write_index(docs: DataFrame, path: str, key: str, text: str, salts: int = 16) -> None:
    """Write the postings in folders by the first character, sorted by term and key in each file.

    A term's documents go to as many tasks as salts at most, so one that most documents hold is cut into several files,
    and statistics rule out the row groups of other terms.  Rows that repeat a key add up.
    """
    found = postings(docs, key, text)
    if not docs.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        found = found.groupBy("term", "key").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    dealt = found.repartition("term", F.pmod(F.xxhash64("key"), F.lit(salts))).withColumn("lead", lead(F.col("term")))
    dealt.sortWithinPartitions("lead", "term", "key").write.partitionBy("lead").parquet(path)


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


class WordIndex:
    """An index written by write_index, searched for keys.  Only the folders and row groups of the terms asked for are read."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint"):
        self.rows = spark.read.schema(SCHEMA.format(key=key_type)).parquet(path)

    @staticmethod
    def terms(query: str) -> list[list[str]]:
        """The terms of a query, each as the words that it holds (more than one with inner punctuation); a last ``*`` marks a prefix."""
        out = []
        for term in tx.query_terms(query):
            parts = re.findall(r"[^\W_]+", term.lower().replace("*", ""))
            if parts:
                out.append(parts[:-1] + [parts[-1] + ("*" if term.endswith("*") else "")])
        return out

    def _where(self, word: str) -> Column:
        """Rows of a word, or of all words with a prefix: a folder and a range of terms."""
        folder = F.col("lead") == lead(F.lit(word))
        return folder & (F.col("term").startswith(word[:-1]) if word.endswith("*") else F.col("term") == word)

    def _positions(self, sequences: list[list[str]]) -> tuple[DataFrame, list[Column]]:
        """A row for each key with words of any sequence, and for each sequence the positions of its first words where all follow."""
        words = sorted({w for s in sequences for w in s})
        some = self._where(words[0])
        for w in words[1:]:
            some = some | self._where(w)
        at = [F.flatten(F.collect_list(F.when(self._where(w), F.col("positions")))).alias(f"p{k}") for k, w in enumerate(words)]
        met = self.rows.where(some).groupBy("key").agg(*at)
        starts = []
        for sequence in sequences:
            found = F.col(f"p{words.index(sequence[0])}")
            for k, word in enumerate(sequence[1:], 1):
                found = F.array_intersect(found, _shifted(F.col(f"p{words.index(word)}"), k))
            starts.append(found)
        return met, starts

    def words(self, query: str) -> DataFrame | None:
        """(key) of documents with all terms of the query; None if it has none."""
        return self._found(self.terms(query))

    def phrase(self, query: str) -> DataFrame | None:
        """(key) of documents with the terms one after another, only blanks and punctuation between."""
        parts = [w for s in self.terms(query.strip().strip('"')) for w in s]
        return self._found([parts]) if parts else None

    def _found(self, sequences: list[list[str]]) -> DataFrame | None:
        if not sequences:
            return None
        if sum(map(len, sequences)) == 1:
            return self.rows.where(self._where(sequences[0][0])).select("key").distinct()
        met, starts = self._positions(sequences)
        for found in starts:
            met = met.where(F.size(found) > 0)
        return met.select("key")

    def counts(self, query: str) -> DataFrame:
        """(term, documents, occurrences) of each word that the query names or whose prefix it gives."""
        words = sorted({w for s in self.terms(query) for w in s})
        some = F.lit(False)
        for w in words:
            some = some | self._where(w)
        return self.rows.where(some).groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))
