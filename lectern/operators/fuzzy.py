"""Fuzzy joins of words with dictionary forms, in blocks of equal keys, and what their evidence decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.tables import scratch

#: Up to this length, words one edit apart meet on what is left when a letter is taken out; longer ones on half of each.
SHORT = 24


def edit_keys(word: Column, tag: str) -> Column:
    """array<string>: two words at most one edit apart share a key.

    A short word has itself and itself less each of its letters.  Of two longer words one half is untouched by the edit:
    the keys are both halves, as long as the shorter of the two words makes them.
    """
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(tag), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    none = F.array().cast("array<string>")

    def halves(size: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        mark = F.concat(F.lit(tag), size.cast("string"))
        return F.array(F.concat(mark, F.lit("<"), F.substring(word, F.lit(1), half)), F.concat(mark, F.lit(">"), F.substring(word, n - half + 1, half)))

    short = F.when(n.between(1, SHORT + 1), F.array_append(less, F.concat(F.lit(tag), word))).otherwise(none)
    long = F.when(n > SHORT, halves(n)).otherwise(none)
    longer = F.when(n > SHORT + 1, halves(n - 1)).otherwise(none)
    return F.array_distinct(F.concat(short, long, longer))


def one_edit_pairs(rows: DataFrame, id: str, word: str, *same: str) -> DataFrame:
    """(a, b), a < b: ids of rows whose words are at most one edit apart and whose other columns ``same`` are equal.

    Distinct words meet on the keys of edit_keys, never all with all, and the ids of their rows follow; null words meet nothing.
    A row has as many keys as its word has letters, of which Spark's estimate by file size knows nothing, so these joins are
    sorted, never broadcast.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    known = rows.where(F.col(word).isNotNull()).select(F.col(id).alias("a"), F.col(word).alias("_x"), *same).repartition(tasks, "_x", *same)
    keyed = known.select("_x", *same).distinct().select("*", F.explode(F.array_append(edit_keys(F.col("_x"), ""), "")).alias("_key"))
    # the key of all is for words of one letter and none; others need it not
    keyed = keyed.where((F.col("_key") != "") | (F.length("_x") <= 1))
    other = keyed.withColumnRenamed("_x", "_y")
    near = keyed.join(other.hint("merge"), ["_key", *same]).where(F.levenshtein("_x", "_y", 1) >= 0).select("_x", "_y", *same).distinct()
    left = near.join(known.hint("merge"), ["_x", *same])
    right = known.select(F.col("a").alias("b"), F.col("_x").alias("_y"), *same)
    return left.join(right.hint("merge"), ["_y", *same]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def _trigrams(word: Column) -> Column:
    return F.when(F.length(word) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of distinct strings, three letters or more within another: they meet on the inner one's rarest trigram."""
    grams = outer.select("outer", F.explode(_trigrams(F.col("outer"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    of = inner.select("inner", F.explode(_trigrams(F.col("inner"))).alias("gram"))
    # a string with a trigram that no other has is within none
    known = of.join(counts, "gram", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).where("rarest.n > 0")
    return known.select("inner", F.col("rarest.gram").alias("gram")).join(grams, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def word_matches(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, form, strong) for distinct words (word, bare, loose) and forms (form, bare, loose) that are alike.

    bare: the letters that count, loose: fewer of them (say, without vowels).  Strong: equal bare, equal loose of two letters
    or more, one bare of three letters or more within the other, or loose one edit apart (both of three or more).
    Weak: also bare or loose one edit apart from two letters on.  Null and empty strings match nothing.
    """
    a = words.where("bare <> ''").select("word", F.col("bare").alias("a"), F.coalesce("loose", F.lit("")).alias("al")).distinct()
    b = forms.where("bare <> ''").select("form", F.col("bare").alias("b"), F.coalesce("loose", F.lit("")).alias("bl")).distinct()

    def keyed(df: DataFrame, bare: str, loose: str) -> DataFrame:
        one = F.array(F.concat(F.lit("="), bare))
        two = lambda c, tag: F.when(F.length(c) >= 2, edit_keys(F.col(c), tag)).otherwise(F.array().cast("array<string>"))
        return df.select(bare, loose, F.explode(F.array_distinct(F.concat(one, two(bare, "b:"), two(loose, "l:")))).alias("key"))

    # pairs of spellings, not of words: a key with many words of one spelling is met once
    left, right = keyed(a.select("a", "al").distinct(), "a", "al"), keyed(b.select("b", "bl").distinct(), "b", "bl")
    near = lambda x, y, least: (F.length(x) >= least) & (F.length(y) >= least) & (F.levenshtein(F.col(x), F.col(y), 1) >= 0)
    strong = (F.col("a") == F.col("b")) | ((F.length("al") >= 2) & (F.col("al") == F.col("bl"))) | near("al", "bl", 3)
    met = left.join(right, "key").select("a", "al", "b", "bl").distinct()
    edits = met.withColumn("strong", strong).where(F.col("strong") | near("a", "b", 2) | near("al", "bl", 2))
    within = contained(b.select(F.col("b").alias("inner")).distinct(), a.select(F.col("a").alias("outer")).distinct()).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    around = contained(a.select(F.col("a").alias("inner")).distinct(), b.select(F.col("b").alias("outer")).distinct()).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    held = within.unionByName(around).distinct().join(a.select("a", "al").distinct(), "a").join(b.select("b", "bl").distinct(), "b").select("a", "al", "b", "bl", F.lit(True).alias("strong"))
    spelled = edits.unionByName(held).groupBy("a", "al", "b", "bl").agg(F.max("strong").alias("strong"))
    return spelled.join(a, ["a", "al"]).join(b, ["b", "bl"]).groupBy("word", "form").agg(F.max("strong").alias("strong"))


def evidence(near: DataFrame, forms: DataFrame, matches: DataFrame, head: int = 3) -> DataFrame:
    """(id, key, strong): how well the words near the start of an entry speak for a key.

    near: (id, place, word) of the first words, places from 0; forms: (key, form); matches: of word_matches.  Strong if one of the first
    ``head`` words matches a form of the key strongly, else weak.
    """
    met = near.select("id", "place", "word").join(matches, "word").join(forms.select("key", "form").distinct(), "form")
    return met.groupBy("id", "key").agg(F.max(F.col("strong") & (F.col("place") < head)).alias("strong"))


def resolved(keys: DataFrame, found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key, id, status) for all keys: strong evidence is kept, weak evidence where a key has none that is strong, else dropped.

    keys: (key); found: of evidence(); mentions: (id, key) of entries that name a key anywhere.  A key left
    without an entry is restored to the first entry that mentions it, or is missing, with a null id.
    """
    closer = found.where("strong").select("key").distinct().withColumn("closer", F.lit(True))
    judged = found.join(closer, "key", "left").select("key", "id", F.when(F.col("strong"), "strong").when(F.col("closer"), "dropped").otherwise("weak").alias("status"))
    open_keys = keys.select("key").distinct().join(found.select("key"), "key", "left_anti")
    first = mentions.groupBy("key").agg(F.min("id").alias("id"))
    rest = open_keys.join(first, "key", "left").select("key", "id", F.when(F.col("id").isNull(), "missing").otherwise("restored").alias("status"))
    return judged.unionByName(rest)


def resolve_words(words: DataFrame, forms: DataFrame, near: int = 8, head: int = 3) -> DataFrame:
    """resolved() of words (id, place, word, bare, loose) against forms (key, form, bare, loose).

    Only keys that no entry's first words speak for look at all words of all entries; of each word only its first
    entry is kept, before the shuffle, since a key is restored to the first entry that mentions it.  What is used again and again
    is written first, so that entries are read twice in all.
    """

    def written(df: DataFrame) -> DataFrame:
        path = scratch(df.sparkSession)
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    first = written(words.where(F.col("place") < near))
    found = written(evidence(first, forms, word_matches(first, forms), head))
    rest = forms.join(found.select("key").distinct(), "key", "left_anti")
    known = written(words.groupBy("word", "bare", "loose").agg(F.min("id").alias("id")))
    strong = word_matches(known, rest).where("strong").select("word", "form")
    mentions = known.select("id", "word").join(strong, "word").join(rest.select("key", "form").distinct(), "form").select("id", "key")
    return resolved(forms, found, mentions)
