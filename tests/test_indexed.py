"""The word index, bucketed tables and fuzzy joins: results against brute force, and plans."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import fuzzy, lookup, postings
from lectern.tables import scratch

TEXTS = [
    (1, "Of the love, of THE world"), (2, "of  -- the lover; love2 x"), (3, "of + the"), (4, "thé of"), (5, None), (6, ""), (7, "off the of-the loved"),
    (8, "of\nthe of the of the"), (9, "+++ the of"), (10, "lo ve Beloved loveth"), (11, "漢字 of 漢字 the"), (1, "again love"), (12, "the " * 20_000 + "of the end"),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(TEXTS, "key_id int, text string").unionByName(spark.createDataFrame([(None, "of the")], "key_id int, text string")).repartition(3)
    path = scratch(spark)
    postings.write_index(df, path, "key_id", "text")
    return postings.WordIndex(spark, path, "int"), df.where("key_id is not null")


@pytest.mark.parametrize("query", ["of", "the of", "lov*", "love", "of*", "漢字", "th* love", "nothing here", "zz*"])
def test_index_finds_what_patterns_find(index, query):
    words, df = index
    want = {r[0] for r in df.where(tx.words_query(F.col("text"), query)).select("key_id").collect()}
    if query == "th* love":  # rows of one key add up
        want.add(1)
    assert {r[0] for r in words.words(query).collect()} == want


@pytest.mark.parametrize("query", ['"of the"', "the of", "of the of the", "the of the end", "of the lov*", "of the 漢字", "the end*"])
def test_phrases_follow_each_other(index, query):
    words, df = index
    found = words.phrase(query)
    assert sorted(r[0] for r in found.collect()) == sorted({r[0] for r in df.where(tx.phrase_query(F.col("text"), query)).select("key_id").collect()})


def test_index_reads_only_the_folders_of_its_terms(index, capsys):
    words, _ = index
    assert words.words(" .. ") is None and words.phrase('"?!"') is None
    for df in (words.words("of lov*"), words.phrase("of the")):
        df.explain("formatted")
        shown = capsys.readouterr().out
        assert "PartitionFilters: [" in shown and re.search(r"PartitionFilters: \[.*lead", shown) and re.search(r"PushedFilters: \[.*(EqualTo\(term,of\)|StringStartsWith)", shown)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    counted = {r["term"]: (r["documents"], r["occurrences"]) for r in words.counts("lov* of").collect()}
    assert counted["love"] == (1, 2) and counted["love2"] == (1, 1) and counted["of"][0] == 9


def test_prefix_goes_on_into_digits_and_terms_lose_their_edges():
    assert tx.query_terms(" «lov*», the!  -- * _x_ ") == ["lov*", "the", "_x_"]


def test_bucketed_lookup_and_join_shuffle_nothing(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.randrange(50), f"a{i}") for i in range(300)] + [(None, "x")], "k long, a string")
    right = spark.createDataFrame([(rng.randrange(60), i) for i in range(400)] + [(None, 1)], "other long, b int")
    name = lambda: f"t_{uuid.uuid4().hex}"
    x = lookup.BucketedTable.write(left, name(), scratch(spark), "k", 8)
    y = lookup.BucketedTable.write(right, name(), scratch(spark), "other", 8)
    met = x.with_columns_of(y)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = x.with_columns_of(y)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, left.join(right.withColumnRenamed("other", "k"), "k").collect()))
        assert x.with_columns_of(y, "left").count() == left.join(right, F.col("k") == F.col("other"), "left").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    some = x.get([3, 7, None, 3])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan prunes without saying so
    try:
        assert re.search("SelectedBucketsCount: [12] out of 8", x.get([3, 7, None, 3])._jdf.queryExecution().toString())
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, left.where("k in (3, 7)").collect()))
    assert x.get([]).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def judged(a, al, b, bl):
    if not a or not b:
        return None
    if a == b or (len(al) >= 2 and al == bl) or (len(b) >= 3 and b in a) or (len(a) >= 3 and a in b) or (min(len(al), len(bl)) >= 3 and distance(al, bl) <= 1):
        return True
    return False if (min(len(a), len(b)) >= 2 and distance(a, b) <= 1) or (min(len(al), len(bl)) >= 2 and distance(al, bl) <= 1) else None


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abtrn") for _ in range(rng.randrange(0, 7))) for _ in range(n)]
    long = "".join(rng.choice("bcdfg") for _ in range(26))
    words += [long, long[1:], long[:9] + long[10:], long[:20] + "z" + long[21:], long + "x", long[:24], long[:25], long[:12] + "q" + long[12:24], "n" * 3000, "n" * 3001]
    return [(w, w, re.sub("[aeiou]", "", w)) for w in words]


def test_word_matches_equal_all_pairs(spark):
    a, b = made(1, 120), made(2, 60)
    left, right = spark.createDataFrame([*a, (None, None, None)], "word string, bare string, loose string"), spark.createDataFrame([*b, ("x", None, None)], "form string, bare string, loose string")
    want = {(w, f, judged(w, wl, f, fl)) for w, _, wl in a for f, _, fl in b if max(len(w), len(f)) < 100 or w == f or len(w) + len(f) == 6001 or (len(f) >= 3 and f in w) or (len(w) >= 3 and w in f)}
    assert {tuple(r) for r in fuzzy.word_matches(left, right).collect()} == {x for x in want if x[2] is not None}


def test_strong_then_weak_then_restored(spark):
    words = [(1, 0, "stone"), (1, 1, "tree"), (2, 0, "x"), (2, 1, "y"), (2, 2, "z"), (2, 3, "stane"), (3, 0, "ab"), (3, 9, "river"), (4, 9, "river"), (4, 0, "zz"), (5, 0, None)]
    forms = [("S", "stone"), ("R", "rivers"), ("A", "ac"), ("N", "nowhere"), ("E", "")]
    spell = lambda df, c: df.withColumns({"bare": F.col(c), "loose": F.regexp_replace(c, "[aeiou]", "")})
    found = fuzzy.resolve_words(spell(spark.createDataFrame(words, "id int, place int, word string"), "word"), spell(spark.createDataFrame(forms, "key string, form string"), "form"))
    assert {tuple(r) for r in found.collect()} == {("S", 1, "strong"), ("S", 2, "dropped"), ("A", 3, "weak"), ("R", 3, "restored"), ("N", None, "missing"), ("E", None, "missing")}
    empty = spell(spark.createDataFrame([], "id int, place int, word string"), "word")
    assert {r["status"] for r in fuzzy.resolve_words(empty, spell(spark.createDataFrame(forms, "key string, form string"), "form")).collect()} == {"missing"}


def test_pairs_one_edit_apart_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))), rng.randrange(2)) for i in range(120)]
    long = "".join(rng.choice("xyz") for _ in range(40))
    rows += [(500, long, 0), (501, long[1:], 0), (502, long[:39] + "q", 0), (503, long[:10] + "--" + long[10:], 0), (504, None, 0), (505, long, 1)]
    found = fuzzy.one_edit_pairs(spark.createDataFrame(rows, "id int, w string, g int"), "id", "w", "g")
    want = {(a, b) for a, x, g in rows for b, y, h in rows if a < b and g == h and x is not None and y is not None and distance(x, y) <= 1}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_pairs_one_edit_apart_are_not_broadcast(spark, tmp_path):
    """A small file whose words have many keys and many copies."""
    rows = [(i, f"some longer word {i % 4}", i % 2) for i in range(40)] + [(40, None, 0), (41, "some longer word 0", None)]
    spark.createDataFrame(rows, "id int, w string, g int").write.parquet(f"{tmp_path}/rows")
    found = fuzzy.one_edit_pairs(spark.read.parquet(f"{tmp_path}/rows"), "id", "w", "g")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2]


def test_words_are_grouped_inside_their_row(spark, tmp_path):
    """A word by itself is never a row, so nothing but whole postings is sorted and shuffled, once."""
    df = spark.createDataFrame([(1, "b a + a b b"), (2, None), (3, " ++ "), (None, "a")], "k int, t string").repartition(2)
    df.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = postings.postings(docs, "k", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["term"], r["key"], r["positions"]) for r in found.collect()) == [("a", 1, [1, 3]), ("b", 1, [0, 4, 5])]
    postings.write_index(docs, f"{tmp_path}/index", "k", "t")
    words = postings.WordIndex(spark, f"{tmp_path}/index", "int")
    assert [words.phrase(p).count() for p in ("b a", "a a", "a b b", "b a b")] == [1, 0, 1, 0]


def test_words_of_entries_are_read_twice(spark):
    """Once for the first words and once for all: not again for each use of either."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda w: made.add(1) or w, "string").asNondeterministic()
    words = [(i, p, w) for i in range(20) for p, w in enumerate(["stone", "river", f"other{i}", "cliff"] * 3)]
    df = spark.createDataFrame(words, "id int, place int, word string").withColumn("word", seen("word"))
    spell = lambda d, w: d.withColumns({"bare": F.col(w), "loose": F.regexp_replace(w, "[aeiou]", "")})
    forms = spell(spark.createDataFrame([("a", "stone"), ("b", "missing"), ("c", "other19")], "key string, form string"), "form")
    got = {(r["key"], r["id"], r["status"]) for r in fuzzy.resolve_words(spell(df, "word"), forms).collect()}
    assert ("b", None, "missing") in got and ("a", 7, "strong") in got and ("c", 19, "strong") in got
    assert made.value <= 2 * len(words)
