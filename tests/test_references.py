import pytest
from pyspark.sql import functions as F

from lectern.functions import refs
from lectern.operators import references


@pytest.fixture(scope="module")
def known(spark):
    return references.books(spark, [("GEN", 3, ["genesis", "gen"]), ("PSA", 4, ["psalms", "ps"]), ("1SA", 2, ["1samuel", "1sam"]), ("PHP", 4, ["philippians", "phil"]), ("PHM", 1, ["philemon"]), ("JUD", 1, ["jude", "jd"])])


@pytest.fixture(scope="module")
def verses(spark):
    counts = {"GEN": [31, 25, 24], "PSA": [6, 12, 8, 8], "1SA": [28, 36], "PHP": [30, 30, 21, 23], "PHM": [25], "JUD": [25]}
    rows = [(b, i, c, n) for i, (b, ns) in enumerate(counts.items(), 1) for c, n in enumerate(ns, 1)]
    return spark.createDataFrame(rows, "book string, book_index int, chapter int, n_verses int")


CASES = {
    "Gen 1:1": "GEN.1.1", "gen. 2": "GEN.2", "Genesis": "GEN.1", "1 Sam 2:3-5": "1SA.2.3-5", "First Samuel 1": "1SA.1", "I Samuel 1:28": "1SA.1.28", "Gen 1:1-2:3": "GEN.1.1-2.3",
    "Jude 3": "JUD.1.3", "Jude 1": "JUD.1", "Jude 1:3": "JUD.1.3", "Jude 3-5": "JUD.1.3-5", "Ps 1-3": "PSA.1", "Ps 3-1": None, "Gen 4": None, "Gen 1:32": None, "Gen 1:5-3": None, "Gen 1:3-3": "GEN.1.3",
    "Gene 1": "GEN.1", "Philem 2": "PHM.1.2", "Phil 2": "PHP.2", "Phi 2": None, "Ge 1": None, "xyz 1": None, "": None, "Gen 1v3": "GEN.1.3", "Gen 1:1, 5": "GEN.1.1", "The Book of Psalms 2": "PSA.2", "Gen 2:1-3:99": None,
}


def test_parse(spark, known, verses):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "typed string")
    got = {r["typed"]: r["c"] for r in references.parse(df, "typed", known, verses).select("typed", refs.compact(F.col("ref")).alias("c")).collect()}
    assert got == CASES | {None: None}


def test_compact_round_trip(spark):
    texts = ["JHN.3", "JHN.3.16", "JHN.3.16-18", "JHN.3.16-4.2"]
    df = spark.createDataFrame([(t,) for t in [*texts, "JHN", "jhn.3", "JHN.3.", None]], "t string")
    assert [r[0] for r in df.select(refs.compact(refs.from_compact(F.col("t")))).collect()] == [*texts, None, None, None, None]


def test_numbers_and_containment(spark):
    out = spark.range(1).select(refs.from_verse_id(refs.verse_id(F.lit(19), F.lit(51), F.lit(0))).alias("v"), refs.verse_id(F.lit(19), F.lit(51), F.lit(0)).alias("n")).first()
    assert out["n"] == 19051000 and tuple(out["v"]) == (19, 51, 0)
    cases = [("A11.3", 3, 99, True), ("A11.3.16", 3, 16, True), ("A11.3.16", 3, 17, False), ("A11.3.16-4.2", 3, 40, True), ("A11.3.16-4.2", 4, 3, False), ("A11.3.2-5", 3, 5, True), ("A11.3.2-5", 4, 3, False)]
    df = spark.createDataFrame(cases, "t string, c int, v int, want boolean")
    assert all(r[0] == r[1] for r in df.select(refs.contains(refs.from_compact(F.regexp_replace("t", "A11", "ABC")), F.lit("ABC"), F.col("c"), F.col("v")), "want").collect())


def test_tables(spark, known, verses):
    chapters = references.chapter_table(verses)
    assert {(r["book"], r["chapter"]): r["start_ord"] for r in chapters.collect()}["PSA", 2] == 31 + 25 + 24 + 6
    df = spark.createDataFrame([("GEN.1.30-2.2",), ("GEN.2",), ("GEN.9",), ("PSA.1.7",), ("PSA.1.5-9",), ("PSA.2.3-1.2",)], "t string").withColumn("ref", refs.from_compact(F.col("t")))
    assert {r["t"] for r in references.valid(df, "ref", verses).collect()} == {"GEN.1.30-2.2", "GEN.2"}
    found = references.verses_of(df.where("t like 'GEN.1%'"), "ref", verses).select("chapter", "verse").collect()
    assert sorted(tuple(r) for r in found) == [(1, 30), (1, 31), (2, 1), (2, 2)]
    keyed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    rules = spark.createDataFrame([("a", "z")], "from_key string, to_key string")
    fallback = spark.createDataFrame([("c", "y"), ("c", "y"), ("d", "x"), ("d", "w")], "from_key string, to_key string")
    out = references.remapped(keyed, "k", rules, spark.createDataFrame([("a",), ("b",)], "key string"), fallback)
    assert {r["k"]: r["target"] for r in out.collect()} == {"a": "z", "b": "b", "c": "y", "d": None}


def test_kin(spark):
    people = spark.createDataFrame([("a", None, None, ["b"]), ("c", "a", "b", []), ("d", "a", "b", []), ("e", "c", None, ["e"])], "id string, father string, mother string, partners array<string>")
    got = {(r["person"], r["relative"]): r["kind"] for r in references.kin(people).collect()}
    assert got == {("a", "b"): "partner", ("c", "a"): "parent", ("c", "b"): "parent", ("d", "a"): "parent", ("d", "b"): "parent", ("a", "c"): "child", ("a", "d"): "child", ("b", "c"): "child", ("b", "d"): "child", ("c", "d"): "sibling", ("d", "c"): "sibling", ("e", "c"): "parent", ("c", "e"): "child", ("e", "a"): "grandparent", ("e", "b"): "grandparent"}


def test_kin_is_dealt_before_it_is_grouped(spark, tmp_path):
    """Few pairs are repeated: grouping or broadcasting them before they are dealt fills the memory of one task."""
    spark.createDataFrame([(i, i // 4 or None, None, [i + 1 - i % 2 * 2]) for i in range(1, 200)], "id long, father long, mother long, partners array<long>").write.parquet(f"{tmp_path}/people")
    found = references.kin(spark.read.parquet(f"{tmp_path}/people"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortAggregate" not in plan
    assert plan.rindex("HashAggregate") < plan.index("Exchange")
    got = {(r["person"], r["relative"]): r["kind"] for r in found.collect()}
    assert got[20, 5] == "parent" and got[5, 20] == "child" and got[20, 21] == "partner" and got[20, 22] == "sibling" and got[20, 1] == "grandparent" and len(got) == found.count()


def test_ordinals_of_many_books_are_summed_by_ranges(spark, monkeypatch):
    rows = [(f"b{b}", b, c, 1 + (b * 7 + c) % 5) for b in [*range(0, 600, 3), 10**12] for c in range(1, 4)]
    counts = spark.createDataFrame(rows, "book string, book_index long, chapter int, n_verses int").repartition(3)
    seen, total = [], references.running_total
    monkeypatch.setattr(references, "running_total", lambda df, order, value, bucket, out: seen.append(df.select(bucket.alias("b")).distinct().count()) or total(df, order, value, bucket, out))
    got = {(r["book_index"], r["chapter"]): (r["start_ord"], r["end_ord"]) for r in references.chapter_table(counts, ranges=7).collect()}
    at, want = 0, {}
    for _, b, c, n in rows:
        want[b, c] = at, at + n - 1
        at += n
    assert got == want and 3 <= seen[0] <= 8
    assert references.chapter_table(counts.limit(0)).count() == 0
