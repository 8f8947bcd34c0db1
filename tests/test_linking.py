"""Carried context, arbitration, spines of keys and conditioned rules against plain Python."""

import random

from pyspark.sql import functions as F

from lectern.operators import agreeing, linking

BOOKS = {"alpha": "A", "1 beta": "B"}
CHAPTERS = {("A", 1): 10, ("A", 2): 5, ("B", 1): 3}


def test_readings_of_texts(spark):
    texts = ["Alpha 2:3", "alpha 2", "ALPHA", "1 Beta. 1:2", "2:4", "7", "v. 5", "Gamma 1:1", "see there", "", None, "Alpha 1:2-9", "99999999999:1"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(linking.reading(F.col("t"), BOOKS)).collect()]
    assert got[:9] == [("Alpha", "A", 2, 3), ("alpha", "A", 2, None), ("ALPHA", "A", None, None), ("1 Beta", "B", 1, 2), (None, None, 2, 4), (None, None, None, 7), ("v", None, 5, None), ("Gamma", None, 1, 1), (None, None, None, None)]
    assert got[9] == (None,) * 4 and got[11] == ("Alpha", "A", 1, 2)


def plain(rows, trust):
    out, book, chapter = {}, None, None
    fine = lambda p: p is not None and (p[0], p[1]) in CHAPTERS and (p[2] is None or 1 <= p[2] <= CHAPTERS[p[0], p[1]])
    for at, (name, c, v), tag in rows:
        if name == "Gamma" and c is None and v is None:
            name = None  # a word alone that is no book
        code = BOOKS.get(name.lower()) if name else None
        own = None
        if c is not None or v is not None:
            own = (code if name else book, c if c is not None else (None if name else chapter), v)
        if own is None:
            status, ref = ("book" if code else "dropped"), None
        elif fine(tag) and fine(own):
            status = "ok" if tag == own else "kept" if trust else "fixed"
            ref = own if status == "fixed" else tag
        elif fine(own):
            status, ref = "fixed", own
        elif fine(tag) and (code if name else book or tag[0]) == tag[0]:
            status, ref = "unchecked", tag
        else:
            status, ref = "dropped", None
        out[at] = (status, ref)
        if name:
            book, chapter = code, (c or 1) if code else None
        elif c is not None:
            chapter = c if book else None
    return out


def test_context_and_decisions_equal_a_plain_pass(spark):
    rng = random.Random(3)
    rows, want = [], {True: {}, False: {}}
    for entry in ["x", "y", None]:
        some = []
        for at in range(150):
            name = rng.choice([None, None, None, "Alpha", "1 Beta", "Gamma"])
            c = rng.choice([None, 1, 2, 3])
            v = rng.choice([1, 4, 9, 99]) if c or not name else None
            if c is None and rng.random() < 0.2 and not name:
                v = None
            if name is None and c is not None and v is None:
                v = 1
            tag = rng.choice([None, ("A", 1, 4), ("A", 2, 4), ("B", 1, 1), ("Z", 1, 1), ("A", 2, None)])
            some.append((at, (name, c, v), tag))
        for trust in want:
            want[trust] |= {(entry, at): r for at, r in plain(some, trust).items()}
        for at, (name, c, v), tag in some:
            numbers = f"{c}:{v}" if c and v else str(c or v or "")
            rows.append((entry, at, f"{name or ''} {numbers}".strip() or "nothing", tag))
    df = spark.createDataFrame(rows, f"entry string, at int, text string, tag {linking.PLACE}").repartition(4)
    chapters = spark.createDataFrame([(*k, n) for k, n in CHAPTERS.items()], "book string, chapter int, verses int")
    for trust in (False, True):
        for bucket in (None, F.expr("at div 20")):
            found = linking.linked(df, "entry", "at", "text", "tag", BOOKS, chapters, bucket, trust)
            assert found.columns == ["entry", "at", "text", "tag", "status", "ref"]
            assert {(r["entry"], r["at"]): (r["status"], r["ref"] and tuple(r["ref"])) for r in found.collect()} == want[trust]


def test_sources_on_a_spine(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, v int")
    joined = agreeing.on_spine(spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", {"a": make([(1, 5), (2, 6), (9, 1)]), "b": make([(1, 5), (2, 7)])}, "v")
    assert sorted(map(str, map(tuple, joined.collect()))) == ["(1, True, 5, 5)", "(2, True, 6, 7)", "(3, True, None, None)", "(9, False, 1, None)"]
    assert agreeing.accounted(joined, ["a", "b"]).first().asDict() == {"keys": 4, "expected": 3, "unexpected": 1, "without": 1, "in_a": 3, "in_b": 2, "agree_a_b": 1, "differ_a_b": 1}


def test_rules_need_all_their_conditions(spark):
    facts = spark.createDataFrame([(1, "g", "m", 5), (1, "g", "n", 1), (2, "g", "m", 5), (3, "h", "m", 5), (4, "g", "m", None), (4, "g", "n", 1)], "k int, grp string, measure string, value int")
    rules = spark.createDataFrame([(10, "g", "m", 1, 9), (10, "g", "n", 1, None), (11, "g", "m", None, 5), (12, "h", "m", 6, None)], "rule int, grp string, measure string, least int, most int")
    assert sorted(map(tuple, agreeing.rules_holding(facts, "k", "grp", rules).collect())) == [(1, 10), (2, 11)]


def test_a_text_is_read_once(spark):
    """Once where rows are scanned in order and once where buckets are summed up, however many parts of the reading are used."""
    rows = spark.createDataFrame([("x", 1, "Alpha 2:3", None)], f"entry string, at int, text string, tag {linking.PLACE}")
    chapters = spark.createDataFrame([("A", 2, 5)], "book string, chapter int, verses int")
    plan = linking.linked(rows, "entry", "at", "text", "tag", BOOKS, chapters, F.expr("at div 20"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == plan.count("regexp_extract_all(") == 2
