from pyspark.sql import functions as F

from lectern.operators import sequences, study


def test_tags_follow_words():
    a, tags = "the lord is my shepherd i shall not want".split(), list("abcdefghi")
    assert sequences.carried(a, tags, a) == tags
    assert sequences.carried(a, tags, "the lord is our shepherd i shall not want".split()) == list("abcdefghi")
    moved = sequences.carried("in the beginning god made the heaven".split(), list("abcdefg"), "god made the heaven in the beginning".split())
    assert moved == list("defgabc")
    assert sequences.carried(None, None, ["x"]) == [None]


def test_buckets_fold_a_short_tail(spark):
    got = spark.range(1).select(study.buckets_of(F.array(*[F.lit(x) for x in (50, 50, 60, 30, 10)]), 100, 130).alias("a"), study.buckets_of(F.array(*[F.lit(x) for x in (90, 90, 10)]), 100, 100).alias("b"), study.buckets_of(F.array(*[F.lit(x) for x in (95, 95, 10)]), 100, 110).alias("c")).first()
    assert got["a"] == [0, 0, 1, 1, 1] and got["b"] == [0, 1, 1] and got["c"] == [0, 1, 1]


def test_numbers_in_titles(spark):
    df = spark.createDataFrame([(t,) for t in ("Psalm 10", "psalm 9", "Psalm 100 a", "Acts")], "t string")
    assert [r[0] for r in df.orderBy(study.by_number(F.col("t"))).collect()] == ["Acts", "psalm 9", "Psalm 10", "Psalm 100 a"]


def test_ranges_split(spark):
    df = spark.createDataFrame([(8, 21), (30, 5)], "lo long, hi long")
    assert sorted((r["part_low"], r["part_high"]) for r in study.split_ranges(df, "lo", "hi", 10).collect()) == [(8, 9), (10, 19), (20, 21)]


def test_words_in_gaps_match_by_likeness_then_by_place():
    a, b = "he taketh the wells of honour and went unto them".split(), "he took the springs of honours and goes upon them".split()
    small = frozenset("unto upon the of and he them".split())
    found = sequences.aligned(a, b, {"taketh": {"took"}}, small)
    assert [m and m[1] for m in found] == ["same", "similar", "same", "position", "same", "similar", "same", None, None, "same"] or [m and m[1] for m in found][:7] == ["same", "similar", "same", "position", "same", "similar", "same"]
    assert all(m is None or m[0] == j for j, m in enumerate(found))
    one = sequences.aligned("x the y".split(), "x stone y".split(), None, frozenset(["the"]))
    assert one == [(0, "same"), None, (2, "same")]
    assert sequences.aligned("x the y".split(), "x an y".split(), None, frozenset(["the", "an"]))[1] == (1, "position")
    assert sequences.similar("heaven", "heavens") and sequences.similar("zidon", "sidon") and sequences.similar("maachah", "maacah") and not sequences.similar("the", "then")


def test_alignment_uses_each_word_once():
    import random

    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice(["aaaaa", "aaaab", "b", "bs", "c", "dd"]) for _ in range(rng.randrange(9))]
        b = [rng.choice(["aaaaa", "aaaab", "b", "bs", "c", "ee"]) for _ in range(rng.randrange(9))]
        found = sequences.aligned(a, b)
        places = [m[0] for m in found if m]
        assert len(places) == len(set(places)) and all(0 <= p < len(a) for p in places)
        for m, word in zip(found, b):
            assert m is None or (m[1] == "same") <= (a[m[0]] == word) and (m[1] != "similar" or sequences.similar(a[m[0]], word))
        want = max((len(x) for x in [sequences.in_order(a, b, lambda x, y: x == y)]), default=0)
        assert len(sequences.common(a, b)) == want


def test_senses_are_placed_before_they_are_paired(spark):
    rows = [(1, 7), (2, 7), (2, 7), (5, 7), (None, 7), (3, 8), (4, None), (6, 8)]
    wanted = [(2, 7), (5, 7), (9, 7), (3, 8), (4, None), (8, 99)]
    found = study.senses(spark.createDataFrame(rows, "id int, number int"), "number", "id", spark.createDataFrame(wanted, "wanted int, base int"))
    got = sorted((r["wanted"], r["place"], r["id"]) for r in found.collect())
    want = []
    for w, base in wanted:
        own = sorted((i for i, n in rows if n == base and base is not None), key=lambda i: (i != w, i is not None, i or 0))
        want += [(w, k + 1, i) for k, i in enumerate(own)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Window") and plan.index("Join") < plan.index("Sort ")


def test_senses_in_blocks_hold_copies(spark):
    rows = [(i, 7) for i in range(11)] + [(4, 7), (4, 7), (None, 7), (20, 8), (20, 8), (5, None)]
    wanted = [(4, 7), (4, 7), (4, 7), (0, 7), (10, 7), (30, 7), (None, 7), (20, 8), (20, 8), (5, None), (1, 99)]
    want = []
    for w, base in set(wanted):
        own = [i for i, n in rows if n == base and base is not None for _ in range(wanted.count((w, base)))]
        want += [(str(w), k + 1, str(i)) for k, i in enumerate(sorted(own, key=lambda i: (i is None or i != w, i is not None, i or 0)))]
    for sizes in ({}, {"block": 3, "run": 2}, {"block": 4, "run": 4}, {"block": 1, "run": 1}):
        found = study.senses(spark.createDataFrame(rows, "id int, number int"), "number", "id", spark.createDataFrame(wanted, "wanted int, base int"), **sizes)
        assert sorted((str(r["wanted"]), r["place"], str(r["id"])) for r in found.collect()) == sorted(want)


def test_senses_are_written_small(spark, tmp_path):
    rows = spark.range(1500).select("id", F.lit(7).alias("number"))
    found = study.senses(rows, "number", "id", rows.select(F.col("id").alias("wanted"), F.col("number").alias("base")))
    found.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1500 * 1500
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1500 * 1500 / 2


def test_senses_of_one_base_are_dealt_and_streamed(spark):
    rows = spark.range(60).select("id", F.lit(7).alias("number"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = study.senses(rows, "number", "id", rows.select(F.col("id").alias("wanted"), F.col("number").alias("base")), 10, 4)
        steps = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate inline(array_sort" in x]
        assert len(steps) == 1 and "*(" not in steps[0]  # generated code would hold all pairs of a block
        assert found.groupBy(F.spark_partition_id()).count().count() > 8 and found.count() == 3600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
