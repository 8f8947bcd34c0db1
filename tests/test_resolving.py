from pyspark.sql import functions as F

from lectern.functions import codes, geo
from lectern.operators import resolving


def test_aliases(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "missing"), ("e1", "e2"), ("e2", "e3"), ("e3", "e4"), ("e4", "e5"), ("e5", "a")]
    got = {r["k"]: (r["target"], r["status"]) for r in resolving.alias_targets(spark.createDataFrame(rows, "k string, l string"), "k", "l").collect()}
    assert got["a"] == got["b"] == got["c"] == ("a", "ok")
    assert got["z"] == ("missing", "broken") and got["x"][1] == got["y"][1] == "loop" and got["e1"] == ("a", "ok")


def test_number_lists(spark):
    texts = ["1254-57", "430, 430, 13l", "8+etc.", "20-40", "9–7", "0, 9000", "3 (or 4)", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", codes.numbers_listed(F.col("t")).alias("f")).orderBy("i").collect()
    got = [r["f"] and (r["f"]["nums"], r["f"]["irregular"]) for r in got]
    assert got[:7] == [([1254, 1255, 1256, 1257], []), ([430, 131], []), ([8], []), ([20, 40], ["20-40"]), ([], ["9–7"]), ([], ["0", "9000"]), ([3, 4], ["3 (or 4)"])]
    assert got[7] == ([], [])


def test_spans(spark):
    df = spark.createDataFrame([("18:1",), ("10:4-5",), ("25:19-26:1",), ("3:9-2",), ("x",)], "t string")
    got = df.select(codes.verses_named(F.col("t")).alias("v")).select("v", codes.verse_span(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in got] == ["18:1", "10:4-5", "25:19-26:1", None, None]
    assert [tuple(v) for v in got[1]["v"]] == [(10, 4), (10, 5)] and got[3]["v"] is None


def test_quotes(spark):
    df = spark.createDataFrame([('say "yes" -- or ("no")',), ('<b class="x">"a"</b>"',), ('a<b>"c"',), ('1 < 2 "x"',), ("",)], "t string")
    assert [r[0] for r in df.select(codes.typographic(F.col("t"))).collect()] == ["say “yes” — or (“no”)", '<b class="x">“a”</b>”', "a<b>”c”", "1 < 2 “x”", ""]


def test_briefs(spark):
    known = spark.createDataFrame([("H:N-M", "Hebrew Noun (Masculine)"), ("H:V", "Hebrew Verb"), ("G:A / G:B", "either")], "code string, text string")
    asked = spark.createDataFrame([(c,) for c in ("H:N-M", "A:N-M", "H:N-M / H:V", "H:V+A:V", "G:A/ G:B", "H:V / ?", " ", None)], "c string")
    got = {r["c"]: r["text"] for r in resolving.briefs_described(asked, "c", known).collect()}
    assert got == {"H:N-M": "Hebrew Noun (Masculine)", "A:N-M": "Aramaic Noun (Masculine)", "H:N-M / H:V": "Hebrew Noun (Masculine) OR Hebrew Verb", "H:V+A:V": "Hebrew Verb + Aramaic Verb", "G:A/ G:B": "either", "H:V / ?": None, " ": None}


def test_segments_take_words_in_turn():
    run = lambda *ns, again=False: {"numbers": list(ns), "again": again}
    assert resolving.paired([run("a"), run(), run("a"), run("b")], [["a"], ["b"], ["a"]]) == [[0], [], [2], [1]]
    assert resolving.paired([run("h"), run("h", again=True)], [["h"], ["h"]]) == [[0], [0]]
    assert resolving.paired([run("p"), run("q"), run("p")], [["p"], ["q"]]) == [[0], [1], [0]]
    assert resolving.paired([run("k"), run("z")], [["m"]], {"k": ["m"]}) == [[0], []]
    assert resolving.paired(None, None) == []


def test_label_point(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    square, hole = ring([(0, 0), (8, 0), (8, 4), (0, 4)]), ring([(3, 1), (5, 1), (5, 3), (3, 3)])
    got = spark.range(1).select(geo.label_point(F.array(square)).alias("a"), geo.label_point(F.array(square, hole)).alias("b"), geo.label_point(F.array(ring([(0, 0), (1, 1)]))).alias("c")).first()
    assert abs(got["a"]["y"] - 2) < 0.05 and 1.9 <= got["a"]["x"] <= 6.1
    assert got["b"]["x"] < 3 or got["b"]["x"] > 5
    assert got["c"] is None


def test_places(spark):
    schema = "id string, identifications array<struct<score:double,special:string,resolutions:array<struct<lonlat:string,basis:string,special:string>>>>"
    rows = [("far", [(1011.0, None, [("35.5,31.7", "m1", None)])]), ("none", []), ("odd", [(5.0, None, [("east,1", None, None)])]), ("lost", [(5.0, "not a place", None), (4.0, None, [("1,2", None, None)])])]
    got = {r["id"]: r for r in resolving.located(spark.createDataFrame(rows, schema), spark.createDataFrame([], "basis string, custom_lonlat string")).collect()}
    assert (got["far"]["lon"], got["far"]["lat"], got["far"]["score"], got["far"]["custom"]) == (35.5, 31.7, 1000, False)
    assert [got[k]["reason"] for k in ("far", "none", "odd", "lost")] == [None, "no identification", "bad coordinates", "not a place"]


def test_words_of_many_copies_are_paired_in_order():
    """The free words of a number are not listed anew for each segment."""
    import random
    import time

    def plain(segments, words, kin):
        taken, before, alike, at, out = set(), {}, {}, 0, []
        for s in segments:
            mine = {}
            for n in s["numbers"]:
                def free(numbers):
                    places = [i for i, own in enumerate(words) if i not in taken and set(own) & set(numbers)]
                    return next((p for p in places if p >= at), places[0] if places else None)

                tries = [before.get(n) if s["again"] else None, free([n]), free(kin.get(n, ())), alike.get(tuple(s["numbers"]), {}).get(n)]
                place = next((p for p in tries if p is not None), None)
                if place is not None:
                    mine[n] = place
                    if place not in taken:
                        taken.add(place)
                        at = place + 1
            if s["numbers"]:
                before = mine
            if mine:
                alike[tuple(s["numbers"])] = mine
            out.append(sorted(set(mine.values())))
        return out

    rng = random.Random(4)
    kin = {"a": ["b"], "b": ["c", "d"]}
    for _ in range(200):
        draw = lambda most: [rng.choice("abcde") for _ in range(rng.randrange(most))]
        segments = [{"numbers": draw(4), "again": rng.random() < 0.2} for _ in range(rng.randrange(12))]
        words = [draw(4) for _ in range(rng.randrange(12))]
        assert resolving.paired(segments, words, kin) == plain(segments, words, kin)
    began = time.time()
    many = [{"numbers": ["a"], "again": False}] * 20_000
    assert resolving.paired(many, [["a"]] * 20_000) == [[i] for i in range(20_000)]
    assert time.time() - began < 5


def test_segments_of_a_batch_are_objects_a_few_at_a_time(spark):
    from pyspark.sql import functions as F

    df = spark.range(2 * resolving.ROWS + 7).coalesce(1).select("id", F.array(F.struct(F.array(F.lit("a")).alias("numbers"), F.lit(False).alias("again"))).alias("s"), F.array(F.array((F.when(F.col("id") % 2 == 0, "a").otherwise("b")))).alias("w"))
    got = {r["id"]: r["p"] for r in df.select("id", resolving.segment_words(F.col("s"), F.when(F.col("id") > 0, F.col("w"))).alias("p")).collect()}
    assert got == {i: [[0]] if i and i % 2 == 0 else [[]] for i in range(2 * resolving.ROWS + 7)}
