import pytest
from pyspark.sql import functions as F

from lectern.functions import markup, paths, practice, words
from lectern.operators import lexicon


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_words(spark):
    placed = one(spark, words.placed(F.lit("“Don't go,” well-known Zoë!")))[0]
    assert [(w["word"], w["start"]) for w in placed] == [("Don't", 1), ("go", 7), ("well-known", 12), ("Zoë", 23)]
    got = one(spark, words.plain(F.lit("Æneas’s")), words.latin_only(F.lit("’Ābîb")), words.consonants(F.lit("מֶלֶךְ")), words.loose_consonants(F.lit("שָׁלוֹם")))
    assert got == ("aeneass", "abib", "מלכ", "שלמ")
    pairs = [("walk", "walked"), ("colour", "color"), ("ox", "axe"), ("same", "same"), ("house", "mouse")]
    assert [one(spark, words.alike(F.lit(a), F.lit(b)))[0] for a, b in pairs] == [True, True, False, True, True]
    assert one(spark, words.titled(F.lit("THE SONG OF the well-known king henry iv")))[0] == "The Song of the Well-Known King Henry IV"


def test_brackets_and_codes(spark):
    got = one(spark, words.split_outside(F.lit("a (b; c); d; e"), ";"), words.split_outside(F.lit("(a; b)"), ";"), words.balanced(F.lit("a) (b) c)")))
    assert tuple(got[0]) == ("a (b; c)", "d; e") and got[1] is None and got[2] == "a (b) c"
    got = one(spark, words.editions(F.lit("NA28+TR(2)+NA28+ Byz")), words.in_all(F.lit("A+B"), ["A", "B"]), words.in_all(F.lit("A"), ["A", "B"]), words.code_parts(F.lit("HC/Td/Ncmsa"), True), words.code_parts(F.lit("G1=N-ASM + G2=V"), False))
    assert got == (["NA28", "TR", "Byz"], True, False, ["HC", "HTd", "HNcmsa"], ["N-ASM", "V"])


def test_paths(spark):
    line = F.expr("array(struct(0D as x, 0D as y), struct(10D as x, 0D as y), struct(10D as x, 10.25D as y))")
    got = one(spark, paths.encoded(line, False), paths.decoded(paths.encoded(line, True)), paths.to_line(F.lit(5.0), F.lit(3.0), line), paths.clipped_line(line, 2, -1, 20, 5))
    assert got[0] == "M0,0l10,0 0,10.3" and [(p["x"], p["y"]) for p in got[1]] == [(0, 0), (10, 0), (10, 10.3)]
    assert got[2] == 3 and [[(p["x"], p["y"]) for p in run] for run in got[3]] == [[(2, 0), (10, 0), (10, 5)]]


def test_practice(spark):
    items = F.array(*[F.lit(i) for i in range(6)])
    a, b, c, pair = one(spark, practice.scrambled(items, F.lit(1)), practice.scrambled(items, F.lit(1)), practice.scrambled(items, F.lit(2)), practice.scrambled(F.array(F.lit(1), F.lit(2)), F.lit(5)))
    assert a == b and sorted(a) == list(range(6)) and a != list(range(6)) and sorted(c) == sorted(a) and pair == [2, 1]
    assert one(spark, practice.hide_counts(F.lit(10)), practice.hide_counts(F.lit(2))) == ([0, 2, 4, 6, 8, 10], [0, 1, 2])
    picked = one(spark, practice.blanks(F.array(*[F.lit(w) for w in "in the beginning God created the heaven and earth".split()]), ["the", "and"], F.lit(3)))[0]
    assert len(picked) == 1 and picked[0] in (2, 3, 4, 6, 8)
    state = one(spark, practice.typed(F.array(*[F.lit(w) for w in ("In", "the", "end")]), F.array(*[F.lit(k) for k in "ixxte"])))[0]
    assert (state["index"], state["missed"]) == (3, [1])


def test_markup(spark):
    html = "<h1>Head</h1><p>a <b>bold</b> <a href='x'>link</a></p><ul><li>one<ul><li>two</li></ul></li></ul>tail<script>no</script>"
    found = one(spark, markup.blocks(F.lit(html)), markup.block_text(markup.blocks(F.lit(html))), markup.links(markup.blocks(F.lit(html))))
    assert [(b["kind"], b["depth"]) for b in found[0]] == [("h", 0), ("p", 0), ("li", 1), ("li", 2), ("p", 0)]
    assert found[1] == "Head\na bold link\none\ntwo\ntail" and found[2] == ["x"]
    assert one(spark, markup.prose_references(F.lit("See Gen. 1:1-3, and John 3:16; Genx 4"), ["Gen", "John"]))[0] == ["Gen. 1:1-3", "John 3:16"]


def test_lexicon(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "pos int, base string")
    assert {r["pos"]: r["id"] for r in lexicon.numbered_ids(rows, "base", "pos").collect()} == {1: "a", 2: "a-3", 3: "a-2", 4: "a-4"}


def test_parts_are_dealt_to_all_cores(spark):
    """The file of parts is one split, and each row takes long."""
    from lectern.plans import spelling
    from lectern.plans.catalog import QUERIES

    tasks = 4 * spark.sparkContext.defaultParallelism
    assert spelling._some(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks
    assert QUERIES["tags_moved"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks
