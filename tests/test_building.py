"""Words from parallel columns, held marks and sounds."""

from pyspark.sql import functions as F

from lectern.functions import building


def test_parts_of_words(spark):
    rows = [
        ("בְּ/רֵאשִׁ֖ית", "H9003/{H7225G}", "HR/Ncfsa", "in/ beginning"), ("אֵ֥ת\\־", "{H0853}\\H9014", "HTo", None), ("a/b/c", "X/{Y}/J", "GA/B/", "x//z"),
        ("a/b", "X", "HA/B", "x/y"), ("a", "X", "HA", "x"), (" ", "X", "HA", "x"), (None, None, None, None), ("a/b", "/{Y}", "H/B", ""),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, g string, c string, s string").select(building.parts(F.col("t"), F.col("g"), F.col("c"), F.col("s"), ["J"])).collect()]
    plain = lambda w: [tuple(p) for p in w["parts"]]
    assert plain(got[0]) == [("בְּ", "H9003", "HR", "in"), ("רֵאשִׁ֖ית", "H7225G", "HNcfsa", "beginning")] and got[0]["root"] == "H7225G" and got[0]["problem"] is None
    assert plain(got[2]) == [("a", "X", "GA", "x"), ("b", "Y", "GB", None)]
    assert (got[3]["parts"], got[3]["problem"]) == (None, "uneven") and got[4]["problem"] == "no root" and got[5] is None and got[6] is None
    assert plain(got[7]) == [("b", "Y", "HB", None)]


def test_held_marks(spark):
    texts = [("אָֽרֶץ\\׃",), ("Kedor\\־laomer",), ("plain",), ("x\\׃\\ס",), ("",), (None,), ("א//ב\\׀ \\׃",)]
    got = spark.createDataFrame(texts, "t string").select(building.without_marks(F.col("t"), "׃׀־׆ספ"), building.surface(F.col("t"), "׀"), building.plain_sound(F.lit("bārâ ’ĕlōhím"))).collect()
    assert [r[0] for r in got][:6] == ["אָֽרֶץ", "Kedor־laomer", "plain", "x", "", None]
    assert got[6][1] == "א ב ׀ ׃" and got[0][1] == "אָֽרֶץ׃" and got[0][2] == "bāra ’ĕlōhim"
