"""Very long texts, clashing columns and ties where the other tests have none."""

import random

from pyspark.sql import functions as F

from lectern.llm import language, mixing, packing, simhash, toxicity
from tests.llm.test_copies import print_of

LONG = " ".join(random.Random(1).choice(["alpha", "Beta", "gamma,", "Ünï", "x"]) for _ in range(250_000))


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, LONG), (2, "short one"), (3, LONG + " idiot scum"), (4, None)], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df).collect()}
    assert prints[1] == f"{print_of(LONG):016x}" and prints[2] == f"{print_of('short one'):016x}"
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, toxicity.Toxicity({"idiot": 9.0, "scum": 2.0})).collect()}
    assert scores[3] > 0.9 > scores[1] == scores[2] == scores[4]
    pieces = packing.pack(df).where("doc_id = 1").orderBy("start").collect()
    assert [r["start"] for r in pieces[1:]] == [r["start"] + r["length"] for r in pieces[:-1]] and pieces[-1]["start"] + pieces[-1]["length"] == pieces[0]["doc_tokens"] > 250_000
    model = language.ByteTagger(["en", "fr"], 4)
    found = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert found[1]["lang_pred"] in ("en", "fr") and found[4]["lang_pred"] == "und" and found[1]["score"] == found[3]["score"] or abs(found[1]["score"] - found[3]["score"]) < 1e-3


def test_two_languages_with_the_same_texts_tie_for_the_first(spark):
    model = language.ByteTagger(["de", "en"], 2)
    model.out[:] = 0  # all classes are as likely everywhere
    df = spark.createDataFrame([(1, "same words"), (2, "12"), (3, "é")], "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.identify(df, model).collect()} == {1: ("de", 0.5), 2: ("und", 0.0), 3: ("de", 0.5)}
    both = spark.createDataFrame([(i, f"the very same text {i % 5}", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    learned = language.learn(both, F.lit(True), steps=3)
    assert learned.languages == ["de", "en"]


def test_extra_columns_with_clashing_names(spark, docs):
    model = language.ByteTagger(["en"], 2)
    clash = docs.withColumns({"lang_pred": F.lit(1), "NOISE": F.lit(2), "labelled": F.lit(3), "y": F.lit(4), "predicted": F.lit(5), "fired": F.lit(6), "mix_plan": F.lit(7), "deadline": F.lit(8)})
    found = language.identify(clash, model)
    assert found.columns == [*clash.columns, "lang_pred_", "score", "noise_"] and found.count() == docs.count()
    assert toxicity.score_toxicity(clash, toxicity.Toxicity()).columns == ["doc_id", "score", "predicted"]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").withColumn("labelled", F.lit(0))
    assert toxicity.score_toxicity(clash, toxicity.learn(clash, labels, F.lit(True))).count() == docs.count()
    mixed = mixing.mix(clash)
    assert mixed.columns[: len(clash.columns)] == clash.columns and mixed.count() == docs.count()
    assert packing.pack(clash).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
