"""The pipeline's stages against brute force on a small folder of documents."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import language, mixing
from lectern.llm.common import remainder
from tests.llm.test_copies import print_of, rooted
from tests.llm.test_models import PARTS


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What goes into and comes out of each stage."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    clashing = {n: F.lit("und") for n in ("lang_pred", "wanted", "again", "mixed", "slot", "kept", "sha", "fp", "k")}
    docs.withColumns(clashing).write.parquet(f"{folder}/documents.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, now, after))
        now = after
    return folder, out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    for _, before, after in stages[1][:-1]:
        assert after.schema == before.schema


def test_language_keeps_texts_with_a_letter_that_are_not_noise(stages):
    _, before, after = stages[1][0]
    model = language.learn(before, remainder(F.col("doc_id"), 4) != 2)
    noisy = {str((r["doc_id"], r["text"])) for r in language.identify(before, model).collect() if r["text"] and r["noise"] > 0.7 + (6.907755 / len(r["text"].encode())) ** 0.5}
    want = [str(r) for r in rows(before) if any(c.isalpha() for c in r[1] or "") and str(r) not in noisy]
    assert sorted(map(str, rows(after))) == sorted(want) and len(noisy) < 10


def test_language_stage_drops_noise(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(2, 90))), lang) for i, lang in enumerate(["en", "de", "fr"] * 150)]
    rows += [(1000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789=+/%$#", k=200)), None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert got == set(range(450))


def test_exact_keeps_one_of_each_text(stages):
    _, before, after = stages[1][1]
    groups = defaultdict(list)
    for doc_id, text in rows(before):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0))
    want = sorted((min(g)[2], body) for body, g in groups.items())
    assert sorted((i or 0, re.sub(r"[\x20\x09-\x0D]", "", t)) for i, t in rows(after)) == want


def test_near_keeps_one_of_each_group(stages):
    _, before, after = stages[1][2]
    given = rows(before)
    prints = [print_of(t) for _, t in given]
    roots = rooted(len(given), [(i, j) for i in range(len(given)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    groups = defaultdict(list)
    for (doc_id, _), r in zip(given, roots):
        groups[r].append(doc_id)
    want = sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted(str(i) for i, _ in rows(after)) == want and len(groups) < len(given)


def test_mix_takes_what_is_before_the_horizon(stages):
    _, before, after = stages[1][3]
    mixed = mixing.mix(before)
    want = [(r["doc_id"], r["text"]) for r in mixed.where(F.col(mixed.columns[-1])).collect()]
    assert sorted(map(str, rows(after))) == sorted(map(str, want)) and want


def test_packing_covers_what_is_left(stages):
    _, before, after = stages[1][4]
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in rows(before)}
    total = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in total)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, stages[0])
    last = stages[1][-1][2]
    assert got.columns == last.columns
    assert got.select("doc_id", "ids_crc32").exceptAll(last.select("doc_id", "ids_crc32")).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_exact_stage_with_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (2, "ab"), (3, "other"), (None, "z"), (None, "z"), (None, "y")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, body string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_exact_copies(spark, df, "").collect()), key=str)
    assert got == [(0, "y"), (0, "z"), (1, "a b"), (1, "other")]


def test_language_stage_without_languages_keeps_texts_with_a_letter(spark):
    df = spark.createDataFrame([(1, "one", None), (2, "12 %%", None), (3, None, None), (4, "", None), (None, "漢", None), (1, "é 1", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, df, "")
    assert got.columns == df.columns and sorted(r["text"] for r in got.collect()) == ["one", "é 1", "漢"]


def test_near_stage_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(6000)) for x in "abc")
    rows = [(5, a), (5, a + " more"), (5, b), (3, b + " end"), (7, c), (None, c + " x"), (None, "alone"), (None, "alone"), (9, "single")]
    assert all((print_of(x) ^ print_of(y)).bit_count() <= 3 for x, y in ((a, a + " more"), (b, b + " end"), (c, c + " x")))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(5, a + " more"), (3, b + " end"), (7, c), (0, "alone"), (9, "single")])


def test_sequences_follow_the_mix(spark, tmp_path):
    """The stretches of sequences hold the documents in the order of their slots, from written files or not."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["red", "green", "blue"], k=rng.randrange(20, 300))), "abc"[i * i % 7 % 3]) for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.write.parquet(f"{tmp_path}/mixed")
    for given in (spark.read.parquet(f"{tmp_path}/mixed"), mixed):
        groups = defaultdict(set)
        for r in corpus_pipeline.pack_sequences(spark, given, "").select("doc_id", "sequence_id").collect():
            groups[r["sequence_id"] >> 32].add(r["doc_id"])
        of = [sorted(slots[i] for i in groups[g]) for g in sorted(groups)]
        assert [len(x) for x in of] == [256] * 4 + [76] and of[0][0] < of[-1][-1]
        assert all(a[-1] <= b[0] for a, b in zip(of, of[1:]))
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), "").count() == 0
