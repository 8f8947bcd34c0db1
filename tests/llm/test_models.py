"""Language model, toxicity and language identification by brute force and held-out results."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import language, lm, toxicity
from lectern.llm.common import remainder
from tests.llm.conftest import SCHEMA

PARTS = {"en": ["the", "ing", "tion", "sh", "wh"], "de": ["der", "ung", "sch", "ü", "pf"], "fr": ["eau", "que", "é", "oi", "ç"]}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(900):
        lang = ("en", "de", "fr")[i % 3]
        bad = i % 7 == 0
        words = ["".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 90))]
        if bad:
            words += ["idiot" if lang == "en" else "grobz" + rng.choice(PARTS[lang])] * 2
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, "s", 1))
        if i % 2:
            marks.append((i, 1, int(bad)))
    rows += [(901, None, "en", None, None), (902, "", "en", "s", 0), (903, "12 34 %%%", "fr", "s", 1), (None, "the shing", "en", "s", 1), (5, rows[5][1], None, "s", 1)]
    marks += [(5, 0, None), (None, 1, 1), (7, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    return rows, docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_language_is_found_in_held_out_texts(tongues):
    rows, docs, _ = tongues
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2, per_language=600, steps=250)
    out = language.identify(docs.withColumn("score", F.lit(1)), model)
    assert out.columns[-3:] == ["lang_pred", "score_", "noise"]
    got = out.collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] in (901, 902, 903)} == {"und"}
    assert all(0 <= r["score_"] <= 1 for r in got)


def test_language_without_rows(empty, docs):
    assert language.learn(empty, F.lit(True)) is None
    assert language.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_language_with_a_hot_copy(spark):
    """Copies of one row, whole languages of copies and one very long text: every language is learned, none crowds out the rest."""
    rng = random.Random(2)
    text = {k: [" ".join("".join(rng.choices(PARTS[k], k=3)) for _ in range(60)) for _ in range(40)] for k in PARTS}
    alone = spark.range(5000).select("id", F.lit(text["en"][0]).alias("text"), F.lit("en").alias("lang")).withColumnRenamed("id", "doc_id")
    assert language.learn(alone, F.lit(True), steps=5).languages == ["en"]
    same_id = alone.withColumn("doc_id", F.lit(7).cast("long"))
    others = spark.createDataFrame([(i, t, k) for k in ("de", "fr") for i, t in enumerate(text[k])] + [(1, " ".join(text["de"]) * 200, "de"), (2, "", "es"), (3, None, "es"), (None, text["fr"][0], "fr")], "doc_id long, text string, lang string")
    model = language.learn(same_id.unionByName(others), F.lit(True), per_language=300, steps=200)
    assert model.languages == ["de", "en", "fr"]
    got = language.identify(others.unionByName(alone.limit(3)).withColumn("noise", F.lit("x")), model)
    assert got.columns == ["doc_id", "text", "lang", "noise", "lang_pred", "score", "noise_"]
    assert all(r["lang_pred"] == (r["lang"] if r["text"] else "und") for r in got.collect())


def test_languages_are_picked_however_small_the_share(tongues, spark, monkeypatch):
    """Few windows of many: each language still gives as many as asked for, of whole texts, in bytes."""
    seen = {}
    monkeypatch.setattr(language.ByteTagger, "fit", lambda self, x, y, ends, steps: seen.update(x=x, y=y, ends=ends))
    _, docs, _ = tongues
    for per_language in (1, 3, 50):
        model = language.learn(docs, F.lit(True), per_language=per_language)
        assert np.bincount(seen["y"])[: len(model.languages)].tolist() == [per_language] * len(model.languages)
    wide = spark.createDataFrame([(i, "漢字の文章" * 300 + "終", "ja") for i in range(3)], "doc_id long, text string, lang string")
    language.learn(wide, F.lit(True), per_language=10_000)
    raw = ("漢字の文章" * 300 + "終").encode()
    windows = {raw[k : k + 64] for k in range(0, len(raw), 64)}
    mine = [(bytes(x[:n].astype(np.uint8)), n) for x, n, y in zip(seen["x"], seen["ends"], seen["y"]) if y == 0]
    assert len(mine) == len(range(0, len(raw), 64)) and all(any(w.startswith(m) for w in windows) for m, _ in mine)


def test_noise_goes_at_any_length_by_one_rule(spark):
    df = spark.createDataFrame([(n, "a" * n) for n in (1, 20, 60, 70, 127, 128, 129, 500, 5000)], "doc_id long, text string")
    for level in (0.69, 0.72, 0.8, 0.95, 0.9999):
        model = language.ByteTagger(["en"], 2)
        model.out[:] = 0
        model.bias[:, 0] = [np.log(1 - level), np.log(level)]
        found = sorted(r["doc_id"] for r in language.accepted(df, model).collect())
        assert found == [n for n in (1, 20, 60, 70, 127, 128, 129, 500, 5000) if level <= 0.7 + (np.log(1e6) / 2 / n) ** 0.5]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (4, 6)), np.array([0, 1, 1, 2])
    x[1, 4:] = 0
    x[2, 1] = 0  # a zero byte of a text is no padding
    sizes = np.array([6, 4, 6, 6])

    def loss(m):
        p = m.positions(m.states(np.ascontiguousarray(x.T)))
        real = np.arange(6)[:, None] < sizes
        return -(np.log(p[:, y, np.arange(4)]) * real).sum() / real.sum()

    model = language.ByteTagger(["a", "b"], 3)
    before = loss(model)
    model.fit(x, y, sizes, steps=60)
    assert loss(model) < before / 2

    model = language.ByteTagger(["a", "b"], 3)
    for name in model.names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    grad = model.gradients(x, y, sizes)
    for name in model.names:
        values = getattr(model, name)
        for at in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(12)] + ([(0, k, int(x[0, 0])) for k in range(9)] if name == "w" else []):
            kept, ends = values[at], []
            for shift in (1e-3, -1e-3):
                values[at] = kept + shift
                ends.append(loss(model))
            values[at] = kept
            assert abs(grad[name][at] - (ends[0] - ends[1]) / 2e-3) < 2e-4


def test_toxicity_of_held_out_texts(tongues):
    rows, docs, labels = tongues
    model = toxicity.learn(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["doc_id"] % 7 == 0) == bool(r["predicted"]) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(not r["predicted"] for r in got if r["doc_id"] in (901, 902))


def test_toxicity_without_labels(docs, empty, tongues):
    labels = tongues[2]
    for given in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        model = toxicity.learn(tongues[1], given, F.lit(True))
        assert toxicity.score_toxicity(docs, model).count() == docs.count()
    assert toxicity.score_toxicity(empty, toxicity.learn(empty, labels, F.lit(True))).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    voter = np.where(y, rng.random(2000) < 0.7, rng.random(2000) < 0.02)
    other = np.where(y, rng.random(2000) < 0.6, rng.random(2000) < 0.02)
    posterior, accuracy, discount = toxicity.label_model(np.stack([voter, voter, voter, other], axis=1), y)
    assert discount[0] < 0.5 < discount[3] and accuracy.min() > 0.8
    assert ((posterior > 0.5) == y).mean() > 0.97


def test_label_model_learns_accuracies_with_wrong_labels():
    """Voters for both labels, and given labels of which a tenth are wrong: the votes find the true ones better."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    said = np.array([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.6, 0.02), (0.5, 0.03), (0.55, 0.02), (0.03, 0.5), (0.02, 0.6), (0.3, 0.3))]).T
    given = y ^ (rng.random(4000) < 0.1)
    posterior, accuracy, _ = toxicity.label_model(said, given, np.array([False, False, False, True, True, False]), belief=0.1)
    assert ((posterior > 0.5) == y).mean() > (given == y).mean() + 0.02
    assert accuracy[:5].min() > 0.8 > accuracy[5]


def test_toxicity_with_a_hot_doc_id(tongues):
    """A labelled doc_id that most rows share gives one row to learn from."""
    rows, docs, labels = tongues
    hot = docs.sparkSession.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("der ung "), F.col("id")).alias("text"), F.lit("de").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    model = toxicity.learn(docs.unionByName(hot), labels, remainder(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([bool(got[r[0]]) == (r[0] % 7 == 0) for r in rows if r[0] is not None and r[0] < 900]) > 0.95


def test_toxicity_scores_match_a_plain_sum():
    model = toxicity.Toxicity({"bad": 2.0, "bad-": 0.0, "badl-": 1.0, "fine": -3.0, "/marks": 0.5}, 0.25, -1.0, frozenset({"fine"}))
    for text, x in (("Bad badly!!", -1 + 2 + 1 + 0.5 + 0.25 * math.log2(4)), ("fine", -1 - 3), ("", -1), (None, -1), ("a" * 100_000, -1)):
        assert abs(model.score(text) - 1 / (1 + math.exp(-x))) < 1e-12


def brute_base(rows, held):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b"\n"]
    counts = Counter(w for r in rows if not held(r[0]) for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for r in rows:
        words = split(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out[r[0], held(r[0]), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)] += 1
    return out


@pytest.mark.parametrize("vocabulary", [200_000, 20])
def test_lm_base_scores_match_brute_force(tongues, vocabulary):
    rows, docs, _ = tongues
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    got = lm.score_texts(docs.withColumn("row", F.lit(1)), remainder(F.col("doc_id"), 7) != 2, words=16, tails=4, dim=4, vocabulary=vocabulary).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == brute_base(rows, held)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_scores_match_brute_force(spark):
    """Without any training the model is its first parameters: scores by a plain softmax over classes and shares in the tail."""
    texts = ["a b a c", "a b", "B a d", None, "e a a a", "zz a", "c"]
    df = spark.createDataFrame([(i, t, i != 5) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, F.col("train"), words=3, tails=2, dim=4, warm_docs=0, epochs=0).collect()}
    split = [[w.encode() for w in (t or "").lower().split()] + [b"\n"] for t in texts]
    counts = Counter(w for i, x in enumerate(split) if i != 5 for w in x)
    heads = sorted(counts, key=lambda w: (-counts[w], w))[:3]
    assert b"\n" in heads
    tail = lambda w: zlib.crc32(w[:2]) % 2
    rest = {k: [w for w in counts if w not in heads and tail(w) == k] for k in range(2)}
    unigram = np.array([counts[w] + 1 for w in heads] + [sum(counts[w] for w in rest[k]) + 1 for k in range(2)], float)
    model = lm.LogBilinear(5, 4, unigram / unigram.sum())
    kind = lambda w: heads.index(w) if w in heads else 3 + tail(w)
    for i, words in enumerate(split):
        u = v = kind(b"\n")
        total = 0.0
        for w in words:
            logits = model.out.astype(float) @ (model.before[u] + model.further[v]).astype(float) + model.bias
            p = np.exp(logits[kind(w)]) / np.exp(logits).sum()
            if w not in heads:
                members = rest[tail(w)]
                p *= (counts[w] + 1) / (sum(counts[x] for x in members) + len(members) + 1)
            total += math.log10(p)
            u, v = kind(w), u
        assert abs(total - got[i]) < 1e-4


def test_lm_probabilities_sum_to_one():
    model = lm.LogBilinear(9, 3, np.full(9, 1 / 9))
    u, v = (np.repeat(np.arange(9), 9) for _ in range(2))
    w = np.tile(np.arange(9), 9)
    p = 10 ** model.log10(u, v, w)
    assert np.allclose(p.reshape(9, 9).sum(axis=1), 1, atol=1e-5)


def test_lm_edge_tables(docs, empty):
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    none = lm.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == docs.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_lm_learns_the_counts():
    u, w = np.array([0, 0, 1, 1]), np.array([2, 3, 2, 3])
    n = np.array([10_000, 100, 300, 9_000])
    unigram = np.array([1.0, 1.0, n[w == 2].sum(), n[w == 3].sum()])
    unigram /= unigram.sum()
    model = lm.LogBilinear(4, 4, unigram)
    model.fit(u, np.zeros(4, int), w, n, unigram, epochs=3000)
    p = model.log10(u, np.zeros(4, int), w)
    assert abs(p[0] - p[1] - 2) < 0.2 and abs(p[3] - p[2] - math.log10(30)) < 0.2


def test_lm_weighs_light_and_heavy_batches_by_their_counts():
    rng = np.random.default_rng(2)
    n = np.where(np.arange(64) == 7, 5_000, rng.integers(1, 20, 64))
    unigram = np.full(64, 1 / 64)
    model = lm.LogBilinear(64, 4, unigram)
    zero = np.zeros(64, int)
    model.fit(zero, zero, np.arange(64), n, unigram, epochs=400, batch=8)
    p = 10 ** model.log10(zero, zero, np.arange(64))
    assert abs(p[7] - n[7] / n.sum()) < 0.1


def test_weights_keep_the_side_of_their_voter():
    """One voter for 0 has the closed form of its table; a voter for 1 that speaks mostly in rows of 0 has no weight at all."""
    rng = np.random.default_rng(6)
    fired = rng.random(4000) < 0.4
    posterior = np.where(fired, 0.1, 0.6)
    w = toxicity.fit_linear(fired[:, None], posterior, np.array([True]), ridge=0.0, steps=4000)
    logit = lambda p: np.log(p / (1 - p))
    assert abs(w[0] - (logit(0.1) - logit(0.6))) < 1e-2 and abs(w[-1] - logit(0.6)) < 1e-2
    good = rng.random(4000) < np.where(fired, 0.05, 0.5)
    votes = np.stack([fired, good], axis=1)  # the first speaks for 1 and is wrong
    w = toxicity.fit_linear(votes, posterior, np.array([False, False]))
    assert w[0] == 0 and w[1] >= 0 and w[2] >= 0
