"""Random orders, hidden words, long rows and readings against plain Python."""

import random
import time

from pyspark.sql import functions as F

from lectern.functions import practice, readings, words
from lectern.operators import ordered


def generator(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield t ^ t >> 14


def plain_shuffle(items, seed):
    out, numbers = list(items), generator(seed)
    for i in range(len(out) - 1, 0, -1):
        j = next(numbers) * (i + 1) >> 32
        out[i], out[j] = out[j], out[i]
    return out


def test_draws_and_shuffles_equal_the_plain_generator(spark):
    rows = [(seed, list(range(n))) for seed in (0, 1, 7, 42, 2**31, 2**32 - 1, -5) for n in (0, 1, 2, 3, 10, 200)] + [(3, None)]
    df = spark.createDataFrame(rows, "seed long, items array<int>").repartition(3)
    got = df.select("seed", "items", practice.draws(F.col("seed"), F.size("items")).alias("d"), practice.shuffled(F.col("items"), F.col("seed")).alias("s"), practice.scrambled(F.col("items"), F.col("seed")).alias("x")).collect()
    for r in got:
        if r["items"] is None:
            assert r["s"] is None and r["x"] is None
            continue
        numbers, want = generator(r["seed"]), plain_shuffle(r["items"], r["seed"])
        assert r["d"] == [next(numbers) for _ in r["items"]] and r["s"] == want
        assert r["x"] == (want[1:] + want[:1] if want == r["items"] and len(want) > 1 else want)


def test_hidden_words_by_round(spark):
    def plain(n):
        out = [0]
        for s in practice.SHARES:
            if out[-1] < n:
                out.append(min(n, max(out[-1] + 1, -int(-(s * n) // 1))))
        return out if out[-1] >= n else [*out, n]

    got = spark.range(60).select(F.col("id").cast("int").alias("n")).select("n", practice.hide_counts(F.col("n")).alias("c")).collect()
    assert all(r["c"] == plain(r["n"]) for r in got)
    assert {r["n"]: r["c"] for r in got}[7] == [0, 2, 3, 5, 6, 7] and {r["n"]: r["c"] for r in got}[3] == [0, 1, 2, 3]


def plain_split(text, separator):
    depth = 0
    for i, c in enumerate(text):
        depth = depth + 1 if c in "([" else max(0, depth - 1) if c in ")]" else depth
        if c == separator and not depth:
            return text[:i].strip(" "), text[i + 1 :].strip(" ")
    return None


def test_splits_outside_brackets_on_free_text_and_in_proportion_to_it(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab ;()[]é") for _ in range(rng.randrange(30))),) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string").select("t", words.split_outside(F.col("t"), ";").alias("s")).collect()
    assert all((None if r["s"] is None else tuple(r["s"])) == plain_split(r["t"], ";") for r in got)
    long = spark.range(1).select(F.concat(F.repeat(F.lit("(a;b) "), F.lit(17_000)), F.lit("x; tail")).alias("t")).cache()
    long.count()
    began = time.time()
    assert long.select(words.split_outside(F.col("t"), ";")["tail"]).first()[0] == "tail"
    weights = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: i % 7).alias("w"))
    chunks = weights.select(ordered.chunked(F.col("w"), 20).alias("c")).first()["c"]
    assert time.time() - began < 20  # quadratic forms took minutes
    load, chunk, want = 0, 0, []
    for i in range(1, 100_001):
        if load and load + i % 7 > 20:
            chunk, load = chunk + 1, 0
        load += i % 7
        want.append(chunk)
    assert chunks == want


def test_readings_of_free_text(spark):
    rng = random.Random(8)
    some = ["alpha", "beta (x; y)", "gamma, delta", "properly, ", "i.e. ", "; ", " [a;b] ", "word " * 9]
    rows = [("".join(rng.choice(some) for _ in range(rng.randrange(6))),) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", readings.first_sense(F.col("t"), F.lit("X one, two"), ["properly", "i.e."], 40).alias("s")).collect():
        assert len(r["s"]) <= 40
        if not (r["t"] or "").replace(";", "").strip():
            assert r["s"] == "one"
    cells = spark.createDataFrame([("a (b) c - G1=N + G2 in: X+Y(2) ¦ broken ¦  d e (f) - H1|H2«n=V in: Z",), (None,), ("",)], "c string")
    got = cells.select(readings.variants(F.col("c")).alias("v")).collect()
    assert [v and tuple(v) for v in got[0]["v"]] == [("a", "c", ["G1", "G2"], "N", ["X", "Y"]), None, None] and not got[1]["v"] and not got[2]["v"]
    word = spark.createDataFrame([("thousand",), ("th",), ("",), (None,)], "w string")
    assert [r[0] for r in word.select(readings.respelled(F.col("w"), [("start", "th", "d"), ("any", "ou", "u"), ("end", "and", "")])).collect()] == ["dus", "d", "", None]
