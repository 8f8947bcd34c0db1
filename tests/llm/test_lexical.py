"""Reversed search against plain sums."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(b) for b in bags), sum(map(Counter.total, bags))
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), bag in zip(docs, bags):
            if not bag:
                continue
            m = 25 + 75 * bag.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_terms", [15, 1 << 18])
def test_ranks_equal_plain_sums(spark, block_terms):
    rng = random.Random(5)
    some = [chr(97 + i) * 2 for i in range(20)] + ["É", "漢字", "x1", "The"]
    docs = [(i, " ,".join(rng.choice(some) for _ in range(rng.randrange(12)))) for i in range(150)]
    docs += [(500, docs[3][1]), (500, docs[3][1]), (7, docs[7][1]), (None, "aa bb"), (None, "aa bb"), (501, None), (502, ""), (503, "?! ")]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(9)))) for i in range(12)] + [(3, "aa aa the bb"), (None, "cc"), (40, None), (41, "neverseen"), (42, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit("x"), "at": F.lit(2)}).repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "block": F.lit(None)}).repartition(3)
    found = lexical.rank_documents(d, q, 4, block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(docs, items, 4)


def test_ids_of_any_type_ties_by_id(spark):
    docs = [(f"d{i}", "same words here") for i in range(30)] + [("zz", "other things")]
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    q = spark.createDataFrame([("q", "same words")], "item_id string, text string")
    found = lexical.rank_documents(d, q, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["d0", "d1", "d10"] and len({r["score"] for r in found}) == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    for docs, items in [(d.limit(0), q), (d, q.limit(0)), (d.withColumn("text", F.lit(None)), q)]:
        found = lexical.rank_documents(docs, items)
        assert found.count() == 0 and [t for _, t in found.dtypes] == ["int", "int", "bigint", "bigint"]


def test_very_long_texts_are_counted_in_parts(spark):
    long = "aa bb " * 900_000 + "rare"
    docs = [(1, long), (2, "aa cc"), (3, "bb"), (4, "x" * 5_000_000 + " rare")]
    items = [(1, "rare aa"), (2, "bb cc")]
    found = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(docs, items, 10)
    assert [t for part in lexical.terms_of(b"ab, Cd " * 50, 10) for t in part] == [b"ab", b"cd"] * 50
