"""Exact copies, SimHash and embeddings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import embeddings, exact, simhash
from lectern.llm.common import components


def rooted(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest(ids, roots):
    low = defaultdict(list)
    for i, r in zip(ids, roots):
        if i is not None:
            low[r].append(i)
    return [min(low[r], default=None) for r in roots]


def exact_brute(corpus):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[body].append((-len(text or ""), doc_id is None, doc_id))
    out = Counter()
    for body, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            out[m[2], best[2], len(members), k == members.index(best), hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("given", [{}, {"key_bytes": 1}, {"key_bytes": 0, "head": 2, "fold_bytes": 5_000, "partitions": 3}])
def test_exact_matches_brute_force(docs, corpus, given):
    """Also where texts share the key that documents find their group by."""
    got = Counter(tuple(r) for r in exact.exact_duplicates(docs, **given).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == exact_brute(corpus)


def test_exact_with_a_hot_text(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot \n text")).otherwise(F.concat(F.lit("common beginning " * 20), F.col("id"))).alias("text"))
    got = exact.exact_duplicates(df.repartition(6))
    assert got.where("kept").count() == 10_001 and got.where("keep_id = 1 and group_size = 20000").count() == 20_000


def test_exact_empty_and_clashing_columns(docs, empty):
    assert exact.exact_duplicates(empty).count() == 0
    extra = docs.withColumn("sha", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("GROUP_SIZE", F.lit(3))
    assert exact.exact_duplicates(extra).count() == docs.count()


def print_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [32768, 7])
def test_simhash_matches_brute_force(docs, corpus, tile):
    ids, prints = [r[0] for r in corpus], [print_of(r[1]) for r in corpus]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), smallest(ids, rooted(len(ids), pairs))))
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs, tile=tile).collect())
    assert got == want


def test_simhash_empty(empty, docs):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("component", F.lit(1))).count() == docs.count()


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings_match_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(150):
        v = base[i % 6] + rng.normal(size=16) * (0.11 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 11 else None))
    rows += [(200, rows[1][1], 1), (201, rows[1][1], 1), (1, rows[1][1], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] + [1.0] * 15, 1), (205, [None] + [1.0] * 15, 1), (206, [float("inf")] * 16, 1), (207, [], 1), (208, [1.0, 2.0], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)

    def fine(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if fine(rows[i]) and fine(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.98]
    assert len(pairs) > 50
    ids, degree = [r[0] for r in rows], Counter(x for p in pairs for x in p)
    low = smallest(ids, rooted(len(rows), pairs))
    want = Counter((ids[i], degree[i], low[i], ids[i] == low[i]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in embeddings.near_embeddings(df, tile=tile).collect()) == want
    assert embeddings.near_embeddings(df.where("false")).count() == 0


def test_embeddings_of_any_size(spark):
    """Components near the ends of double precision neither overflow nor vanish, and wide vectors are exact too."""
    rng = np.random.default_rng(5)
    a, wide = rng.normal(size=8), rng.normal(size=1500)
    rows = [(i, [float(x) for x in a * scale], 1) for i, scale in enumerate((1e200, 1e-200, 1.0, -1.0))] + [(9, [float(x) for x in rng.normal(size=8) * 1e300], 1)]
    rows += [(10, [float(x) for x in wide], 2), (11, [float(x) for x in wide + 0.02 * rng.normal(size=1500)], 2), (12, [float(x) for x in rng.normal(size=1500)], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_embeddings(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 9: (0, 9), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q, step, left = embeddings._quantised(a)
    near = (q.astype(float) @ q.T.astype(float)) * step[:, None] * step[None]
    bound = left[:, None] * (1 + left) + left * (1 + left[:, None]) + left[:, None] * left
    assert (np.abs(near - a @ a.T) <= bound + 1e-12).all()


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000, 2000)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(201)}
