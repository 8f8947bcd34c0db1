"""Operator 3: toxicity by weak supervision."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved, worker_cache

# English insults that vote for label 1 without having been found in labelled rows.
LEXICON = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
# Patterns that vote for label 1; what they are worth is estimated like any other voter's.
PATTERNS = {
    "/marks": r"[!?]{2,}",
    "/shouting": r"\b[A-ZÀ-Þ]{3,}(?:\W+[A-ZÀ-Þ]{3,}){2,}\b",
    "/masked": r"[^\W\d_][*@#$]+[^\W\d_]",
    "/drawn": r"([^\W\d_])\1{3,}",
}


def features(text: str | None, patterns: Iterable[str] = tuple(PATTERNS), shortest: int = 4, longest: int = 6) -> set[str]:
    """Words of a text in lower case, their proper prefixes marked with ``-``, and the patterns it matches."""
    import re

    text = text or ""
    out = set(re.findall(r"[^\W\d_]+", text.lower()))
    words = list(out)
    for n in range(shortest, longest + 1):
        out.update([w[:n] + "-" for w in words if len(w) > n])
    out.update(p for p in patterns if re.search(PATTERNS[p], text))
    return out


@dataclass
class Toxicity:
    """A linear classifier over voters."""

    weights: dict = field(default_factory=dict)
    several: float = 0.0  # for each doubling of the number of voters for 1 that fire
    bias: float = -4.0
    against: frozenset = frozenset()  # voters for 0

    def score(self, text: str | None) -> float:
        import math

        fired = features(text, [p for p in PATTERNS if p in self.weights]).intersection(self.weights)
        x = self.bias + sum(sorted(self.weights[v] for v in fired)) + self.several * math.log2(1 + len(fired - self.against))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def label_model(votes, given, against=None, rounds: int = 15, settled: float = 1e-3, belief: float = 1.0):
    """Posterior of label 1, accuracy and dependence weight of each voter, by expectation-maximisation.

    votes: Boolean (rows, voters), true where a voter speaks: for 0 where ``against``, else for 1.  One more voter
    speaks for 0 where no other speaks.  given: labels, a voter too, that speaks in every row.  The labels
    behind the votes are unknown: they begin at the balance of the votes, the given one counting as two.

    Before any vote the given labels are believed to be right for 99.5 % of as many rows as there are (times ``belief``).
    Each round estimates how often a voter speaks in either class (smoothed, and never better evidence for the class it speaks
    against), how often given labels are right, and all voters' correlations within a class.  A voter's
    evidence counts for 1 / (1 + its positive correlations), since correlated voters repeat each other.
    """
    import numpy as np

    against = np.zeros(votes.shape[1], bool) if against is None else against
    fired = np.concatenate([votes, ~votes.any(axis=1, keepdims=True)], axis=1).astype(np.float32)
    sign = np.where(np.append(against, True), -1.0, 1.0)
    prior = np.clip(given.mean(), 1e-3, 1 - 1e-3)
    posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + 2 * (fired @ sign.astype(np.float32)) + 4 * np.where(given, 1, -1), -30, 30)))
    for _ in range(rounds):
        one, zero = max(posterior.sum(), 1e-9), max((1 - posterior).sum(), 1e-9)
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        spoke = fired.sum(axis=0)
        share = (spoke + 1) / (len(fired) + 2)
        rate1 = (fired.T @ posterior + 2 * share) / (one + 2)
        rate0 = (spoke - fired.T @ posterior + 2 * share) / (zero + 2)
        evidence = np.log(rate1 / rate0)
        evidence = np.where(sign * evidence > 0, evidence, 0.0)
        shared = np.zeros((fired.shape[1],) * 2)
        for weight, part in ((posterior / one, prior), ((1 - posterior) / zero, 1 - prior)):
            mean = weight @ fired
            second = (fired * weight[:, None].astype(np.float32)).T @ fired
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            shared += part * np.maximum(0, (second - np.outer(mean, mean)) / np.outer(spread, spread))
        np.fill_diagonal(shared, 0)
        shared[shared < 0.1] = 0
        alone = 1 / (1 + shared.sum(axis=1))
        right1 = (posterior[given].sum() + 0.995 * belief * one) / (one * (1 + belief))  # P(given 1 | 1)
        false1 = ((1 - posterior)[given].sum() + 0.005 * belief * zero) / (zero * (1 + belief))
        odds = np.log(prior / (1 - prior)) + fired @ (evidence * alone) + np.where(given, np.log(right1 / false1), np.log((1 - right1) / (1 - false1)))
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(posterior - before).max() < settled:
            break
    own = fired.T @ posterior
    accuracy = np.where(sign > 0, own + 2 * prior, spoke - own + 2 * (1 - prior)) / (spoke + 2)
    return posterior, accuracy[:-1], alone[:-1]


def fit_linear(votes, posterior, against=None, ridge: float = 1.0, steps: int = 300):
    """Logistic regression on posterior labels: weights of voters, of log2(1 + number that fire for 1), and the bias.

    A voter for 1 never lowers a score, one for 0 never raises it: each step ends at the nearest such weights.
    """
    import numpy as np

    counted = votes if against is None else votes[:, ~against]
    x = np.concatenate([votes.astype(np.float32), np.log2(1 + counted.sum(axis=1, keepdims=True)).astype(np.float32), np.ones((len(votes), 1), np.float32)], axis=1)
    w = np.zeros(x.shape[1])
    mean = np.clip(posterior.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    penalty = np.full(len(w), ridge / len(x))
    penalty[-2:] = 0
    side = np.where(np.zeros(votes.shape[1], bool) if against is None else against, -1.0, 1.0)
    for step in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - posterior) / len(x) + penalty * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[:-2] = side * np.maximum(side * w[:-2], 0)
        w[-2] = max(w[-2], 0)
    return w


def learn(docs: DataFrame, labels: DataFrame, training: Column, most_docs: int = 20_000, voters: int = 512, least: int = 3, evidence: float = 20.0, purity: float = 20.0) -> Toxicity:
    """A classifier from at most about most_docs labelled training rows, picked by a hash of doc_id, one text (the longest) of each.

    training: Boolean column over doc_id.  labels.toxic null is no label; of several labels for a
    doc_id the largest counts.  Voters are LEXICON, PATTERNS, and the words and prefixes whose presence speaks for
    either label by a log-likelihood ratio of ``evidence`` at least, in ``least`` rows or more, the
    strongest ``voters`` of them that are ``purity`` times as frequent in rows of that label as in others.  The label
    model then finds from all votes how far each voter, and the given label, is to be believed.
    Votes of the sampled rows reach the driver, their texts don't.
    """
    import numpy as np
    import pyarrow as pa

    given = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.where(F.coalesce(training, F.lit(False)))
    count = given.count()
    if not count:
        return Toxicity({w: 4.0 for w in LEXICON})
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < min(1.0, most_docs / count) * 1_000_003
    picked = given.where(part).limit(most_docs + most_docs // 10).select(F.col("doc_id").alias("labelled"), (F.col("toxic") > 0).alias("y"))
    met = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))  # at most 1.1 most_docs ids
    longest = F.max(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), "text"))
    sample = saved(met.groupBy("labelled", "y").agg(longest.alias("best")).select("labelled", "best.text", "y"))  # a doc_id with many rows counts once

    def tally(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                seen.update((f, y) for f in features(text.as_py()))
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def out(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([seen[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else seen[k] for k in keys], pa.int64())], names=["f", "pos", "neg"])

    n1 = sample.where("y").count()
    n0 = sample.count() - n1
    if not n1 or not n0:
        return Toxicity({w: 4.0 for w in LEXICON}, bias=4.0 if n1 else -4.0)
    met = sample.mapInArrow(tally, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    for_one = (F.col("pos") >= least) & (F.col("pos") * n0 > purity * F.col("neg") * n1)
    for_zero = (F.col("neg") >= least) & (F.col("neg") * n1 > purity * F.col("pos") * n0)
    met = met.withColumn("zero", for_zero).where((for_one | for_zero) & ~F.col("f").isin(list(PATTERNS)))

    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    share = (F.col("pos") + F.col("neg")) / (n0 + n1)
    strength = 2 * (term(F.col("pos"), share * n1) + term(F.col("neg"), share * n0) + term(n1 - F.col("pos"), (1 - share) * n1) + term(n0 - F.col("neg"), (1 - share) * n0))
    best = met.withColumn("g", strength).where(F.col("g") >= evidence).orderBy(F.desc("g"), "f").limit(voters).collect()
    names = sorted({r["f"] for r in best} | set(LEXICON) | set(PATTERNS))
    zeros = {r["f"] for r in best if r["zero"]} - set(LEXICON)

    def vote(batches):
        place = {f: i for i, f in enumerate(names)}
        for batch in batches:
            fired = [sorted(place[f] for f in features(t.as_py()).intersection(place)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("labelled").cast(pa.string()), batch.column("y"), pa.array(fired, pa.list_(pa.int32()))], names=["id", "y", "fired"])

    rows = sorted(sample.mapInArrow(vote, "id string, y boolean, fired array<int>").collect(), key=lambda r: (r["id"], r["fired"]))
    votes, y = np.zeros((len(rows), len(names)), bool), np.array([r["y"] for r in rows])
    for i, r in enumerate(rows):
        votes[i, r["fired"]] = True
    against = np.array([f in zeros for f in names])
    posterior, _, _ = label_model(votes, y, against)
    weights = fit_linear(votes, posterior, against)
    return Toxicity({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, float(weights[-2]), float(weights[-1]), frozenset(zeros))


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row of docs.

    Null and empty texts have the score of a text in which no voter fires.  Repeated rows and null
    doc_ids are scored each; an empty table gives an empty result; only text is read for a score.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values need no module to load
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_cache("toxicity", version, lambda: Toxicity(**shared.value))
        for batch in batches:
            scores = [mine.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
