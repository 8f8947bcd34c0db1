"""Operator 2: language-model scores from a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved, worker_cache

END = b"\n"  # no word holds white space, so this stands for the end of a text


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, then END."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


@dataclass
class Vocabulary:
    """The most frequent training tokens.  Output classes of the model are the first ``words`` of them,
    then ``tails`` classes that all other tokens fall in by the first two bytes."""

    index: dict
    logs: object  # log10(count + 1) of each token
    words: int
    tails: int
    tail_terms: object  # log10 of the denominators in each tail class

    def __post_init__(self):
        import numpy as np

        self.classes = np.array([i if i < self.words else self.words + tail_class(x, self.tails) for x, i in self.index.items()] + [-1], np.int32)

    def ids(self, found: list[bytes]):
        """Place in the vocabulary (-1: not in it), and class, of each token."""
        from itertools import repeat

        import numpy as np

        place = np.fromiter(map(self.index.get, found, repeat(-1)), np.int32, len(found))
        kind = self.classes[place]  # the last entry is for tokens that are not in it
        for i in np.nonzero(place < 0)[0].tolist():
            kind[i] = self.words + tail_class(found[i], self.tails)
        return place, kind


def tail_class(token: bytes, tails: int) -> int:
    import zlib

    return zlib.crc32(token[:2]) % tails


class LogBilinear:
    """score(w | u, v) = out[w] . (before[u] + further[v]) + bias[w], u the token before and v the one before u."""

    def __init__(self, classes: int, dim: int, unigram, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.before, self.further, self.out = (rng.normal(0, 0.1, (classes, dim)).astype(np.float32) for _ in range(3))
        self.bias = np.log(unigram).astype(np.float32)
        self.totals = None  # log denominators of the contexts met so far

    def flat(self):
        import numpy as np

        return np.concatenate([x.ravel() for x in (self.before, self.further, self.out, self.bias)])

    def load(self, flat) -> LogBilinear:
        at, self.totals = 0, None
        for name in ("before", "further", "out", "bias"):
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype("float32"))
            at += x.size
        return self

    def fit(self, u, v, w, n, unigram, epochs: int, noise: int = 128, rate: float = 0.1, batch: int = 2048, seed: int = 11) -> None:
        """AdaGrad on the noise-contrastive loss of trigrams u, v, w that occur n times each.

        Every occurrence counts the same.  Trigrams of more than four times the mean count are met several
        times an epoch with equal parts of it, so that no batch is swamped; that adds a quarter at most.
        """
        import numpy as np

        rng = np.random.default_rng(seed)
        classes, dim = self.out.shape
        base = np.log(noise * unigram).astype(np.float32)
        cumulative = np.cumsum(unigram)
        sums = [np.full(x.shape, 1e-6, np.float32) for x in (self.before, self.further, self.out, self.bias)]

        def scatter(at, rows):
            return np.stack([np.bincount(at, rows[:, k], classes) for k in range(dim)], axis=1).astype(np.float32)

        mean = np.sum(n) / max(1, len(n))
        times = np.maximum(1, np.ceil(n / (4 * mean))).astype(np.int64)
        part = (n / times / mean).astype(np.float32)
        entries = np.repeat(np.arange(len(w)), times)
        for _ in range(epochs):
            order = rng.permutation(entries)
            for k in range(0, len(order), batch):
                i = order[k : k + batch]
                a, b, c = u[i], v[i], w[i]
                weight = part[i] / len(i)  # not scaled to the batch, or trigrams of light batches would count for more
                context = self.before[a] + self.further[b]
                drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise) * cumulative[-1]), classes - 1)
                real = np.einsum("ij,ij->i", context, self.out[c]) + self.bias[c] - base[c]
                fake = context @ self.out[drawn].T + (self.bias[drawn] - base[drawn])
                g_real = -weight / (1 + np.exp(np.clip(real, -30, 30)))
                g_fake = weight[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
                g_context = g_real[:, None] * self.out[c] + g_fake @ self.out[drawn]
                g_out = scatter(c, g_real[:, None] * context)
                np.add.at(g_out, drawn, g_fake.T @ context)
                g_bias = np.bincount(c, g_real, classes).astype(np.float32)
                np.add.at(g_bias, drawn, g_fake.sum(axis=0))
                for x, s, g in zip((self.before, self.further, self.out, self.bias), sums, (scatter(a, g_context), scatter(b, g_context), g_out, g_bias)):
                    s += g * g
                    x -= rate * g / np.sqrt(s)

    def log10(self, u, v, w, block: int = 2048):
        """Normalised log10 P(w | u, v): each distinct context is normalised once in the model's life, in matrix products."""
        import numpy as np

        classes = len(self.bias)
        if self.totals is None:  # one number for each context
            self.totals = np.full(classes * classes, np.nan, np.float32)
        key = u.astype(np.int64) * classes + v
        contexts = np.unique(key[np.isnan(self.totals[key])])
        for k in range(0, len(contexts), block):
            at = contexts[k : k + block]
            x = (self.before[at // classes] + self.further[at % classes]) @ self.out.T
            x += self.bias
            top = x.max(axis=1, keepdims=True)
            x -= top
            self.totals[at] = np.log(np.exp(x, out=x).sum(axis=1)) + top[:, 0]
        out = np.empty(len(w))
        for k in range(0, len(w), 1 << 18):
            j = slice(k, k + (1 << 18))
            hidden = self.before[u[j]] + self.further[v[j]]
            out[j] = np.einsum("ij,ij->i", hidden, self.out[w[j]]) + self.bias[w[j]] - self.totals[key[j]]
        return out / math.log(10)


def _counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(token, c): how often each token occurs in all of docs."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        def out(found):
            keys = list(found)
            for k in range(0, len(keys), 50_000):
                some = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([found[x] for x in some], pa.int64())], names=["token", "c"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
                if len(found) > flush:
                    yield from out(found)
                    found = Counter()
        yield from out(found)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the most frequent tokens, at most ``most``: all from the lowest count that leaves no more.

    Only a histogram of counts (sixteen steps an octave) and these rows reach the driver, where a sorted
    limit would send as many rows from each task.
    """
    step = F.floor(F.log2("c") * 16)
    lowest = left = None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left = (left or 0) + r["count"]
        if left > most:
            break
        lowest = r["step"]
    return counts.where(step >= lowest).collect() if lowest is not None else []


def _trigrams(kinds, lengths, words_end: int):
    """u, v of each token: the classes before it in its text, END before the first."""
    import numpy as np

    starts = np.cumsum(lengths) - lengths
    u = np.empty_like(kinds)
    u[1:] = kinds[:-1]
    u[starts] = words_end
    v = np.empty_like(kinds)
    v[2:] = kinds[:-2]
    v[starts] = words_end
    v[(starts + 1)[lengths > 1]] = words_end
    return u, v


def score_texts(
    docs: DataFrame, training: Column, words: int = 1024, tails: int = 64, dim: int = 16, vocabulary: int = 200_000, longest: int = 64, warm_docs: int = 500, epochs: int = 2
) -> DataFrame:
    """docs' doc_id with n_tokens, n_known, train_tokens, base_score, score.

    training: Boolean column that marks the rows to learn from (null: false).  base_score is the add-one
    unigram model over training tokens with one place for all unseen tokens; score is log10 of the
    probability that the log-bilinear model gives the text.  Its outputs are the most frequent ``words``
    tokens and ``tails`` classes of rarer ones; within a class a token has its add-one share, the class
    keeping one place for what it has not seen, so that probabilities sum to one.

    Counts and the model cover all training rows.  The model is started in one task on about warm_docs texts (twice as many at most), picked by a hash of doc_id; then
    every task goes through all its training text and the tasks' models are averaged by their tokens.
    The driver and the workers hold at most ``vocabulary`` of the most frequent tokens, of ``longest`` bytes or less;
    the counts of all other tokens reach the texts by an equi-join.

    Null and empty texts are the end token alone.  Repeated rows and doc_ids are scored each; null
    doc_ids keep their rows.  Without training rows both models spread evenly over what they know.  An
    empty table gives an empty result; other columns are ignored.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    train = marked.where("training")
    counts = saved(_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = sorted(_most_frequent(counts.where(F.octet_length("token") <= longest), vocabulary), key=lambda r: (-r["c"], bytes(r["token"])))
    listed = [bytes(r["token"]) for r in often]
    if END not in listed[:words]:
        listed = [END, *[x for x in listed if x != END]]
    known = {bytes(r["token"]): r["c"] for r in often}
    del often
    words = min(words, len(listed))
    heads = listed[:words]

    # what the tail classes hold: all distinct tokens but the words
    of_class = (F.crc32(F.expr("substring(token, 1, 2)")) % tails).alias("k")
    held = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(of_class).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # a row a class
    size, kept = np.zeros(tails), np.zeros(tails)
    for k, (n, v) in held.items():
        size[k], kept[k] = n, v
    for x in heads:
        if x in known:
            size[tail_class(x, tails)] -= known[x]
            kept[tail_class(x, tails)] -= 1
    terms = np.log10(size + kept + 1)
    unigram = np.concatenate([[known.get(x, 0) + 1.0 for x in heads], size + 1.0])
    unigram /= unigram.sum()
    classes, at_end = words + tails, heads.index(END)

    shared = spark.sparkContext.broadcast((listed, np.log10(np.array([known.get(x, 0) + 1 for x in listed], float))))
    version = uuid.uuid4().hex

    def read() -> Vocabulary:
        def make():
            found, logs = shared.value
            return Vocabulary({x: i for i, x in enumerate(found)}, logs, words, tails, terms)

        return worker_cache("vocabulary", version, make)

    def trigram_table(texts, vocab):
        """Distinct u, v, w and how often each occurs."""
        lengths, parts = [], []
        for t in texts:
            found = tokens(t)
            lengths.append(len(found))
            parts.append(vocab.ids(found)[1])
        w = np.concatenate(parts).astype(np.int64)
        u, v = _trigrams(w, np.array(lengths), at_end)
        key, n = np.unique((u * classes + v) * classes + w, return_counts=True)
        return key, n

    def split(key):
        return key // (classes * classes), key // classes % classes, key % classes

    model = LogBilinear(classes, dim, unigram)
    share = min(1.0, warm_docs / max(1, train.count()))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003))
    picked = train.where(hashed < share * 1_000_003).select("text").limit(2 * warm_docs).coalesce(1)  # one task

    blocks = 16

    def learner(start, **how):
        """What goes through all trigrams of a task's texts, from the model start, and yields its model in blocks, times its tokens."""
        return lambda batches: learn(batches, start, how)

    def learn(batches, start, how):
        vocab = read()
        keys, ns, tokens_seen = [], [], 0

        def merged():
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(ns))

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(k, 512).to_pylist()
                key, n = trigram_table(texts, vocab)
                tokens_seen += int(n.sum())
                keys.append(key)
                ns.append(n)
            if sum(map(len, keys)) > 1_000_000:
                key, n = merged()
                keys, ns = [key], [n]
        if not keys:
            return
        key, n = merged()
        mine = LogBilinear(classes, dim, unigram)
        if start is not None:
            mine.load(start.value)
        mine.fit(*split(key), n, unigram, **how)
        for i, x in enumerate(np.array_split(mine.flat().astype(np.float64) * tokens_seen, blocks)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([i * 64 + _part() % 64], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([tokens_seen], pa.int64())], names=["block", "salt", "x", "n"])

    def added(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_py()) for x in table.column("x"))
        return pa.table({"block": table.column("block")[:1], "x": pa.array([out.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    def load(rows):
        if rows:
            model.load(np.concatenate([np.frombuffer(r["x"]) / r["n"] for r in sorted(rows, key=lambda r: r["block"])]))

    if total:
        learned = "block int, salt int, x binary, n long"
        load(picked.mapInArrow(learner(None, epochs=10, rate=0.2, batch=1024), learned).collect())
        start = spark.sparkContext.broadcast(model.flat())
        sums = train.select("text").mapInArrow(learner(start, epochs=epochs), learned)
        load(sums.groupBy("salt").applyInArrow(added, "block int, x binary, n long").groupBy("block").applyInArrow(added, "block int, x binary, n long").collect())
    final = spark.sparkContext.broadcast(model.flat())

    def score(batches):
        vocab = read()
        lbl = worker_cache("bilinear", version, lambda: LogBilinear(classes, dim, unigram).load(final.value))
        part, row = _part(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                places, kinds, lengths, tail, many = [], [], [], [], []
                for text in piece.column(1):
                    found = tokens(text.as_py())
                    place, kind = vocab.ids(found)
                    places.append(place)
                    kinds.append(kind)
                    lengths.append(len(found))
                    rest: dict = {}
                    for i in np.nonzero(place < 0)[0].tolist():
                        rest[found[i]] = rest.get(found[i], 0) + 1
                    tail.append(list(rest))
                    many.append(list(rest.values()))
                lengths = np.array(lengths)
                place, kind = np.concatenate(places), np.concatenate(kinds).astype(np.int64)
                u, v = _trigrams(kind, lengths, at_end)
                probability = lbl.log10(u, v, kind)
                inside = place >= 0
                logs = np.where(inside, vocab.logs[place], 0.0)
                outer = kind >= words
                probability[outer] += logs[outer] - vocab.tail_terms[kind[outer] - words]
                starts = np.cumsum(lengths) - lengths
                seen_here = inside & (logs > 0)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part << 32) + row + np.arange(n)), piece.column(0), piece.column(2), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat(seen_here, starts, dtype=np.int64)), pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(probability, starts)), pa.array(tail, pa.list_(pa.binary())), pa.array(many, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "training", "n_tokens", "known", "logs", "score", "rare", "times"],
                )
                row += n

    scored = saved(marked.select("doc_id", "text", "training").mapInArrow(score, f"row long, doc_id {kind_of_id}, training boolean, n_tokens long, known long, logs double, score double, rare array<binary>, times array<long>"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("token"), F.col("e.times").alias("times"))
    met = rare.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))
    both = scored.select("row", "doc_id", "training", "n_tokens", "known", "logs", "score", F.lit(None).cast("long").alias("more"), F.lit(None).cast("double").alias("gain")).unionByName(
        met.select("row", F.lit(None).cast(kind_of_id).alias("doc_id"), F.lit(None).cast("boolean").alias("training"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("known"), F.lit(None).cast("double").alias("logs"), F.lit(None).cast("double").alias("score"), "more", "gain")
    )
    gain = F.coalesce("gain", F.lit(0.0))
    one = both.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "training", "n_tokens", "known", "logs", "score", "more", "gain")])
    return one.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + gain - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
