"""Operator 5: language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, worker_cache


class ByteTagger:
    """Two gated recurrent passes over windows of bytes; each position gets a probability for each language
    and, last, for noise: bytes in no order that a language has.

    In a pass, with the byte's rows of w: z = s(w_z + U_z h), r = s(w_r + U_r h), n = tanh(w_n + r U_n h),
    h = n + z (h - n).  Arrays are laid out (units, windows).
    """

    names = ("w", "u", "out", "bias")

    def __init__(self, languages: list[str], hidden: int, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.w = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.4 / hidden**0.5, (2, 3 * hidden, hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (len(languages) + 1, 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(languages) + 1, 1), np.float32)

    @classmethod
    def restored(cls, values: dict | None) -> ByteTagger | None:
        if values is None:
            return None
        out = cls.__new__(cls)
        vars(out).update(values)
        return out

    def _step(self, side: int, x, h, keep: list | None = None):
        import numpy as np

        k = self.hidden
        a = np.take(self.w[side], x, axis=1)
        b = self.u[side] @ h
        gates = a[: 2 * k]
        gates += b[: 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:k], gates[k:]
        n = r * b[2 * k :]
        n += a[2 * k :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((x, h, z, r, n, b[2 * k :]))
        new = h - n
        new *= z
        new += n
        return new

    def states(self, x, keep: list | None = None):
        """(length, 2 hidden, windows) of both passes over x (length, windows)."""
        import numpy as np

        length, count = x.shape
        k = self.hidden
        out = np.empty((length, 2 * k, count), np.float32)
        for side, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
            h = np.zeros((k, count), np.float32)
            for t in order:
                h = self._step(side, x[t], h, keep)
                out[t, side * k : (side + 1) * k] = h
        return out

    def positions(self, states):
        """(length, languages + 1, windows): the probability of each language, and of noise, at each position."""
        import numpy as np

        logits = self.out @ states
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x, y, sizes=None) -> dict:
        """Of the mean cross-entropy of all positions but the padding, by backpropagation through time.

        x: (windows, length) bytes, y: the class of each window, sizes: bytes of each before its padding.
        """
        import numpy as np

        k = self.hidden
        part = np.ascontiguousarray(x.T)
        length, count = part.shape
        keep: list = []
        states = self.states(part, keep)
        error = self.positions(states)
        error[:, y, np.arange(count)] -= 1
        real = np.ones((length, 1, count), bool) if sizes is None else (np.arange(length)[:, None] < sizes)[:, None, :]
        error *= real / np.float32(max(1, real.sum()))
        grad = {n: np.zeros_like(getattr(self, n)) for n in self.names}
        grad["out"] = np.einsum("tlc,thc->lh", error, states, optimize=True)
        grad["bias"] = error.sum(axis=(0, 2))[:, None]
        back = self.out.T @ error
        for side in (0, 1):
            carried = np.zeros((k, count), np.float32)
            times = range(length - 1, -1, -1) if side == 0 else range(length)
            dw = np.zeros((256, 3 * k), np.float32)
            for t in times:
                at = t if side == 0 else length + (length - 1 - t)
                xs, h, z, r, n, un = keep[at]
                d = back[t, side * k : (side + 1) * k] + carried
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn])
                db = np.concatenate([dz, dr, dn * r])
                carried = d * z + self.u[side].T @ db
                grad["u"][side] += db @ h.T
                np.add.at(dw, xs, da.T)
            grad["w"][side] = dw.T
        return grad

    def fit(self, x, y, sizes, steps: int, batch: int = 128, rate: float = 0.02, seed: int = 3) -> None:
        """Adam on the gradients of random batches, clipped to norm 1."""
        import numpy as np

        rng = np.random.default_rng(seed)
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.names}
        for step in range(1, steps + 1):
            i = rng.integers(0, len(y), min(batch, len(y)))
            grad = self.gradients(x[i], y[i], sizes[i])
            size = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
            pace = rate * min(1, 3 * (1 - step / (steps + 1)))
            for n in self.names:
                g = grad[n] * min(1, 1 / (size + 1e-9))
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                setattr(self, n, getattr(self, n) - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))

    def pooled(self, texts: list[bytes], window: int, block: int = 2048):
        """(texts, languages + 1): the mean over all bytes of each text of the positions' probabilities."""
        import numpy as np

        sizes = np.array([len(t) for t in texts])
        line = np.frombuffer(b"".join(texts), np.uint8)
        many = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), many)
        first = np.repeat(np.cumsum(sizes) - sizes, many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts, ends = first + inside * window, np.minimum(first + (inside + 1) * window, np.repeat(np.cumsum(sizes), many))
        out = np.zeros((len(texts), len(self.bias)))
        by_size = np.argsort(ends - starts, kind="stable")[::-1]
        for k in range(0, len(by_size), block):
            w = by_size[k : k + block]
            length = int((ends[w] - starts[w]).max())
            at = starts[w] + np.arange(length)[:, None]
            real = at < ends[w]
            x = np.where(real, line[np.minimum(at, len(line) - 1)], 0).astype(np.intp)
            p = self.positions(self.states(x))
            p *= real[:, None, :]
            total = p.sum(axis=0, dtype=np.float64)
            for j in range(len(self.bias)):
                out[:, j] += np.bincount(owner[w], total[j], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def noise(windows, seed: int = 17):
    """As many windows of noise as given: half have the bytes of a given one in random order, the rest any printable ASCII or only digits and signs."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = rng.permuted(windows, axis=1)
    kinds = rng.integers(0, 4, len(out))
    signs = np.frombuffer(b"0123456789 .,:;!?%&$#*+-=/|<>()[]{}@_~^'\"\\", np.uint8)
    out[kinds == 2] = rng.integers(32, 127, (int((kinds == 2).sum()), out.shape[1]))
    out[kinds == 3] = rng.choice(signs, (int((kinds == 3).sum()), out.shape[1]))
    return out


def learn(docs: DataFrame, training: Column, per_language: int = 2400, window: int = 64, hidden: int = 8, steps: int = 600) -> ByteTagger | None:
    """A tagger fitted to about per_language windows of each language among the training rows, None without any.

    training: Boolean column; of its rows those with text and lang count.  Whole texts are cut into
    windows of that many bytes, and windows are picked from all of them by a hash of the text and
    their place, so copies of a text give its windows once and any language with a text is picked from:
    of somewhat more than per_language, those with the lowest hashes.
    Only windows by language and the picked ones reach the driver.
    """
    import numpy as np

    known = docs.where(F.coalesce(training, F.lit(False)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    many = F.ceil(F.octet_length("text") / window).cast("int")
    known = known.select("lang", F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("h"), many.alias("many"))
    distinct = known.groupBy("lang", "h").agg(F.max("many").alias("many"))
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.sum("many").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    span = (1 << 63) - 1  # hashes have 63 bits, so a quota is never rounded to nothing
    wanted = per_language + 6 * int(per_language**0.5) + 10
    quota = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, span * min(wanted, n) // n)])
    draw = lambda k: F.xxhash64("h", k).bitwiseAND(F.lit(span))
    places = F.filter(F.sequence(F.lit(0), F.col("many") - 1), lambda k: draw(k) <= quota[F.col("lang")])
    parts = F.transform(places, lambda k: F.struct(k.alias("k"), draw(k).alias("draw"), F.substring(F.col("raw"), k * window + 1, F.lit(window)).alias("part")))
    picked = known.select("lang", "h", F.explode(parts).alias("p")).groupBy("lang", "p.draw", "h", "p.k").agg(F.first("p.part").alias("part"))
    x, y, ends, taken = [], [], [], dict.fromkeys(languages, 0)
    for r in sorted(picked.select("lang", "draw", "h", "k", "part").collect()):
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per_language:
            x.append(np.resize(np.frombuffer(bytes(r["part"]), np.uint8), window))
            y.append(languages.index(r["lang"]))
            ends.append(len(r["part"]))
    model = ByteTagger(languages, hidden)
    # languages, and noise, in equal parts, so that none is preferred for being frequent
    x, y, ends = np.array(x), np.array(y), np.array(ends)
    most = np.bincount(y, minlength=len(languages)).max()
    order = np.concatenate([np.resize(np.nonzero(y == k)[0], most) for k in range(len(languages)) if (y == k).any()])
    none = noise(x[order[:: len(languages)]])
    x, y = np.concatenate([x[order], none]), np.concatenate([y[order], np.full(len(none), len(languages))])
    ends = np.concatenate([ends[order], np.full(len(none), window)])
    rng = np.random.default_rng(19)  # a third of the windows are cut short, as short texts are
    ends = np.minimum(ends, np.where(rng.random(len(x)) < 1 / 3, rng.integers(6, window, len(x)), window))
    x[np.arange(window) >= ends[:, None]] = 0
    model.fit(x.astype(np.intp), y, ends, steps)
    return model


def identify(docs: DataFrame, model: ByteTagger | None, window: int = 64) -> DataFrame:
    """docs with lang_pred, score and noise; names taken get a trailing ``_``.

    Every byte of every text is labelled; a text's score for a language is the mean over its bytes,
    as a share of all languages; noise is the mean probability that its bytes are of none.
    A text that is null or has no letter, or any text without a model, is ``und`` with score 0 and noise 1.
    Ties go to the language first in order.  Repeated rows are judged each; an empty table gives an
    empty result; only text is read for a prediction.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    pred, score, other = fresh(docs, "lang_pred", "score", "noise")
    shared = spark.sparkContext.broadcast(vars(model) if model else None)  # plain values need no module to load
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np

        some = re.compile(r"[^\W\d_]")
        tagger = worker_cache("tagger", version, lambda: ByteTagger.restored(shared.value))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            names, scores, empty = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows)
            group: list = []
            held = 0

            def settle():
                if group:
                    mean = tagger.pooled([raw for _, raw in group], window)
                    best = mean[:, :-1].argmax(axis=1)
                    for (i, _), b, p in zip(group, best, mean):
                        names[i], scores[i], empty[i] = tagger.languages[b], min(1.0, float(p[b] / max(p[:-1].sum(), 1e-30))), min(1.0, float(p[-1]))
                group.clear()

            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                if tagger is None or not text or not any(m[0].isalpha() for m in some.finditer(text)):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                group.append((i, raw))
                held += len(raw)
                if held > 1_000_000:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(empty, pa.float64())], names=[*batch.schema.names, pred, score, other])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(other, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: ByteTagger | None, most_noise: float = 0.7, chance: float = 1e-6) -> DataFrame:
    """The rows of docs in a language that the model knows, with lang_pred, score and noise.

    Texts without a letter go, and those whose mean noise exceeds most_noise by more than the mean of so many bytes
    could by chance (Hoeffding's bound for that probability): the shorter a text, the more it may stray.
    Without a model, a letter is enough.
    """
    import math

    found = identify(docs, model)
    pred, _, other = (F.col(f"`{c}`") for c in found.columns[-3:])
    if model is None:
        return found.where(F.col("text").rlike(r"\p{L}"))
    stray = F.sqrt(F.lit(math.log(1 / chance) / 2) / F.greatest(F.octet_length("text"), F.lit(1)))
    return found.where((pred != "und") & (other <= most_noise + stray))
