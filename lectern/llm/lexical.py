"""Operator 13: ranked lexical search in reverse: documents stream through an inverted index of the items' terms."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import saved
from lectern.operators.ordered import running_total

#: What ends a term becomes a blank, A to Z become lower case; all other bytes, so all letters beyond ASCII, stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(raw: bytes, at_once: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of those of about at_once bytes."""
    folded = raw.translate(_FOLD)
    start = 0
    while len(folded) - start > at_once:
        end = folded.rfind(b" ", start, start + at_once)
        if end < 0:
            end = folded.find(b" ", start + at_once)
            if end < 0:
                break
        yield folded[start:end].split()
        start = end
    yield folded[start:].split()


class _Index:
    """Postings of a block of items: for each term its number, and by number the items that hold it and how often."""

    def __init__(self, items: list[tuple[list[bytes], list[int]]]):
        import numpy as np

        self.number: dict[bytes, int] = {}
        term, item, times = [], [], []
        for at, (terms, counts) in enumerate(items):
            for spelled, n in zip(terms, counts):
                term.append(self.number.setdefault(spelled, len(self.number)))
                item.append(at)
                times.append(n)
        order = np.argsort(np.array(term, np.int64), kind="stable")
        self.items = len(items)
        self.item = np.array(item, np.int64)[order]
        self.times = np.array(times, np.int64)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(np.array(term, np.int64), minlength=len(self.number)))]).astype(np.int64)

    @classmethod
    def restored(cls, values: dict) -> _Index:
        out = cls.__new__(cls)
        vars(out).update(values)
        return out

    def counts(self, batch) -> tuple:
        """Of a batch of texts: (number of terms of each; row, term number and times of each term of the index in each row)."""
        import numpy as np

        get, unknown = self.number.get, len(self.number)
        sizes, keys = np.zeros(len(batch), np.int64), [np.empty(0, np.int64)]
        for row, text in enumerate(batch):
            if not text.is_valid:
                continue
            met = []
            for terms in terms_of(text.as_buffer().to_pybytes()):
                sizes[row] += len(terms)
                found = np.fromiter((get(t, unknown) for t in terms), np.int64, len(terms))
                found = found[found < unknown]
                met.append(np.unique(found, return_counts=True) if len(terms) > 1 << 16 else (found, None))
            if len(met) == 1 and met[0][1] is None:
                keys.append(met[0][0] + row * (unknown + 1))
            else:  # a very long text: its counts have been taken by parts
                total: Counter = Counter()
                for found, times in met:
                    total.update(dict(zip(found.tolist(), times.tolist())) if times is not None else found.tolist())
                keys.append(np.repeat(np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))) + row * (unknown + 1))
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return sizes, key // (unknown + 1), key % (unknown + 1), times


class _Earlier:
    """A doc_id that sorts before a smaller one, a null one first of all: the root of a heap is the worst of it."""

    __slots__ = ("key",)

    def __init__(self, doc_id):
        self.key = (doc_id is None, 0 if doc_id is None else doc_id)

    def __lt__(self, other) -> bool:
        return other.key < self.key


def _tally(docs: DataFrame, shared) -> DataFrame:
    """(term, n): documents that hold each term of the index; -1 counts documents with terms, -2 all their terms."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        index = _Index.restored(shared.value)
        holding, with_terms, terms = np.zeros(len(index.number), np.int64), 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sizes, _, term, _ = index.counts(batch.column(0).slice(k, 256))
                holding += np.bincount(term, minlength=len(holding))
                with_terms += int((sizes > 0).sum())
                terms += int(sizes.sum())
        some = np.nonzero(holding)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([with_terms, terms, *holding[some].tolist()], pa.int64())], names=["term", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _heaps(docs: DataFrame, shared, worth, documents: int, terms: int, k: int) -> DataFrame:
    """(at, doc_id, score, task): the best k documents of each item in each task."""
    import pyarrow as pa

    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType()), T.StructField("task", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        index, weight = _Index.restored(shared.value), worth.value
        value = np.repeat(weight, np.diff(index.starts)) * index.times  # of one posting
        heaps: list[list] = [[] for _ in range(index.items)]
        least = np.ones(index.items, np.int64)  # what a document needs to be among the best of an item
        rows = max(1, min(256, (1 << 21) // index.items))
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                sizes, row, term, times = index.counts(piece.column(1))
                length = np.array([25 + 75 * n * documents // terms for n in sizes.tolist()], np.int64)
                part = 1_000_000_000 * times // (1000 * times + 8 * length[row])
                many = index.starts[term + 1] - index.starts[term]
                ends = np.cumsum(many)
                score = np.zeros((len(sizes), index.items), np.int64)
                low = 0
                while low < len(many):  # some 4 million postings at once
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] - many[low] + (1 << 22), "right")))
                    n, first = many[low:high], index.starts[term[low:high]]
                    posting = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                    np.add.at(score.reshape(-1), np.repeat(row[low:high] * index.items, n) + index.item[posting], value[posting] * np.repeat(part[low:high], n))
                    low = high
                for r, i in zip(*map(np.ndarray.tolist, np.nonzero(score >= least))):
                    heap, entry = heaps[i], (int(score[r, i]), _Earlier(piece.column(0)[r].as_py()))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif heap[0] < entry:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        task = TaskContext.get().partitionId()
        found = [(i, None if e.key[0] else e.key[1], s) for i, heap in enumerate(heaps) for s, e in heap]
        if found:
            at, ids, scores = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64()), pa.array([task] * len(at), pa.int64())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _best(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, of those with a score above 0.

    Terms are the longest stretches of ASCII letters, digits and anything beyond ASCII, in whole texts,
    with A to Z in lower case.  The weight of a term falls with the documents that hold it, what its occurrences
    add levels off with their number and with the length of the document (integers throughout but for the
    logarithm of the weight).

    Items are cut into blocks of block_terms distinct terms (one item may exceed it).  The index of a block
    is broadcast, so its size is bounded by block_terms and the largest single text, however many items
    there are; all documents stream through it twice: to count the documents that hold
    each term, then to score.  A task keeps a heap of k documents for each item of the block; heaps are merged
    in two steps.

    Null texts have no terms.  Documents with equal scores go by ascending doc_id, null ones last; repeated
    rows are documents of their own, repeated items are ranked each by itself.  Other columns are
    ignored, empty tables give an empty result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    item_type, doc_type = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for text in batch.column(1):
                counts.append(Counter())
                for terms in terms_of(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    counts[-1].update(terms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) for c in counts], pa.int64()), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["item_id", "size", "terms", "times"],
            )

    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("size", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])
    listed = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(split, schema).where("size > 0")
    numbered = saved(listed.withColumn("row", F.monotonically_increasing_id()))
    placed = running_total(numbered, "row", "size", F.shiftright("row", 33))
    placed = saved(placed.withColumn("block", F.expr(f"before div {block_terms}")).drop("before"))
    blocks = [r[0] for r in placed.select("block").distinct().orderBy("block").collect()]
    result = None
    for block in blocks:
        mine = placed.where(F.col("block") == block).orderBy("row").select("item_id", "terms", "times").collect()
        shared = spark.sparkContext.broadcast(vars(_Index([(r["terms"], r["times"]) for r in mine])))  # plain values need no module to load
        found = dict(map(tuple, _tally(docs, shared).collect()))
        documents, terms = found.pop(-1, 0), found.pop(-2, 0)
        if not terms:
            break
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(shared.value["number"]))]
        import numpy as np

        worth = spark.sparkContext.broadcast(np.array(weights, np.int64))
        best = _best(_heaps(docs, shared, worth, documents, terms, k).withColumn("group", F.expr("task div 64")), k, "at", "group")
        best = _best(best.select("at", "doc_id", "score"), k, "at")
        names = spark.createDataFrame([(at, r["item_id"]) for at, r in enumerate(mine)], T.StructType([T.StructField("at", T.LongType()), T.StructField("item_id", item_type)]))
        best = best.join(names, "at").select("item_id", "rank", "doc_id", "score")
        if len(blocks) > 1:  # one block's index at a time on the driver
            best = saved(best)
            shared.destroy()
            worth.destroy()
        result = best if result is None else result.unionByName(best)
    if result is None:
        fields = [T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    return result
