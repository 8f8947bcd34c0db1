"""Operator 6: packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import worker_cache


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The way of each size: partial partitions with the largest spread merge, large sums on small ones."""
    import numpy as np

    if not sizes:
        return []
    if ways == 1:
        return [0] * len(sizes)
    nodes: list[tuple] = []
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[-1] = s
        nodes.append((i, sums))
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = nodes[a][1] + nodes[b][1][::-1]  # both are in ascending order
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        nodes.append(((a, b, order), sums))
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), len(nodes) - 1))
    out = [0] * len(sizes)
    todo = [(len(nodes) - 1, np.arange(ways))]
    while todo:
        at, names = todo.pop()
        what = nodes[at][0]
        if isinstance(what, int):
            out[what] = int(names[-1])
            continue
        a, b, order = what
        mine = np.empty(ways, np.int64)
        mine[order] = names
        todo.append((a, mine))
        todo.append((b, mine[::-1]))
    return out


def windows(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """A window for each size, none over capacity, and how many there are; the count rises until all fit."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        load = [0] * ways
        for w, s in zip(found, sizes):
            load[w] += s
        if max(load) <= capacity:
            return found, ways
        ways += max(1, ways // 200)


class _Encoder:
    """Ids of whole texts as little-endian 32-bit words.

    path: a tokenizers file.  ranks: a file of the same vocabulary for a library that gives the same ids
    in a quarter of the time; texts that hold the string of a special token go through the first.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.model, self.quick = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        import numpy as np

        if self.quick and not any(s in text for s in self.special):
            return np.array(self.quick(text), "<u4").tobytes()
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = 2048, end_id: int = 1, fragment: int = 256, group_docs: int = 256, place: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file (its place on the executors), ranks: of a rank file of the same
    vocabulary, or None; without a tokenizer both are the public byte-level BPE of the installed
    vocabulary files.  A document is its ids, then end_id.  Whole windows of
    capacity are cut off first; the rest is cut into equal fragments of at most ``fragment`` ids.
    Documents are dealt at random to groups of about group_docs, in each of which the fragments are
    spread over windows by Karmarkar-Karp differencing; the number of windows rises from the least
    possible one while one exceeds capacity.

    place: a column with the place of each document, from 0 and without gaps.  With it each group_docs places in turn are a
    group, and sequence_ids ascend from group to group, so sequences come in the order of the documents.

    Without place docs should be a written table: groups follow the place of a row in its task, so a task that runs
    again must find its rows in the same order.

    Null and empty texts are the end id alone.  Repeated rows and doc_ids are documents of their own;
    null doc_ids keep their rows; an empty table gives an empty result; other columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = 1 if place else max(1, -(-docs.count() // group_docs))

    def cut(batches):
        import os
        import zlib

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        places = tokenizer, ranks
        if not tokenizer:
            import public_tokenizers

            places = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        encoder = worker_cache("encoder", str(places), lambda: _Encoder(*places))
        end, row = end_id.to_bytes(4, "little"), 0
        names = ["g", "d", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        part = TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                out = []
                for at, text in enumerate(piece.column(1)):
                    ids = memoryview(encoder.ids(text.as_py() or "") + end)
                    n, row = len(ids) // 4, row + 1
                    full = n // capacity * capacity
                    cuts = list(range(0, full + 1, capacity))
                    if n > full:
                        many = -(-(n - full) // fragment)
                        cuts += [full + (n - full) * j // many for j in range(1, many + 1)]
                    if place:
                        d = piece.column(2)[at].as_py()
                        g = d // group_docs
                    else:
                        d = (part << 32) + row
                        g = zlib.crc32(b"%d:%d" % (part, row)) % groups
                    out += [(g, d, at, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n) for s, e in zip(cuts, cuts[1:])]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), piece.column(0).take(pa.array(cols[2])), *(pa.array(c, pa.int64()) for c in cols[3:])], names=names)

    def deal(table: pa.Table) -> pa.Table:
        import numpy as np

        # a fixed order, so that a task that runs again deals alike
        table = table.sort_by([("d", "ascending"), ("start", "ascending")])
        g = table.column("g")[0].as_py()
        length = table.column("length").to_numpy()
        small = np.nonzero(length < capacity)[0]
        found, many = windows(length[small].tolist(), capacity) if len(small) else ([], 0)
        window = np.empty(len(length), np.int64)
        window[small] = found
        large = np.nonzero(length >= capacity)[0]
        window[large] = many + np.arange(len(large))
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(length[order])
        begin = np.concatenate([[True], np.diff(window[order]) != 0])
        offset = np.empty(len(length), np.int64)
        before = ends - length[order]
        offset[order] = before - np.maximum.accumulate(np.where(begin, before, 0))
        table = table.append_column("sequence_id", pa.array((g << 32) + window)).append_column("offset", pa.array(offset))
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = docs.select("doc_id", "text", *([F.col(place).cast("long")] if place else [])).mapInArrow(cut, f"g long, d long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return pieces.groupBy("g").applyInArrow(deal, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
