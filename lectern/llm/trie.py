"""Operator 11: the prefix trie of conversations, by adaptive radix trees over turn ids of fixed width."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import dropped, saved

#: Bytes of a turn id: 28 of a digest of role and text, then the bytes of the text as a big-endian number.
WIDTH = 32


# ---------------------------------------------------------------- adaptive radix tree


class _Few:
    """Children under up to 4, then 16 bytes: sorted bytes beside the children."""

    __slots__ = ("most", "keys", "nodes")

    def __init__(self, most: int, keys=(), nodes=()):
        self.most, self.keys, self.nodes = most, bytearray(keys), list(nodes)

    def find(self, byte: int):
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def add(self, byte: int, node):
        if len(self.keys) == self.most:
            grown = _Few(16, self.keys, self.nodes) if self.most == 4 else _Some(zip(self.keys, self.nodes))
            return grown.add(byte, node)
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self):
        return zip(self.keys, self.nodes)


class _Some:
    """Children under up to 48 bytes: a place in a list for each of the 256 bytes."""

    __slots__ = ("place", "nodes")

    def __init__(self, items):
        self.place, self.nodes = bytearray(256), []
        for byte, node in items:
            self.add(byte, node)

    def find(self, byte: int):
        at = self.place[byte]
        return self.nodes[at - 1] if at else None

    def add(self, byte: int, node):
        if len(self.nodes) == 48:
            return _All(self.items()).add(byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.place) if at)


class _All:
    """A child for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self, items):
        self.nodes = [None] * 256
        for byte, node in items:
            self.nodes[byte] = node

    def find(self, byte: int):
        return self.nodes[byte]

    def add(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A node of the tree: the bytes it skips, the value of a key that ends after them, and its children."""

    __slots__ = ("skipped", "value", "children")

    def __init__(self, skipped: bytes, value=None, children=None):
        self.skipped, self.value, self.children = skipped, value, children


class RadixTree:
    """Keys to values.  Paths without a branch are kept as bytes in the node they lead to."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            skipped = node.skipped
            if not key.startswith(skipped, at):
                same = next(k for k, byte in enumerate(skipped) if at + k == len(key) or key[at + k] != byte)
                lower = Node(skipped[same + 1 :], node.value, node.children)
                node.skipped, node.value, node.children = skipped[:same], None, _Few(4).add(skipped[same], lower)
                skipped = node.skipped
            at += len(skipped)
            if at == len(key):
                node.value = value
                return
            below = node.children.find(key[at]) if node.children else None
            if below is None:
                node.children = (node.children or _Few(4)).add(key[at], Node(key[at + 1 :], value))
                return
            node, at = below, at + 1

    def get(self, key: bytes):
        node, at = self.root, 0
        while node is not None and key.startswith(node.skipped, at):
            at += len(node.skipped)
            if at == len(key):
                return node.value
            node, at = (node.children.find(key[at]) if node.children else None), at + 1
        return None


# ---------------------------------------------------------------- nodes of the trie in sorted keys


def node_id(root: bytes, prefix) -> bytes:
    """The id of the node that the turns of prefix (a hash of them) lead to below the node root."""
    return hashlib.sha256(root + prefix.digest()).digest()


class _Entry:
    """A distinct sequence of turn ids below a node root, with what is known of the conversations that hold it."""

    __slots__ = ("root", "base", "key", "n", "low", "goes_on", "extra", "ends")

    def __init__(self, root, base, key, extra):
        self.root, self.base, self.key, self.extra = root, base, key, extra
        self.n, self.low, self.goes_on, self.ends = 0, None, False, None

    def add(self, n, low, ending, ends) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)
        self.goes_on |= ending < n
        if ending:
            if self.ends is None:
                self.ends = hashlib.sha256(ends.encode())
            else:
                self.ends.update(b"," + ends.encode())


def _walk(entries: list[_Entry], open_keys: list[bytes]) -> Iterator[list]:
    """Rows of the trie nodes that the entries, all below one root, reach.

    [id, parent id, open, parent's conv_id, conv_id, depth, members, children, leaves, saved, digest of ends].  A node is open if
    it lies on the way to one of open_keys: neighbouring entries elsewhere may reach it too, so its
    numbers are parts of sums.
    """
    root, base = entries[0].root, entries[0].base
    tree = RadixTree()
    for e in entries:
        tree.insert(e.key, e)
    empty = hashlib.sha256()
    rows: list[list] = []
    closed: dict[bytes, int] = {}
    top = root or node_id(b"", empty)

    def frame(node, start, path, state, parent):
        """What the walk keeps of a tree node: its end, the trie nodes on the way to it, and running sums."""
        places = []
        for at in range(start // WIDTH * WIDTH + WIDTH, len(path) + 1, WIDTH):
            state = state.copy()
            state.update(path[at - WIDTH : at])
            mine = node_id(root, state)
            places.append((at, mine, parent))
            parent = mine
        return [node, path, state, parent, places, iter(node.children.items()) if node.children else iter(()), 0, None, 0, 0, 0]

    stack = [frame(tree.root, 0, tree.root.skipped, empty, top)]
    stack[0][4].insert(0, (0, top, None))
    while stack:
        node, path, state, parent, places, below, *_ = now = stack[-1]
        child = next(below, None)
        if child is not None:
            byte, lower = child
            stack.append(frame(lower, len(path), path + bytes([byte]) + lower.skipped, state, parent))
            continue
        stack.pop()
        members, low, leaves, kept, fan = now[6:]
        value = node.value
        if value is not None:
            members += value.n
            low = value.low if low is None else min(low, value.low)
            if node.children is None:
                leaves = 0 if value.goes_on else 1
                if value.extra:
                    fan, leaves, kept = value.extra
        for at, mine, above in reversed(places):
            kept += (members - 1) * int.from_bytes(path[at - 4 : at]) if at else 0
            going = value is not None and at == len(path) and value.goes_on
            is_open = going or any(k.startswith(path[:at]) for k in open_keys)
            ends = value.ends.hexdigest() if value is not None and at == len(path) and value.ends else None
            rows.append([mine, above, is_open, None, low, base + at // WIDTH, members, fan, leaves, kept, ends])
            if not is_open and at:  # a root has more members than those that go on below it
                closed[mine] = low
            fan = 1
        if stack:
            up = stack[-1]
            up[6] += members
            up[7] = low if up[7] is None else min(up[7], low)
            up[8] += leaves
            up[9] += kept
            up[10] += fan
    for row in rows:
        row[3] = closed.get(row[1])
        yield row


def _overlap(before: tuple[bytes, bytes], after: tuple[bytes, bytes, int]) -> Iterator[list]:
    """Rows that mend sums where the last (root, key) of some entries and the first (root, key, base) of the next share nodes.

    Both sides count a shared node as a child, and take one copy of its text off what is saved; and the last
    key may have passed for a leaf.
    """
    root, key, base = after
    if before[0] != root:
        return
    same = 0
    while before[1][same : same + WIDTH] == key[same : same + WIDTH] and same + WIDTH <= min(len(before[1]), len(key)):
        same += WIDTH
    leaf = -1 if len(before[1]) == same else 0
    state, ids = hashlib.sha256(), [root or node_id(b"", hashlib.sha256())]
    for at in range(WIDTH, same + 1, WIDTH):
        state.update(key[at - WIDTH : at])
        ids.append(node_id(root, state))
    kept = 0
    for at in range(same, -1, -WIDTH):
        kept += int.from_bytes(key[at - 4 : at]) if at else 0
        d = at // WIDTH
        yield [ids[d], ids[d - 1] if d else None, True, None, None, base + d, 0, -1 if at < same else 0, leaf, kept, None]


_ROW = "id binary, parent binary, open boolean, parent_conv long, conv_id long, depth long, n long, children long, leaves long, saved long, ends string"
_PARTS = _ROW + ", task long, first_root binary, first_key binary, first_base long, last_root binary, last_key binary"


def _parts(keys: DataFrame, tops: bool, most_keys: int) -> DataFrame:
    """Rows of _walk and _overlap over keys in sorted ranges; each task adds a row with its first and last key.

    tops: only the nodes that are roots below the first one; else all others.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in _PARTS.split(", ")]
    kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PARTS.split(", ")])

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def entries(batches) -> Iterator[_Entry]:
        now = None
        for batch in batches:
            for root, base, key, n, low, ending, ends, *extra in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != key or now.root != root:
                    if now is not None:
                        yield now
                    now = _Entry(root, base, key, tuple(extra) if extra and extra[0] is not None else None)
                now.add(n, low, ending, ends)
        if now is not None:
            yield now

    def stretches(batches) -> Iterator[list[_Entry]]:
        some, size = [], 0
        for entry in entries(batches):
            if len(some) == most_keys or size > 1 << 24:
                yield some
                some, size = [], 0
            some.append(entry)
            size += len(entry.key)
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyspark import TaskContext

        first = before = None
        wanted = lambda row, base: (row[5] == base and base > 0) == tops
        for some in stretches(batches):
            rows: list[list] = []
            here, there = some[0], some[-1]
            if before is not None:
                rows += [r for r in _overlap((before.root, before.key), (here.root, here.key, here.base)) if wanted(r, here.base)]
            first = first or here
            for root, run_of in groupby(some, lambda e: e.root):
                mine = list(run_of)
                ways = ([here.key] if root == here.root else []) + ([there.key] if root == there.root else [])
                for row in _walk(mine, ways):
                    if wanted(row, mine[0].base):
                        row[2] |= tops
                        rows.append(row)
            before = there
            if rows:
                yield table([r + [None] * 6 for r in rows])
        if before is not None:
            yield table([[None] * 11 + [TaskContext.get().partitionId(), first.root, first.key, first.base, before.root, before.key]])

    ranged = keys.repartitionByRange("root", "key").sortWithinPartitions("root", "key", "low")
    return ranged.mapInArrow(run, _PARTS)


def _merged(parts: DataFrame, tops: bool) -> DataFrame:
    """The open nodes of saved parts, summed, with what tasks that follow each other counted twice put right."""
    spark = parts.sparkSession
    edges = parts.where("task IS NOT NULL").select("task", "first_root", "first_key", "first_base", "last_root", "last_key")
    tasks = sorted(r[0] for r in edges.select("task").collect())  # a number for each task that had rows
    rows = parts.where("task IS NULL AND open").select(*[c.split()[0] for c in _ROW.split(", ")])
    if len(tasks) > 1:
        follow = spark.createDataFrame(list(zip(tasks, tasks[1:])), "a long, b long")
        left = edges.select(F.col("task").alias("a"), "last_root", "last_key")
        right = edges.select(F.col("task").alias("b"), "first_root", "first_key", "first_base")
        pairs = follow.join(left, "a").join(right, "b").select("last_root", "last_key", "first_root", "first_key", "first_base")

        def mend(frames):
            import pandas as pd

            for pdf in frames:
                found = []
                for last_root, last_key, root, key, base in pdf.itertuples(index=False):
                    found += [r for r in _overlap((last_root, last_key), (root, key, base)) if (r[5] == base and base > 0) == tops]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in _ROW.split(", ")]).astype({"parent_conv": "Int64", "conv_id": "Int64"})

        rows = rows.unionByName(pairs.mapInPandas(mend, _ROW))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    return rows.groupBy("id").agg(F.max("parent").alias("parent"), F.max("parent_conv").alias("parent_conv"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends").alias("ends"))


def _below(roots: DataFrame, local: DataFrame) -> DataFrame:
    """(id, children, leaves, saved) of roots (id, up), with what all roots below them add; local: the same of each alone.

    Sums reach up twice as far in each round, so a sequence of any length takes a logarithm of rounds.
    """
    now = saved(roots.join(local.select("id", "children", "leaves", "saved"), "id"))
    while not now.where("up IS NOT NULL").isEmpty():
        gained = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = now.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        after = now.join(gained, "id", "left").join(further, "up", "left")
        after = saved(after.select("id", F.col("upper").alias("up"), "children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        dropped(now)
        now = after
    return now.select("id", "children", "leaves", "saved")


def _chained(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, root, up): the node that each segment but the first starts from, and the one before that."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, root = None, b""
        for batch in batches:
            out = []
            for c, seg, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if c != conv:
                    conv, root = c, b""
                after = hashlib.sha256(root + digest).digest()
                out.append((c, seg + 1, after, root or None))
                root = after
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names=["conv_id", "seg", "root", "up"])

    ordered = segments.where("goes_on").select("conv_id", "seg", F.unhex(F.sha2("key", 256)).alias("digest")).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(run, "conv_id long, seg long, root binary, up binary")


# ---------------------------------------------------------------- conversations


def turn_id(role: Column, text: Column) -> Column:
    """WIDTH bytes that tell turns apart by role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * (WIDTH - 4))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, id, total): the turns of each conversation by turn (null first), places from 0.

    Turns of one number go by their ids.  Rows with a null conv_id belong to no conversation.  Turns
    are dealt in ranges of conversation and turn, and only counted across ranges: one conversation may hold most rows.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"))
    ranged = saved(rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "id").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id").orderBy("range")
    bases = counts.select("conv_id", "range", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "id")
    placed = ranged.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["conv_id", "range"])
    return placed.select("conv_id", (F.col("before") + F.col("inside")).alias("place"), "id", "total")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Numbered turns of conversations that start with turns of the first one of their family.

    Conversation c gets the first h turns of c - c % family (as many as there are), then its own after
    its first h; h is crc32 of c in decimal, modulo heads.  A conversation left without turns stays, as one row
    with a null place.
    """
    known = turns.groupBy("conv_id").agg(F.max("total").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = known.select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    plan = known.withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % family}).join(first, "first", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = saved(plan.select("conv_id", "first", "h", "taken", "total"))
    shared = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < heads - 1)).select(F.col("conv_id").alias("first"), "place", "id")
    begun = plan.join(shared, "first").where("place < h").select("conv_id", "place", "id", "total")
    own = turns.drop("total").join(plan, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id", "total")
    bare = plan.where("total = 0").select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("id"), "total")
    return begun.unionByName(own).unionByName(bare)


def prefix_trie(turns: DataFrame, segment: int = 1024, most_keys: int = 8192) -> DataFrame:
    """A row for each distinct beginning of the conversations in turns (see numbered; a null place: no turn).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (what
    one copy of each text in the subtree saves in bytes), ends_sha256 (of the ids of members that end here).

    Sequences of turn ids are sorted in ranges, and each task builds adaptive radix trees over stretches of up to most_keys
    of them: nodes inside a stretch are final there, those on the way to its first and last key are
    partial sums, merged afterwards.  Equal sequences are counted, in blocks of conversation ids, before the sort;
    so a sequence may belong to most conversations.  Sequences longer than segment turns go on below the node that their
    first segment leads to, so no row or tree grows with the longest conversation.

    An empty table gives no nodes.  A digest of ids has to read them in order: for each node that is one task's pass over
    the joined ids of the conversations that end there.
    """
    seg = F.coalesce("place", F.lit(0))
    seg = F.floor(seg / segment).cast("long")
    listed = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id"))))
    key = F.unhex(F.array_join(F.transform(listed, lambda t: F.hex(t["id"])), ""))
    segments = turns.groupBy("conv_id", seg.alias("seg")).agg(key.alias("key"), F.max("total").alias("total"))
    segments = saved(segments.select("conv_id", "seg", "key", ((F.col("seg") + 1) * segment < F.col("total")).alias("goes_on")))
    longer = not segments.where("goes_on").isEmpty()
    if longer:
        chain = saved(_chained(segments))
        rooted = segments.where("seg = 0").withColumn("root", F.lit(b"")).unionByName(segments.where("seg > 0").join(chain.drop("up"), ["conv_id", "seg"]))
    else:
        rooted = segments.withColumn("root", F.lit(b""))
    ending = F.when(~F.col("goes_on"), F.col("conv_id"))
    ends = F.sort_array(F.collect_list(ending))
    keys = rooted.groupBy("root", (F.col("seg") * segment).alias("base"), "key", F.shiftright("conv_id", 12).alias("block")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.count(ending).alias("ending"), F.array_join(ends.cast("array<string>"), ",").alias("ends")
    )
    keys = keys.select("root", "base", "key", "n", "low", "ending", "ends")
    if longer:
        keys = saved(keys)
        roots = chain.select(F.col("root").alias("id"), "up").distinct()
        below = _below(roots, _merged(saved(_parts(keys, True, most_keys)), True))
        under = F.unhex(F.sha2(F.concat("root", F.unhex(F.sha2("key", 256))), 256))
        met = keys.where("ending < n").withColumn("id", under).join(below, "id").select(*keys.columns, "children", "leaves", "saved")
        keys = keys.where("ending = n").withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")}).unionByName(met)
    parts = saved(_parts(keys, False, most_keys))
    merged = saved(_merged(parts, False))
    inside = parts.where("task IS NULL AND NOT open").select("id", "parent", "parent_conv", "conv_id", "depth", "n", "children", "leaves", "saved", "ends")
    above = merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    rest = inside.unionByName(merged).where("parent_conv IS NULL").join(above, "parent", "left").withColumn("parent_conv", F.col("above"))
    nodes = inside.unionByName(merged).where("parent_conv IS NOT NULL").unionByName(rest.select(*inside.columns))
    return nodes.select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
