"""The trie of conversations against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    """conv_id: its turns in order."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:28] + len(text.encode()).to_bytes(4)
            groups[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(g)] for c, g in groups.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - int(c - 5 * int(c / 5))
        out[c] = turns.get(first, [])[:h] + own[h:]
    return out


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, kept = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        kept[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(kept[c] for c in children[p])
    return sorted(
        str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], kept[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
        for p, m in members.items()
    )


def strings(df):
    return sorted(str(tuple(r)) for r in df.collect())


def made(seed, convs=60, deepest=12):
    rng = random.Random(seed)
    some = [(r, t) for r in ("user", "assistant", None) for t in ("a", "bé", "", None, "long " * 3)]
    rows = []
    for c in range(convs):
        at = rng.choice([3, c])
        turns = [random.Random(f"{at} {k}").choice(some) for k in range(rng.randrange(deepest))]
        rows += [(c, k if k else None, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,segment,most_keys", [(1, 1024, 8192), (2, 2, 3), (3, 3, 1), (4, 1, 5)])
def test_nodes_equal_plain_prefixes(spark, seed, segment, most_keys):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("id", F.lit("x")).repartition(5)
    turns = trie.numbered(df)
    convs = plain_turns(rows)
    assert strings(trie.prefix_trie(turns, segment, most_keys)) == plain_nodes(convs)
    assert strings(trie.prefix_trie(trie.rebuilt(turns), segment, most_keys)) == plain_nodes(plain_rebuilt(convs))


def test_ties_repeats_nulls_and_odd_ids(spark):
    rows = [(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, None, None, None), (-3, 5, "x", "y"), (-3, 6, "x", "z"), (0, 5, "x", "y"), (-5, 1, "q", "q"), (None, 1, "user", "lost"), (None, 2, "user", "lost")]
    rows += [(2**40, k, "user", "same") for k in range(3)] + [(2**40 + 1, k, "user", "same") for k in range(4)]
    turns = trie.numbered(spark.createDataFrame(rows, SCHEMA))
    convs = plain_turns(rows)
    assert strings(trie.prefix_trie(turns)) == plain_nodes(convs)
    assert strings(trie.prefix_trie(trie.rebuilt(turns))) == plain_nodes(plain_rebuilt(convs))


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(c, k, "user", f"t{k}") for c in (1, 9000) for k in range(700 + c % 2)] + [(c, k, "user", f"t{k}") for c in range(2, 8500, 2) for k in range(1)]
    found = trie.prefix_trie(trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(4)), segment=64, most_keys=10)
    assert strings(found) == plain_nodes(plain_turns(rows))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = trie.prefix_trie(trie.rebuilt(trie.numbered(empty)))
    assert found.count() == 0 and found.columns[0] == "conv_id" and len(found.columns) == 8


def test_tree_grows_through_all_layouts_and_splits_skipped_bytes():
    rng = random.Random(6)
    tree, want, kinds = trie.RadixTree(), {}, set()

    def layouts(node):
        kinds.add((type(node.children).__name__, getattr(node.children, "most", 0)))
        for _, below in node.children.items() if node.children else ():
            layouts(below)

    for k in range(3000):
        key = bytes(rng.randrange(256 if n == 0 else 3) for n in range(rng.randrange(7)))
        want[key] = k
        tree.insert(key, k)
        if k in (3, 15, 40, 2999):
            layouts(tree.root)
    assert kinds == {("NoneType", 0), ("_Few", 4), ("_Few", 16), ("_Some", 0), ("_All", 0)}
    assert all(tree.get(key) == value for key, value in want.items())
    assert tree.get(b"\x00\x00\x00\x00\x00\x00\x00\x00\x09") is None

    def walk(node, path):
        path += node.skipped
        if node.value is not None:
            yield path, node.value
        for byte, below in node.children.items() if node.children else ():
            yield from walk(below, path + bytes([byte]))

    assert list(walk(tree.root, b"")) == sorted(want.items())


def test_query_on_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert strings(queries.op11_prefix_trie(spark, "/root/testdata/sf0.001")) == plain_nodes(plain_rebuilt(plain_turns(rows)))
