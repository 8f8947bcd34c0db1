"""Packing by an exact round trip, mixing by its deviation bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_cover_every_document_once(docs, corpus, plain):
    model = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text, *_ in corpus:
        want[doc_id].append(np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    rows = packing.pack(docs.withColumn("g", F.lit(1)), **({"tokenizer": PATH} if plain else {}), group_docs=50).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, texts in want.items():
        for ids in texts:
            pieces, at = sorted(set(by_doc[doc_id, len(ids)])), 0
            for start, length, crc in pieces:
                assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
    assert sum(len(ids) for texts in want.values() for ids in texts) == sum(r["length"] for r in rows)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) / (2048 * len(by_sequence)) > 0.9


def test_special_strings_take_the_same_ids(spark):
    text = "a <|endoftext|> b"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = np.array([*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert [r["ids_crc32"] for r in packing.pack(df).collect()] == [zlib.crc32(ids.tobytes())]


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_differencing_is_near_equal_and_capacity_raises_the_count():
    rng = np.random.default_rng(3)
    sizes = rng.integers(120, 256, 600).tolist()
    found, ways = packing.windows(sizes, 2048)
    load = np.bincount(found, sizes, ways)
    assert load.max() <= 2048 and ways <= -(-sum(sizes) // 2048) + 2
    assert load.max() - load.min() < 200
    assert packing.windows([1500, 1500, 1500], 2048)[1] == 3
    assert packing.differencing([8, 7, 6, 5, 4], 2) and packing.windows([5], 2048) == ([0], 1)


@pytest.mark.parametrize("share", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 613, "b": 200, "c": 187}, {str(i): 1 + i % 3 for i in range(40)}])
def test_pfair_deviation_is_below_one_block(share):
    slots = mixing.pfair(share)
    period = sum(share.values())
    owner = {s: k for k, v in slots.items() for s in v}
    assert sorted(owner) == list(range(period))
    done = dict.fromkeys(share, 0)
    for t in range(period):
        done[owner[t]] += 1
        assert all(abs(done[k] - share[k] * (t + 1) / period) < 1 for k in share)


def test_shares_fill_the_period():
    for weights in ({"a": 1e-9, "b": 1, "c": 3}, {str(i): 1 for i in range(7)}, {str(i): 1 for i in range(30)}):
        out = mixing.shares(weights, 20)
        assert sum(out.values()) == max(20, len(weights)) and min(out.values()) >= 1


def test_mix_returns_all_rows_and_meets_the_weights(docs, corpus):
    rows = mixing.mix(docs, {"src0": 2, "src1": 1, "src2": 1}, block_chars=400).collect()
    assert len(rows) == len(corpus)
    assert all(r["slot"] is None for r in rows if r["source"] not in ("src0", "src1", "src2"))
    slots = {(r["source"], r["source_block"]): r["slot"] for r in rows if r["slot"] is not None}
    assert len(set(slots.values())) == len(slots)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows if r["slot"] is not None)
    assert all(r["mixed"] == (r["slot"] is not None) for r in rows)


def test_mix_edge_cases(docs, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(docs.withColumn("SLOT", F.lit(1)).withColumn("mixed", F.lit(2)).withColumn("mix_share", F.lit(3)))
    assert out.columns[-3:] == ["release", "deadline", "mixed_"] and "slot_" in out.columns
    assert out.count() == docs.count() and out.where("source is null and mixed_").count() >= 0
    assert mixing.mix(docs, {}).where("mixed").count() == 0
    assert mixing.mix(docs, most_broadcast=0).count() == docs.count()


def test_mix_goes_on_when_a_source_runs_out(spark):
    rows = [(i, "x" * 100, "large" if i % 4 else "middle") for i in range(800)] + [(900, "y", "single"), (901, "z", None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=100)
    assert out.where("mixed").count() == len(rows) == out.where("slot is not null").count()
    rows = [r for r in rows if r[2] != "middle"]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"large": 1, "single": 1}, block_chars=100).collect()
    assert [r["doc_id"] for r in got if not r["mixed"]] == [901]


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 400, "c": 90}, {"a": 1, "b": 1, "c": 5000}, {"a": 3000, "b": 3000, "c": 3000}])
def test_stretches_serve_every_block_within_one_of_its_weight(blocks):
    weights = {"a": 5, "b": 3, "c": 2}
    plan = mixing.stretches(weights, blocks, 20)
    ends = [x["first"] for x in plan[1:]] + [sum(blocks.values())]
    done = dict.fromkeys(blocks, 0)
    for x, end in zip(plan, ends):
        assert x["begin"] == {k: done[k] for k in x["share"]} and sum(map(len, x["turns"].values())) <= end - x["first"]
        owner = {s: k for k, v in x["turns"].items() for s in v}
        for t in range(end - x["first"]):
            done[owner[t % x["period"]]] += 1
            assert all(abs(done[k] - x["begin"][k] - a * (t + 1) / x["period"]) < 1 for k, a in x["share"].items())
    assert done == blocks


def test_characters_of_every_prefix_follow_the_weights(spark):
    rows = [(i, "x" * 1000, "long") for i in range(30)] + [(100 + i, "y" * 50, "short") for i in range(590)] + [(1000, "y" * 500, "short")] + [(2000 + i, None, "short") for i in range(9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"long": 1, "short": 1}, block_chars=100).collect()
    for source, longest in (("long", 1000), ("short", 500)):
        mine = [r for r in got if r["source"] == source]
        assert {b for r in mine for b in range(r["source_block"], r["last_block"] + 1)} == set(range(300))
        assert all(r["last_block"] - r["source_block"] <= len(r["text"] or "") // 100 + 1 for r in mine)
        for t in range(600):
            chars = sum(len(r["text"] or "") for r in mine if r["slot"] <= t)
            assert -100 <= chars - 50 * (t + 1) <= 100 + longest
