"""The transducer and the streaming decoder against the merging library and plain merging."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = bpe.TextEncoder(RANKS, public_tokenizers.PATTERN, most_known=50)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPELLING = {i: t for t, i in RANKS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="ab ") | st.text(alphabet="éà漢字 the'll12\n\t!"))
def test_ids_equal_the_library(text):
    ids = np.frombuffer(ENCODER.packed(text), "<u4").tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    decoder = bpe.StreamDecoder(SPELLING)
    assert decoder.feed(ids) + decoder.finish() == text.encode()


def test_any_bytes_equal_plain_merging_whatever_is_forgotten():
    rng = random.Random(2)
    small = bpe.Transducer(RANKS, most_states=20)
    for _ in range(800):
        raw = bytes(rng.choice(b"ab\xc3\xa9\xe6\xbc\xa2 the in\x00\xff") for _ in range(rng.randrange(60)))
        assert small.encode(raw) == small.merged(raw)
        assert len(small.states) < 200
    for _ in range(3000):
        a, b = rng.randrange(len(RANKS)), rng.randrange(len(RANKS))
        assert small.neighbours(a, b) == (small.merged(SPELLING[a] + SPELLING[b]) == [a, b])


def test_lookahead_is_bounded_by_the_longest_token():
    t = bpe.Transducer(RANKS)
    state, given_out, longest = t.start, 0, max(map(len, RANKS))
    text = " the international unbelievable aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa".encode()
    for place, byte in enumerate(text, 1):
        state, sure = state.arcs.get(byte) or t.arc(state, byte)
        given_out += sum(len(SPELLING[i]) for i in sure)
        assert len(state.readings) <= longest + 1
        assert place - given_out <= 2 * longest


def test_a_vocabulary_that_merging_cannot_reach_is_refused():
    plain = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="no merges lead"):
        bpe.Transducer(plain | {b"abc": 256})
    with pytest.raises(ValueError, match="no token for byte"):
        bpe.Transducer({b"a": 0})
    tiny = bpe.Transducer(plain | {b"aa": 256, b"ab": 257, b"aab": 258})
    assert tiny.encode(b"aaab") == tiny.merged(b"aaab") == [256, 257]


def test_decoding_ids_in_pieces_keeps_characters_whole():
    ids = [i for byte in "aé漢😀".encode() for i in [RANKS[bytes([byte])]]]
    decoder = bpe.StreamDecoder(SPELLING)
    assert b"".join(decoder.feed([i]) for i in ids) + decoder.finish() == "aé漢😀".encode()
    for cut in range(len(ids)):
        decoder = bpe.StreamDecoder(SPELLING)
        got = decoder.feed(ids[:cut])
        got.decode()  # never half a character
        assert got + decoder.feed(ids[cut:]) == "aé漢😀".encode()
    with pytest.raises(KeyError):
        decoder.feed([10**6])


def test_bytes_that_are_no_text_are_replaced():
    rng = random.Random(3)
    decoder = bpe.StreamDecoder(SPELLING)
    for _ in range(2000):
        raw = bytes(rng.choice(b"a\xc3\xa9\xe0\xa0\xed\x9f\xbf\xf0\x90\xf4\x8f\x80\xff") for _ in range(rng.randrange(9)))
        ids, at = [], 0
        while at < len(raw):
            n = rng.choice([n for n in (1, 2, 3) if raw[at : at + n] in RANKS])
            ids.append(RANKS[raw[at : at + n]])
            at += n
        assert (decoder.feed(ids) + decoder.finish()).decode() == raw.decode(errors="replace")


def test_rows_of_every_kind(spark, docs, corpus, empty):
    found = bpe.decode(bpe.encode(docs)).collect()
    assert found[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "ids", "decoded"}
    want = sorted((str(r[0]), r[1] or "") for r in corpus)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in found) == want
    assert all(r["ids"] == LIBRARY.encode_ordinary(r["decoded"]) for r in found)
    assert bpe.decode(bpe.encode(empty)).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("decoded"), F.lit(2).alias("_kept"))
    for again in (bpe.decode(bpe.encode(clash, packed=True)), bpe.round_trip(clash, packed=True)):
        assert again.columns == ["doc_id", "_kept", "ids", "decoded"] and {r["decoded"] for r in again.collect()} == {t for _, t in want}


def test_very_long_text_and_bytes_that_are_no_utf8(spark):
    long = "word tail " * 150_000 + "x" * 70_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string").unionByName(spark.sql("SELECT 2L AS doc_id, CAST(X'61FF62' AS STRING) AS text"))
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df)).collect()}
    assert found[1]["ids"] == LIBRARY.encode_ordinary(long) and found[1]["decoded"] == long
    assert found[2]["decoded"] == "a�b"


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows)
    for r in rows:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert tuple(found[r["doc_id"]])[1:] == want
