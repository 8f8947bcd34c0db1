"""The registered queries against their DuckDB SQL, and against brute force where SQL has none."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as library
from lectern.llm import queries
from tests.llm.test_copies import print_of, rooted, smallest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.QUERIES) <= set(library.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    plain = lambda rows, at: Counter(tuple(str(r[i]) for i in at) for r in rows)
    assert plain(df.collect(), [df.columns.index(c) for c in columns]) == plain(found.fetchall(), [names.index(c) for c in columns])


def test_columns_and_rows_of_the_other_queries(spark, duck):
    total = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    want = {
        "op2_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, DATA)
        rows = df.collect()
        assert df.columns == columns and len(rows) == total
        if "held_out" in columns:
            modulus = 7 if name.startswith("op2") else 4
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == 2) for r in rows)


def documents(duck):
    return duck.execute("SELECT doc_id, text, source, lang FROM documents").fetchall()


def test_simhash_query_matches_brute_force(spark, duck):
    rows = documents(duck)
    prints = [print_of(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    ids = [r[0] for r in rows]
    want = Counter(zip(ids, (f"{p:016x}" for p in prints), smallest(ids, rooted(len(ids), pairs))))
    assert Counter(tuple(r) for r in queries.op10_simhash(spark, DATA).collect()) == want and pairs


def test_packing_query_is_an_exact_round_trip(spark, duck):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, DATA).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    rows = documents(duck)
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids, at = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, total in sorted(pieces[doc_id]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(n for parts in sequences.values() for _, n in parts) / (2048 * len(sequences)) > 0.9


def test_mixing_query_follows_the_tempered_weights(spark, duck):
    rows = documents(duck)
    got = {r["doc_id"]: r for r in queries.op7_mixing(spark, DATA).collect()}
    assert set(got) == {r[0] for r in rows} and all(r["mixed"] and r["release"] <= r["slot"] < r["deadline"] for r in got.values())
    chars = defaultdict(int)
    for doc_id, text, source, _ in rows:
        chars[source] += len(text or "")
        assert got[doc_id]["source"] == source
    slots = defaultdict(set)
    for r in got.values():
        assert r["last_block"] < max(1, -(-chars[r["source"]] // 65_536))
        slots[r["slot"]].add((r["source"], r["source_block"]))
    assert all(len(x) == 1 for x in slots.values())


def test_language_query_on_held_out_documents(spark, duck):
    lang = {r[0]: (r[1], r[3]) for r in documents(duck)}
    got = queries.op5_language_id(spark, DATA).collect()
    held = [r for r in got if r["held_out"] and len(lang[r["doc_id"]][0]) > 30]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]][1] for r in held]) > 0.95 and len(held) > 30
    assert all(r["lang_pred"] in ("de", "en", "es", "fr", "und") and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_query_on_held_out_documents(spark):
    data = DATA.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = [r for r in queries.op3_toxicity(spark, data).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] for r in got if not labels[r["doc_id"]]]) < 0.02
    assert np.mean([r["predicted"] for r in got if labels[r["doc_id"]]]) > 0.5
