"""Operator 8: exact duplicates by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import saved

_DELETE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _DELETE)


def _better(a: tuple, b: tuple) -> tuple:
    """(code points, doc_id): more code points, then the smaller doc_id; null ids last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _folded(rows: DataFrame, head: int, most_bytes: int) -> DataFrame:
    """(head, sha, body, n, best_len, best_id): the equal texts of a task as one row, in stretches of most_bytes of distinct ones.

    The texts themselves are the keys, so equal ones are told by all of their bytes.
    """
    import pyarrow as pa

    def out(found: dict):
        import hashlib

        part, size = [], 0
        for body, (n, (length, doc_id)) in found.items():
            part.append((body[:head], hashlib.sha256(body).digest(), body, n, length, doc_id))
            size += len(body)
            if size > 8_000_000:
                yield batch_of(part)
                part, size = [], 0
        if part:
            yield batch_of(part)

    def batch_of(part: list) -> pa.RecordBatch:
        cols = list(zip(*part))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["head", "sha", "body", "n", "best_len", "best_id"])

    def run(batches):
        found: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                body, mine = _normal(text), (len(text or ""), doc_id)
                seen = found.get(body)
                if seen is None:
                    found[body] = [1, mine]
                    held += len(body) + 200
                else:
                    seen[0] += 1
                    seen[1] = _better(seen[1], mine)
                if held > most_bytes:
                    yield from out(found)
                    found, held = {}, 0
        yield from out(found)

    return rows.mapInArrow(run, "head binary, sha binary, body binary, n long, best_len long, best_id long")


def _compared(dealt: DataFrame, whole: bool = False) -> DataFrame:
    """Runs of equal neighbours in the sorted partitions of dealt: (sha, keep_id, keep_len, group_size), and the body if whole."""
    import pyarrow as pa

    kinds = [("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_len", pa.int64()), ("group_size", pa.int64()), *([("body", pa.binary())] if whole else [])]

    def run(batches):
        out, size = [], 0
        body = sha = best = None
        n = 0

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, kinds)], names=[name for name, _ in kinds])

        def closed():
            return (sha, best[1], best[0], n, *([body.to_pybytes()] if whole else []))

        for batch in batches:
            for b, s, k, length, doc_id in zip(*(batch.column(i) for i in range(5))):
                mine, now = (length.as_py(), doc_id.as_py()), b.as_buffer()
                if body is not None and body.equals(now):
                    n, best = n + k.as_py(), _better(best, mine)
                    continue
                if body is not None:
                    out.append(closed())
                    size += body.size if whole else 0
                body, sha, n, best = now, s.as_py(), k.as_py(), mine
            if out and (len(out) >= 10_000 or size > 8_000_000):
                yield flush()
                size = 0
        if body is not None:
            out.append(closed())
            yield flush()

    schema = "sha binary, keep_id long, keep_len long, group_size long" + (", body binary" if whole else "")
    return dealt.sortWithinPartitions("body").select("body", "sha", "n", "best_len", "best_id").mapInArrow(run, schema)


def exact_duplicates(docs: DataFrame, head: int = 64, partitions: int | None = None, fold_bytes: int = 64 << 20, key_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after the ASCII blanks are deleted; null counts as empty, so null,
    empty and blank texts form one group.  Of equal texts the one with the most code points before
    that, then the smallest doc_id, stays; of rows that tie in both, which this result can't tell apart, one
    is kept.  Null doc_ids come last.
    An empty table gives an empty result; other columns are ignored.

    Each scan task first folds its own equal texts together (in stretches of fold_bytes of distinct ones), so a group of
    copies sends few rows.  What is left is range-partitioned on sampled splitters, sorted externally by
    all of its bytes, and whole neighbouring texts are compared; only that decides.  Splitters hold the first ``head``
    bytes, so that samples stay small, and the digest, so that texts with a common beginning spread too.

    Documents find their group by key_bytes of the digest.  Where different texts share them, the
    documents of those keys meet their groups by the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = [F.col("head"), F.col("sha")]
    folded = _folded(rows, head, fold_bytes)
    dealt = folded.repartitionByRange(partitions, *by) if partitions else folded.repartitionByRange(*by)
    key = F.substring("sha", 1, key_bytes)
    groups = saved(_compared(dealt)).withColumn("key", key)
    members = _members(rows).withColumn("key", key)
    shared = groups.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared")
    if shared.isEmpty():
        return _with_groups(members, groups, "key")
    shared = saved(shared)
    clash = F.col("key") == F.col("shared")
    plain = _with_groups(members.join(shared, clash, "left_anti"), groups.join(shared, clash, "left_anti"), "key")
    again = _folded(rows, head, fold_bytes).withColumn("key", key).join(shared, clash, "left_semi").repartitionByRange(*by)
    whole = _with_groups(_members(rows, whole=True).withColumn("key", key).join(shared, clash, "left_semi"), _compared(again, whole=True), "body")
    return plain.unionByName(whole)


def _members(rows: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, sha, len), and the body if whole."""
    import pyarrow as pa

    def run(batches):
        import hashlib

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                texts = piece.column(1).to_pylist()
                bodies = [_normal(t) for t in texts]
                out = [piece.column(0), pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()), pa.array([len(t or "") for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(bodies, pa.binary())] if whole else [])], names=["doc_id", "sha", "len", *(["body"] if whole else [])])

    return rows.mapInArrow(run, "doc_id long, sha binary, len long" + (", body binary" if whole else ""))


def _with_groups(members: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """Only groups of copies are joined; a text of its own stays as it is.  Rows alike in all travel as one."""
    members = members.groupBy("doc_id", on, "sha", "len").agg(F.count("*").alias("alike"))
    several = groups.where("group_size > 1").select(F.col(on).alias("of"), "keep_id", "keep_len", "group_size")
    met = members.join(several, F.col(on) == F.col("of"), "left")
    alone = F.col("of").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int")))).select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        ((F.col("turn") == 1) & (alone | (F.col("doc_id").eqNullSafe(keep) & (F.col("len") == F.col("keep_len"))))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
