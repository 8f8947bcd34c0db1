"""The corpus pipeline: language, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact, language, mixing, packing, simhash
from lectern.llm.common import BLANKS, fresh, remainder, saved


def _only(docs: DataFrame, keep: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key (null or not) is among the distinct keys of keep."""
    (name,) = fresh(docs, "wanted")
    return docs.join(keep.select(F.col(key).alias(name)).distinct(), docs[key].eqNullSafe(F.col(name)), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those whose text is null, has no letter or is mostly noise to the tagger go.

    Where no row to learn from has a language and a text, the letters alone decide.
    """
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    return language.accepted(docs, model).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts.

    Where doc_ids repeat, rows are told apart by their text as well, and one of equal rows stays.
    """
    found = saved(exact.exact_duplicates(docs))
    kept = found.where("kept")
    (again,) = fresh(docs, "again")
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return _only(docs, kept)
    is_again = F.col("doc_id").eqNullSafe(F.col(again))
    once = _only(docs.join(repeated, is_again, "left_anti"), kept)
    body = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, ""), 256)
    row = F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    longest = docs.join(repeated, is_again, "left_semi").groupBy(F.col("doc_id").alias("k"), body.alias("sha")).agg(F.max_by(row, row["n"]).alias("best"))
    wanted = kept.select(F.col("doc_id").alias("w"), "text_sha256").distinct()
    chosen = longest.join(wanted, F.col("k").eqNullSafe(F.col("w")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return once.unionByName(chosen.select("best.row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Where doc_ids repeat, rows are told apart by their fingerprints as well; of rows of a group that share its smallest
    doc_id the longest text stays.
    """
    found = saved(simhash.groups(docs))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    fp, again = fresh(docs, "fp", "again")
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return _only(docs, kept)
    is_again = F.col("doc_id").eqNullSafe(F.col(again))
    once = _only(docs.join(repeated, is_again, "left_anti"), kept)
    marked = simhash.fingerprinted(docs.join(repeated, is_again, "left_semi"), fp)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    groups = kept.select(F.col("doc_id").alias("w"), F.col("fp").alias("wfp"), "component").distinct()
    met = marked.select(F.col(f"`{fp}`").alias("mfp"), row).join(groups, (F.col("mfp") == F.col("wfp")) & F.col("row.doc_id").eqNullSafe(F.col("w")))
    first = F.struct(F.length(F.coalesce("row.text", F.lit(""))), F.xxhash64("row.text"))
    return once.unionByName(met.groupBy("component").agg(F.max_by("row", first).alias("row")).select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: tempered weights; where a source runs out the others go on."""
    mixed = mixing.mix(docs)
    slot, chosen = mixed.columns[-4], mixed.columns[-1]
    return mixed.where(F.col(chosen)).repartitionByRange(F.col(slot), F.xxhash64("doc_id")).sortWithinPartitions(slot, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def _in_files(docs: DataFrame) -> DataFrame:
    """doc_id and text with the file of each row and its place there."""
    return docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, whose sequence_ids ascend in the order of the mix.

    That order is the one of the rows in the written files of docs; rows that are not read from files are written first.
    """
    try:
        rows = _in_files(docs)
    except AnalysisException:
        rows = _in_files(saved(docs))
    counts = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}  # a row a file
    files = sorted(counts)
    first = list(zip(files, accumulate([0] + [counts[f] for f in files])))
    starts = spark.createDataFrame(first, "file string, first long")
    placed = rows.join(F.broadcast(starts), "file").select("doc_id", "text", (F.col("first") + F.col("row")).alias("place"))
    return packing.pack(placed, place="place")


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: No SQL expresses a trained language model, SimHash components or packing; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
