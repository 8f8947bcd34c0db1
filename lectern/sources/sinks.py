"""Writers: partitioned and bucketed tables, JSON exports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import digests


def partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by key folders; rows of a folder meet in few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def numbered_buckets(df: DataFrame, path: str, number: str, width: int = 100) -> None:
    """Parquet in folders of width numbers each."""
    partitioned(df.withColumn("bucket", F.floor(F.col(number) / width)), path, "bucket")


def sorted_files(df: DataFrame, path: str, order: str, most_rows: int) -> None:
    """Parquet in the order, at most most_rows a file."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", most_rows).parquet(path)


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, sha256): one digest over the names and digests of all files, in name order."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    listed = F.array_sort(F.collect_list(F.struct(name.alias("n"), F.col("sha256").alias("s"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["n"], F.lit(" "), x["s"])), "\n")
    return digests(spark, path).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(text, 256).alias("sha256"))
