"""Readers of files that Spark has no built-in source for, and file hashes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): text lines without byte-order mark and carriage return."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\uFEFF|\\r$", "").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tab_separated(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=header, mode="FAILFAST")


def xml_entries(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_stats(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(folder, files, bytes) of each folder below a path that holds files whose names end so; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").endswith(suffix))
    return listed.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content): the members of zip archives, one archive a row of the scan."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if z.testzip():
                        raise ValueError(f"{archive}: a member's checksum is wrong")
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [archive], "name": [info.filename], "content": [z.read(info)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def records(df: DataFrame, line: str, order: str, file: str, marker: str) -> DataFrame:
    """df with record: which of the marker lines of its file, from 1, a line follows (0: none yet)."""
    from pyspark.sql import Window

    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("record", F.sum(F.col(line).startswith(marker).cast("int")).over(w))
