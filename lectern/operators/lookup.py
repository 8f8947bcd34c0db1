"""Tables bucketed by key: point lookups read one bucket, joins with each other need no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    """A table written in buckets of a key, sorted by it in each."""

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.rows, self.key = spark.table(name), key

    @classmethod
    def write(cls, df: DataFrame, name: str, path: str, key: str, buckets: int) -> BucketedTable:
        """Write df below path and enter it in the catalog under name.  Rows are dealt by the buckets' own hash first, so that a bucket is one file."""
        dealt = df.repartition(buckets, F.col(key))
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
        return cls(df.sparkSession, name, key)

    def get(self, keys: Iterable) -> DataFrame:
        """The rows of some keys known to the caller: only their buckets are scanned.  A null key has no rows."""
        return self.rows.where(F.col(self.key).isin([k for k in dict.fromkeys(keys) if k is not None]))

    def with_columns_of(self, other: BucketedTable, how: str = "inner") -> DataFrame:
        """A join on the key with a table of as many buckets: bucket meets bucket, nothing is shuffled."""
        return self.rows.join(other.rows.withColumnRenamed(other.key, self.key), self.key, how)
