"""Streams of lines: stretches of equal values in each source, with a side output for values that come back."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GROUP, BACK, LATE = "group", "back", "late"
SCHEMA = "source string, kind string, value string, first long, last long, n long"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a stateful stream starts: the state store that keeps several states of a key."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Stretches(StatefulProcessor):
    """Of one source: the stretch that is open, the last line, and which values had a stretch before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "value string, first long, n long, last long")
        self.had = handle.getMapState("had", "value string", "line long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        out = []
        value, first, n, last = self.now.get() or (None, None, 0, None)
        lines = sorted(((int(line), x) for pdf in rows for line, x in zip(pdf["line"], pdf["value"])), key=lambda pair: (pair[0], str(pair[1])))
        for line, x in lines:
            if last is not None and line <= last:
                out.append((LATE, x, line, line, 1))
                continue
            if x != value and value is not None:
                out.append((GROUP, value, first, last, n))
                value = None
            last = line
            if x is None or x != x:
                continue
            if value is None:
                if self.had.containsKey((x,)):
                    out.append((BACK, x, line, line, 1))
                else:
                    self.had.updateValue((x,), (line,))
                value, first, n = x, line, 0
            n += 1
        self.now.update((value, first, n, last))
        if out:
            kinds, values, firsts, lasts, counts = zip(*out)
            yield pd.DataFrame({"source": [key[0]] * len(out), "kind": kinds, "value": values, "first": firsts, "last": lasts, "n": counts})

    def close(self) -> None:
        pass


def stretches(lines: DataFrame, source: str, line: str, value: str) -> DataFrame:
    """A stream of SCHEMA from a stream of lines: a group when a stretch of equal values in a source ends.

    A stretch ends where another value follows, or a line with a null value (the end of a source).  A
    value that had a stretch in the source before gives a row ``back`` and a stretch of its own; a line that
    comes after a later one of its source gives a row ``late`` and is in no group.  Lines of a source are put in order inside a batch.
    State is one open stretch and the distinct values of each source; null sources are one source.
    """
    given = lines.select(F.col(source).cast("string").alias("source"), F.col(line).cast("long").alias("line"), F.col(value).cast("string").alias("value"))
    return given.groupBy("source").transformWithStateInPandas(_Stretches(), SCHEMA, "Append", "None")


def written(stream: DataFrame, path: str, checkpoint: str, **trigger) -> None:
    """Run a stream of SCHEMA to its end: groups and, beside them, what is wrong, in folders below path.

    Each batch overwrites its own folder, so one that is run again after a failure leaves its rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("problem", F.col("kind") != GROUP).write.mode("overwrite").partitionBy("problem").parquet(f"{path}/batch={number}")

    with keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def read_written(spark: SparkSession, path: str, problems: bool = False) -> DataFrame:
    """The groups that written() has left, or the side output."""
    return spark.read.schema(SCHEMA + ", batch long, problem boolean").parquet(path).where(F.col("problem") == problems).drop("batch", "problem")
