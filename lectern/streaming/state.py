"""Streams: latest row of each key, sessions, windowed counts with late data, typed answers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and window of width; rows later than ``late`` behind the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Stretches of a key's events with no pause longer than gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upserted(rows: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The value with the largest version of each key so far (update mode); key, version and value are text, long, text."""

    def merge(k, batches: Iterator, state):
        best = state.get if state.exists else (None, None)
        for pdf in batches:
            for v, x in zip(pdf[version], pdf[value]):
                if best[0] is None or v >= best[0]:
                    best = (int(v), x)
        state.update(best)
        import pandas as pd

        yield pd.DataFrame({key: [k[0]], version: [best[0]], value: [best[1]]})

    schema = f"{key} string, {version} long, {value} string"
    return rows.groupBy(key).applyInPandasWithState(merge, schema, f"{version} long, {value} string", "update", "NoTimeout")
