"""Event streams: windows with watermarks, deduplication, custom state. Extras beside the batch operators; each has a batch twin to check it by."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, keys, n_events, total: with ``late`` (a stream), rows later than that behind the newest are left out."""
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n_events", "total")


def sliding(events: DataFrame, ts: str, keys: list[str], width: str, step: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), *keys, "n_events")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, session_start, session_end, n_events: events of a key less than the gap apart."""
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, key: str, value: str, key_type: str = "long") -> DataFrame:
    """key, n_events, total after each batch, kept in state of constant size per key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for df in batches:
            n += len(df)
            total += float(df[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n_events": [n], "total": [round(total, 4)]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, n_events long, total double", "n long, total double", "update", "NoTimeout")
