"""Uploads that arrive as files over time: the append and the anomaly check as streaming queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablescout.operators.anomaly import severity_z


def append_stream(uploads: DataFrame, keys: Sequence[str], event_time: str, lateness: str = "7 days") -> DataFrame:
    """Each identity once, as long as its copies arrive within ``lateness``; state older than that is dropped."""
    return uploads.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def flag_stream(rows: DataFrame, value: str, bounds: Mapping[str, float], limit: float = 3.0) -> DataFrame:
    """Anomaly score of arriving rows against a stored mean and deviation; needs no state."""
    score = F.try_divide(F.abs(F.col(value) - F.lit(bounds["mean"])), F.lit(bounds["std"]))
    return rows.withColumns({"anomaly_score": score, "severity": F.when(score > limit, severity_z(score))})


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table folder, each row exactly once; processes what is there and stops."""
    return (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start(path))
