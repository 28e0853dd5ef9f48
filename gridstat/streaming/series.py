"""Rolling statistics of event streams, and running states of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Event times as instants: a time without a zone is one of the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and deviation of each type in event-time windows; later rows than `late` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "std")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: rows closer than a gap."""
    s = F.session_window("ts", gap)
    out = _timed(events).withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n", "total")


def smoothed(events: DataFrame, alpha: float = 0.9) -> DataFrame:
    """Exponentially smoothed value and running minimum of each user: a state of three numbers a user."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, low, n = state.get if state.exists else (None, float("inf"), 0)
        for pdf in batches:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                x = v if x is None else alpha * x + (1 - alpha) * v
                low, n = min(low, v), n + 1
        state.update((float(x), float(low), n))
        yield pd.DataFrame({"user_id": [key[0]], "smoothed": [x], "lowest": [low], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, smoothed double, lowest double, n long", "x double, low double, n long", "update", GroupStateTimeout.NoTimeout
    )
