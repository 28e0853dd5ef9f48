"""Nonlinear measures of sequences: recurrence, correlation dimension, dominant frequency.

The first two are quadratic in a sequence and are computed tile by tile (`operators.tiles`).
The frequency needs a transform of the whole sequence, which one task holds: eight bytes a point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.operators import tiles as T
from gridstat.sources.steps import Steps


def dominant_frequency(y: np.ndarray) -> tuple[float, float]:
    """Frequency of the largest power without the mean, in cycles a step, and its period."""
    if len(y) < 2:
        return float("nan"), float("nan")
    p = np.abs(np.fft.rfft(y)) ** 2
    p[0] = 0
    f = float(p.argmax() / len(y))
    return f, 1 / (f + 1e-8)


COLUMNS = ["recurrence_rate", "determinism", "laminarity", "diagonal_entropy", "correlation_dimension", "dominant_frequency", "period"]


def frequencies(series: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, dominant_frequency, period) of each sequence (key, t, y)."""
    packed = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s")).select(F.col(key).cast("long").alias(key), F.transform("s", lambda e: e["y"]).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dominant_frequency(np.array(y, dtype=float)) for y in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*rows, strict=True))], names=[key, *COLUMNS[-2:]])

    return packed.mapInArrow(run, f"{key} long, dominant_frequency double, period double")


def nonlinear(series: DataFrame, key: str = "sample_id", block: int = T.BLOCK) -> DataFrame:
    """Recurrence metrics, correlation dimension and dominant frequency of each sequence (key, t, y), t dense from 0."""
    # Rows in order are made once; both measures of pairs and the frequencies read them.
    series = Steps(series.sparkSession).write(0, series.select(key, "t", "y"))
    out = T.recurrences(series, key, block=block).join(T.correlation_dimensions(series, key, block=block), key).join(frequencies(series, key), key)
    return out.select(F.col(key).cast("long").alias(key), *COLUMNS)
