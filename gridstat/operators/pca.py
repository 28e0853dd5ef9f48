"""Principal components of vectors: covariance as sums over tasks, directions with a stated sign, projection as an expression.

A task sums products of its rows, so what is shuffled is a matrix of dimensions a task, row
by row, and rows of the matrix are added in as many groups as there are dimensions. The driver
holds one matrix (at most MAX_DIMENSIONS squared) and its directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIMENSIONS = 2_000


@dataclass(frozen=True)
class Components:
    """Mean, directions (a row each, of length one, the entry of largest size positive), variances along them, and the total variance."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros_like(self.variances)


def fit(df: DataFrame, vector: str, k: int | None = None) -> Components:
    """Components by population covariance. Rows without a vector, or with a value that isn't finite, are left out."""
    numbers = F.col(vector).cast("array<double>")
    good = df.select(numbers.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    first = good.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no vectors")
    d = first["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MAX_DIMENSIONS}")
    middle = np.array(good.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(d)])).first()[0]) if d <= 256 else np.zeros(d)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - middle
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:  # row d holds the sums and the number of rows
            rows = [*square.tolist(), [*total.tolist(), float(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["at", "row"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": rows["at"].iloc[:1], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})

    schema = "at int, row array<double>"
    rows = {r["at"]: r["row"] for r in good.mapInArrow(gram, schema).groupBy("at").applyInPandas(added, schema).collect()}
    n, about = rows[d][-1], np.array(rows[d][:-1])
    cov = np.array([rows[i] for i in range(d)]) / n - np.outer(about / n, about / n)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1][: k or d]
    directions = vectors[:, order].T
    sign = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])
    return Components(middle + about / n, directions * sign[:, None], np.maximum(values[order], 0.0), float(np.trace(cov)))


def project(vector: Column, mean: np.ndarray, directions: np.ndarray) -> Column:
    """Coordinates of a vector along directions, about a mean: an array expression, row by row."""
    about = F.zip_with(vector, F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    rows = F.array(*[F.array(*map(F.lit, row)) for row in directions.tolist()])
    return F.transform(rows, lambda u: F.aggregate(F.zip_with(about, u, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def restore(coordinates: Column, mean: np.ndarray, directions: np.ndarray) -> Column:
    """The vector of coordinates: the inverse of project() up to the directions that are left out."""
    columns = F.array(*[F.array(*map(F.lit, c)) for c in directions.T.tolist()])
    dot = lambda u: F.aggregate(F.zip_with(coordinates, u, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(F.transform(columns, dot), F.array(*map(F.lit, mean.tolist())), lambda x, m: x + m)


def spread(scores: Column, low: Column, high: Column) -> Column:
    """Coordinates between 0 and 1 by their ranges, as colours need them; a range of nothing is one half."""
    return F.when(high > low, (scores - low) / (high - low)).otherwise(F.lit(0.5))
