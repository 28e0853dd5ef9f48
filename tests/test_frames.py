"""Framed grids and gradient energy against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.functions import grids as A


def framed(x, side):
    h, w = x.shape
    if w >= side or h > side:
        return x
    top, left = (side - h) // 2, (side - w) // 2
    return np.pad(x, ((top, side - h - top), (left, side - w - left)))


@pytest.mark.parametrize("side", [5, 8, 9])
def test_frames_and_gradients(spark, side):
    rng = np.random.default_rng(side)
    grids = [rng.normal(size=s) for s in ((1, 1), (2, 3), (5, 5), (4, 7), (8, 8), (9, 2))]
    df = spark.createDataFrame([(i, *x.shape, x.ravel().tolist()) for i, x in enumerate(grids)], "i int, h int, w int, data array<double>")
    got = df.select("i", A.framed(F.col("data"), F.col("h"), F.col("w"), side).alias("f"), A.gradient_energy(F.col("data"), F.col("w")).alias("e")).collect()
    for r in got:
        x = grids[r["i"]]
        np.testing.assert_allclose(r["f"], framed(x, side).ravel())
        assert r["e"] == pytest.approx((np.diff(x, axis=0) ** 2).sum() + (np.diff(x, axis=1) ** 2).sum())


def test_members_of_an_ensemble_need_no_order(spark, data):
    """Realizations named by their ids: a label's rows don't come together in one task."""
    from gridstat.sources import relations as R

    members = R.members(spark, data)
    assert "Window" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.select("sample_id", "realization").distinct().count() == R.ensemble_fields(spark, data).count()
