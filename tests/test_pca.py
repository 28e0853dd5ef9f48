"""Principal components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import pca as P


@pytest.mark.parametrize("d", [3, 300])
def test_components_and_projection(spark, d):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, d)) * np.linspace(3, 0.1, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [float("nan")] * d)], "id long, v array<double>").repartition(5)
    k = 3
    c = P.fit(df, "v", k)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    np.testing.assert_allclose(c.mean, x.mean(0), rtol=1e-9)
    np.testing.assert_allclose(c.variances, values[::-1][:k], rtol=1e-6)
    assert c.total == pytest.approx(np.trace(cov)) and c.shares.sum() <= 1 + 1e-9
    for i in range(k):
        u = vectors[:, -1 - i]
        u = u * np.sign(u[np.abs(u).argmax()])
        np.testing.assert_allclose(c.directions[i], u, atol=1e-6)
    got = {r["id"]: r["p"] for r in df.where("id >= 0").select("id", P.project(F.col("v"), c.mean, c.directions).alias("p")).collect()}
    np.testing.assert_allclose([got[i] for i in range(200)], (x - x.mean(0)) @ c.directions.T, atol=1e-6)
    if d == 3:
        back = df.where("id >= 0").select("id", P.restore(P.project(F.col("v"), c.mean, c.directions), c.mean, c.directions).alias("v")).orderBy("id").collect()
        np.testing.assert_allclose([r["v"] for r in back], x, atol=1e-8)


def test_bounds_and_constant_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>")
    c = P.fit(df, "v")
    assert c.total == pytest.approx(0, abs=1e-12) and c.shares.tolist() == [0, 0] or c.total < 1e-12
    with pytest.raises(ValueError):
        P.fit(df.limit(0), "v")
    with pytest.raises(ValueError):
        P.fit(spark.createDataFrame([([0.0] * 2001,)], "v array<double>"), "v")
