"""Joint diverse selection against a whole matrix of distances."""

import numpy as np
import pytest

from gridstat.operators import selection as L


def plain(p, f, k, first, alpha):
    low, high, std = p.min(0), p.max(0), f.std(0)
    p = (p - low) / np.where(high > low, high - low, 1)
    f = (f - f.mean(0)) / np.where(std > 0, std, 1)
    d = alpha * np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + (1 - alpha) * np.sqrt(((f[:, None] - f[None]) ** 2).sum(2))
    chosen, out = [first], [0.0]
    while len(chosen) < min(k, len(p)):
        near = d[:, chosen].min(1)
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        out.append(near.max())
    return chosen, out


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_agrees_with_all_distances(spark, alpha):
    rng = np.random.default_rng(4)
    p, f = rng.normal(size=(60, 3)), rng.normal(size=(60, 4))
    p[:, 1], f[:, 2] = 2.5, 1.0
    p[7], f[7] = p[8], f[8]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, f, strict=True))], "id long, p array<double>, f array<double>").repartition(4)
    got = L.diverse(df, 7, 3, "id", "p", "f", alpha).orderBy("step").collect()
    chosen, near = plain(p, f, 7, 3, alpha)
    assert [r["id"] for r in got] == chosen
    np.testing.assert_allclose([r["distance"] for r in got], near, rtol=1e-9)


def test_fewer_rows_than_wanted_and_none(spark):
    df = spark.createDataFrame([(1, [0.0], [0.0]), (2, [1.0], [5.0]), (3, [0.0], [0.0])], "id long, p array<double>, f array<double>")
    assert [r["id"] for r in L.diverse(df, 9, 1, "id", "p", "f").collect()] == [1, 2, 3]
    assert L.diverse(df.limit(0), 3, 1, "id", "p", "f").count() == 0
