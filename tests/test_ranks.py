"""Quantiles by narrowed ranges against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import ranks as K


def groups():
    rng = np.random.default_rng(5)
    out = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "skewed": np.exp(rng.normal(size=1500) * 4), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
        "constant": np.full(500, 3.25), "tiny": 1 + rng.integers(0, 50, 900) * 2.0**-52, "infinite": np.concatenate([rng.normal(size=400), [np.inf] * 3, [-np.inf] * 2]), None: rng.random(300),
    }
    return out


SHARES = [0.0, 0.005, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize(("small", "parts"), [(100_000, 1024), (60, 128)])
def test_quantiles(spark, small, parts):
    every = groups()
    df = spark.createDataFrame([(k, float(x)) for k, xs in every.items() for x in xs] + [("normal", None), ("none", None)], "k string, v double").repartition(7)
    got = {r["k"]: r["q"] for r in K.quantiles(df, ["k"], "v", SHARES, small, parts).collect()}
    assert set(got) == {*every, "none"} and not got["none"]
    for k, xs in every.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(xs, SHARES)
        finite = np.isfinite(want)
        np.testing.assert_allclose(np.array(got[k])[finite], want[finite], rtol=1e-12, err_msg=str(k))
    low = {r["k"]: r["q"] for r in K.lower_medians(df, ["k"], "v", small, parts).collect()}
    assert all(low[k] == [np.sort(xs)[(len(xs) - 1) // 2]] for k, xs in every.items())


@pytest.mark.parametrize("small", [100_000, 10])
def test_without_keys_and_without_rows(spark, small):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert K.quantiles(df, [], "v", [0.1, 0.5], small).first()["q"] == [100.0, 500.0]
    assert K.lower_medians(df.where("v < 1000"), [], "v", small).first()["q"] == [499.0]
    assert K.quantiles(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v", [0.5], small).count() == 0


def test_nan_ranks_with_infinity(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, float("nan"), float("nan")]], "v double")
    for small in (2, 100):
        assert K.quantiles(df, [], "v", [0.5, 1.0], small).first()["q"] == [3.0, float("inf")]


def test_quantiles_of_large_keys_are_a_table(spark):
    """Their size is known, so a join with few of them leaves the values where they are."""
    df = spark.range(300).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS v")
    q = K.quantiles(df, ["k"], "v", [0.5], small=50)
    assert "Scan parquet" in q._jdf.queryExecution().executedPlan().toString() and "Join" not in q._jdf.queryExecution().executedPlan().toString()
    joined = df.join(q, "k")
    joined.count()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["q"][0]) for r in q.collect()) == [(0, 148.5), (1, 149.5), (2, 150.5)]
