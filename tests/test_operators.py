"""Operators on inputs whose results are known without any reference."""

import math

import numpy as np
import plain_recurrence as W
import pytest
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import descriptive as D
from gridstat.operators import extractors as E
from gridstat.operators import grid as G
from gridstat.operators import matrix as M
from gridstat.operators import params as P
from gridstat.operators import recurrence as C
from gridstat.operators import selection as L
from gridstat.operators import sequence as Q


def series(spark, ys, key=0):
    return spark.createDataFrame([(key, t, float(y)) for t, y in enumerate(ys)], "sample_id long, t long, y double")


def test_exponential_growth_and_linear_trend(spark):
    e = Q.trends(series(spark, [2 * math.exp(0.3 * t) for t in range(30)]), ["sample_id"]).first()
    assert e["growth_rate"] == pytest.approx(0.3)
    lin = Q.trends(series(spark, [1 + 2 * t for t in range(30)]), ["sample_id"]).first()
    assert lin["trend_strength"] == pytest.approx(1) and lin["detrended_variance"] == pytest.approx(0, abs=1e-9)
    d = Q.differences(series(spark, [1 + 2 * t for t in range(30)]), ["sample_id"]).first()
    assert d["growth_acceleration"] == pytest.approx(0, abs=1e-12) and d["regime_switches"] == 0


def test_single_row_series_gives_nulls(spark):
    one = series(spark, [3.0])
    assert Q.trends(one, ["sample_id"]).first()["growth_rate"] is None
    assert Q.differences(one, ["sample_id"]).first()["growth_acceleration"] is None
    assert Q.rolling(one, ["sample_id"], 0.1).count() == 0
    assert Q.permutation_entropy(one, ["sample_id"]).count() == 0


def test_sine_has_its_frequency():
    f, period = C.dominant_frequency(np.sin(2 * np.pi * 5 * np.arange(100) / 100))
    assert f == pytest.approx(0.05) and period == pytest.approx(20)


def test_constant_sequence_recurs_everywhere():
    rate, determinism, laminarity, entropy = W.recurrence(np.ones(20))
    assert rate == laminarity == 1.0 and determinism > 0.9 and entropy > 0
    assert math.isnan(W.correlation_dimension(np.ones(20)))


def plain_nonlinear(y):
    """The same measures with the whole matrix in memory."""
    p = np.stack([y[:-1], y[1:]], axis=1)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    r = d <= 0.1 * d.max()
    runs = lambda line: (lambda e: e[1::2] - e[::2])(np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]]))))
    diagonals = np.concatenate([runs(np.diagonal(r, k)) for k in range(1 - len(r), len(r))])
    columns = np.concatenate([runs(c) for c in r.T])
    long = diagonals[diagonals >= 2]
    q = np.histogram(long, bins=20)[0] / len(long)
    q = q[q > 0]
    pair = d[np.triu_indices(len(p), 1)]
    radii = np.geomspace(np.percentile(pair, 1), np.percentile(pair, 99), 10)
    c = np.array([(pair < x).mean() for x in radii])
    slope = np.polyfit(np.log(radii[c > 0]), np.log(c[c > 0]), 1)[0]
    return r.mean(), long.sum() / r.sum(), columns[columns >= 2].sum() / r.sum(), -(q * np.log(q)).sum(), slope


@pytest.mark.parametrize(("n", "cells"), [(60, 150), (60, 10), (300, 2_000), (2_300, W.BLOCK_CELLS)])
def test_nonlinear_measures_use_every_point(n, cells):
    y = np.random.default_rng(n).normal(size=n).round(3) + np.sin(np.arange(n) / 5)
    got = (*W.recurrence(y, cells=cells), W.correlation_dimension(y, cells=cells))
    assert got == pytest.approx(plain_nonlinear(y), rel=1e-9)


def test_ranks_of_tied_distances():
    p = np.array([[0.0], [1], [1], [2], [3], [3], [3]])
    want = np.sort(np.abs(p - p.T)[np.triu_indices(7, 1)])
    assert [W._ranked(p, k, 2) for k in range(21)] == list(want)


def test_monotone_sequence_has_one_pattern(spark):
    assert Q.permutation_entropy(series(spark, range(20)), ["sample_id"]).first()[1] == pytest.approx(0)


def test_policies(spark):
    s = series(spark, [1, 2, 3, 4])
    state = lambda **k: Q.blend(s, ["sample_id"], **k).first()["state"]
    assert state(policy="autoregressive") == 4
    assert state(policy="residual", dt=0.5) == 1 + 0.5 * 9
    assert state(policy="residual", dt=0.0) == 1
    assert state(policy="convex", alpha=0.5) == pytest.approx(((1 * 0.5 + 2 * 0.5) * 0.5 + 3 * 0.5) * 0.5 + 4 * 0.5)
    with pytest.raises(ValueError):
        Q.blend(s, ["sample_id"], "other")


@pytest.mark.parametrize("n", [2, 3, 10, 47, 1500])
def test_windows_and_lags_of_a_sequence(spark, n):
    y = np.random.default_rng(n).normal(size=n) + 100
    s, w = series(spark, y), max(2, int(n * 0.1))
    parts = np.lib.stride_tricks.sliding_window_view(y, w)
    want = [parts.mean(axis=1).mean(), parts.std(axis=1, ddof=1).mean(), parts.max(axis=1).mean(), parts.min(axis=1).mean()]
    got = Q.rolling(s, ["sample_id"], 0.1).first()
    assert [got[c] for c in ("mean", "std", "max", "min")] == pytest.approx(want, rel=1e-9)
    z = y - y.mean()
    acf = {r["lag"]: r["acf"] for r in Q.autocorrelation(s, ["sample_id"], 5).collect()}
    assert acf == pytest.approx({k: (z[k:] * z[: n - k]).sum() / ((z * z).sum() + 1e-8) for k in range(min(5, n - 1) + 1)})
    state = y[0]
    for v in y[1:]:
        state = 0.3 * state + 0.7 * v
    assert Q.blend(s, ["sample_id"], "convex", alpha=0.3).first()["state"] == pytest.approx(state)
    assert Q.blend(s, ["sample_id"], "convex", alpha=0.0).first()["state"] == pytest.approx(y[-1])


def test_early_stopping_waits_for_patience(spark):
    assert Q.early_stopping(series(spark, [5, 4, 4, 4, 4, 3]), ["sample_id"], 3).first()["stop_at"] == 4
    assert Q.early_stopping(series(spark, [5, 4, 3]), ["sample_id"], 3).first()["stop_at"] is None


def test_decode_rounds_half_to_even_and_goes_right_at_edges(spark):
    u = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "u double")
    ints = [r[0] for r in u.select(P.decode(F.col("u"), {"kind": "integer", "lo": 0, "hi": 2})).collect()]
    assert ints == [0, 0, 1, 2, 2]
    spec = {"kind": "choice", "choices": ["a", "b"], "weights": [0.75, 0.25]}
    assert [r[0] for r in u.select(P.decode(F.col("u"), spec)).collect()] == ["a", "a", "a", "b", "b"]
    logs = [r[0] for r in u.select(P.decode(F.col("u"), {"kind": "continuous", "lo": 1, "hi": 100, "log": True})).collect()]
    assert logs[2] == pytest.approx(10)


@pytest.mark.parametrize(("weights", "good"), [([0.5], False), ([-0.5, 1.5], False), ([0.5, 0.4], False), ([0.5, 0.5 + 1e-7], True)])
def test_weights_are_checked(weights, good):
    if good:
        P.validate_weights(weights, ["a", "b"])
    else:
        with pytest.raises(ValueError):
            P.validate_weights(weights, ["a", "b"])


def test_weighted_shares(spark):
    u = spark.range(10_000).select((F.col("id") / 10_000).alias("u"))
    n = {r[0]: r[1] for r in u.groupBy(P.decode(F.col("u"), {"kind": "choice", "choices": ["x", "y", "z"], "weights": [0.5, 0.3, 0.2]})).count().collect()}
    assert abs(n["x"] - 5000) <= 5 and abs(n["y"] - 3000) <= 5 and abs(n["z"] - 2000) <= 5


def test_sobol_fills_every_cell_of_each_projection(spark):
    pts = P.sobol(spark, 256, 6).toPandas()
    for c in pts.columns[1:]:
        assert sorted((pts[c] * 256).astype(int)) == list(range(256))
    pair = set(zip((pts["u0"] * 16).astype(int), (pts["u1"] * 16).astype(int), strict=True))
    assert len(pair) == 256


def test_codebook_of_the_data_itself(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "code long, vec array<double>")
    t = M.assign_codes(v.withColumnRenamed("code", "id"), v)
    assert {(r["id"], r["code"], r["distance"]) for r in t.collect()} == {(i, i, 0.0) for i in range(5)}
    m = M.usage_metrics(M.code_usage(t, v)).first()
    assert m["utilization"] == 1 and m["perplexity"] == pytest.approx(5)


def test_ties_go_to_the_lowest_code(spark):
    book = spark.createDataFrame([(3, [1.0]), (1, [-1.0])], "code long, vec array<double>")
    assert M.assign_codes(spark.createDataFrame([([0.0],)], "vec array<double>"), book).first()["code"] == 1


def test_gini(spark):
    g = lambda xs: M.gini(spark.createDataFrame([(float(x),) for x in xs], "v double"), "v").first()["gini"]
    assert g([2, 2, 2, 2]) == pytest.approx(0) and g([0, 0, 0, 5]) == pytest.approx(0.75) and g([0, 0]) == 0


def test_cleaning_finds_constants_copies_and_gaps(spark):
    rows = [(i, f, v) for i in range(40) for f, v in (("a", float(i)), ("twice", 2.0 * i), ("one", 1.0), ("gap", float("nan") if i % 4 else float(i * i % 7)))]
    df = spark.createDataFrame(rows, "sample_id long, feature string, value double")
    assert {r["feature"] for r in M.variance_mask(df).where("keep").collect()} == {"a", "twice", "gap"}
    filled = M.fill_missing(df)
    assert filled.where(F.isnan("value") | F.col("value").isNull()).count() == 0
    kept = M.greedy_dedup(filled.where("feature <> 'one'"), 0.99)
    assert len({"a", "twice"} & set(kept)) == 1 and "gap" in kept
    for strategy in ("percentile", "iqr", "mad"):
        assert M.cap(filled, strategy).count() == 160
    with pytest.raises(ValueError):
        M.cap(filled, "other")


def test_ward_separates_two_blocks():
    d = np.ones((6, 6))
    d[:3, :3] = d[3:, 3:] = 0.1
    np.fill_diagonal(d, 0)
    assert list(M.ward(d, 2)) == [0, 0, 0, 1, 1, 1]
    assert M.silhouette(d, M.ward(d, 2)) > 0.8


def test_lower_median_and_bins(spark):
    df = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 10)], "k int, v double")
    assert df.groupBy("k").agg(S.lower_median("v").alias("m")).first()["m"] == 2
    h = D.histogram(df, ["k"], bins=2).first()
    assert h["peak"] == 0.75
    flat = spark.createDataFrame([(0, 5.0)] * 3, "k int, v double")
    assert D.histogram(flat, ["k"]).first()["entropy"] == pytest.approx(0)


def test_unknown_reduction_is_an_error(spark):
    with pytest.raises(ValueError):
        D.reduce_over(series(spark, [1]), ["sample_id"], "y", ["median-ish"])


def test_families_register_once_and_are_found():
    assert "spectral" in E.FAMILIES
    with pytest.raises(ValueError):
        E.register_family("spectral", G.SPECTRAL)
    with pytest.raises(KeyError):
        E.get_family("other")


def test_farthest_points_spread(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 10, 4))], "sample_id long, vec array<double>")
    assert [r["sample_id"] for r in L.farthest_points(v, 3, 0).orderBy("step").collect()] == [0, 2, 3]


def test_registry_numbers_follow_first_sight(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "name string, at int")
    assert {(r["name"], r["idx"]) for r in L.register(df, "name", "at").collect()} == {("b", 0), ("a", 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "sample_id long, t long, y double")
    assert Q.trends(none, ["sample_id"]).count() == 0 and Q.events(none, ["sample_id"]).count() == 0
    grids = spark.createDataFrame([], "sample_id long, h int, w int, data array<double>")
    assert G.measure(grids, ["sample_id"], G.SPECTRAL).count() == 0
