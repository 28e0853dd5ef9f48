"""Measures of all pairs, dealt over tiles: against plain numpy, and no join that makes a row a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import descriptive as D
from gridstat.operators import matrix as M
from gridstat.operators import pairs as W
from gridstat.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(n, dims, seed=1):
    x = np.random.default_rng(seed).random((n, dims))
    x[n // 2 : n // 2 + 5] = x[0]  # copies
    return x


def test_pairwise_distances_are_dealt_over_tiles(spark):
    x = rows(90, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out = M.pairwise_distances(df, "id", "v")
    assert "MapInArrow" in plan(out) and "Cartesian" not in plan(out)
    got = {(r["i"], r["j"]): r["distance"] for r in out.collect()}
    assert set(got) == {(i, j) for i in range(90) for j in range(i + 1, 90)}
    assert all(got[i, j] == pytest.approx(np.linalg.norm(x[i] - x[j]), abs=1e-12) for i, j in got)


def shuffled(spark, df):
    """(rows, bytes) that the stages of one run hand on."""
    store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        found = [stages.apply(k) for k in range(stages.size())]
        return np.array([(x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in found]).reshape(-1, 2).sum(axis=0)

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_distances_hand_on_each_vector_once_a_band(spark):
    """Eight bands, as floats where they are floats; a table of one dimension and many rows has no more of them."""
    x = np.random.default_rng(5).random((300, 512)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    _, size = shuffled(spark, M.pairwise_distances(df.localCheckpoint(), "id", "v"))
    assert size < 9 * x.nbytes

    def counts(a, b):
        yield [[len(a.id)], [len(b.id)], [int((np.searchsorted(b.id, a.id, "right") - len(b.id)).sum())]]

    for n, held, bands in ((30_000, W.HELD, 8), (30_000, 2_500, 12)):
        one = spark.range(n).select("id", F.array(F.col("id").cast("float")).alias("v"))
        got = W.of_bands(one, "id", "v", "a long, b long, pairs long", counts, held=held).collect()
        assert len(got) == bands**2  # in either order, one with itself once
        assert sum(r["a"] for r in got) == bands * n and -sum(r["pairs"] for r in got) == n * (n - 1) // 2


def test_distances_of_odd_rows_are_those_of_the_sql(spark, duck, monkeypatch):
    """Equal ids are no pair, nor is a null id one; a null vector has null distances. Tiles that share a task and spread over batches."""
    monkeypatch.setattr(W, "PARTS", 3)
    x = rows(70, 3).astype(np.float32)
    given = [(i % 50 - 9, v.tolist() if i % 11 else None) for i, v in enumerate(x)] + [(None, x[0].tolist()), (None, None), (2**62, x[1].tolist())]
    values = ", ".join(f"({'NULL' if i is None else i}::BIGINT, {'NULL' if v is None else v}::FLOAT[])" for i, v in given)
    text = catalogue.oracle_sql()["pairwise_distances"].replace("FROM embeddings", f"FROM (VALUES {values}) t(vec_id, embedding)")
    want = sorted(duck.execute(text).fetchall(), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = M.pairwise_distances(spark.createDataFrame(given, "id long, v array<float>"), "id", "v", digits=6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == want and any(d is None for _, _, d in want)


def test_distances_of_vectors_without_a_distance(spark):
    found = M.pairwise_distances(spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v", digits=6)
    assert np.isnan(found.first()["distance"])
    assert M.pairwise_distances(spark.createDataFrame([(1, None), (2, None)], "id long, v array<double>"), "id", "v").collect() == [(1, 2, None)]
    assert M.pairwise_distances(spark.createDataFrame([], "id long, v array<double>"), "id", "v").collect() == []
    with pytest.raises(Exception, match="different lengths"):
        M.pairwise_distances(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v").collect()


def test_rounding_is_that_of_the_sql(duck):
    g = np.random.default_rng(2)
    x = np.concatenate([g.random(5_000) * 3, (g.integers(0, 10**7, 5_000) + 0.5) / 1e6, [0.0, 0.49999999999999994e-6, 1e300, 1e308, 4503599627.370497, np.inf, np.nan]])
    want = np.array([r[0] for r in duck.execute(f"SELECT round(x, 6) FROM (SELECT unnest({[float(v) for v in x[:-2]]}::DOUBLE[]) AS x)").fetchall()] + [np.inf, np.nan])
    assert np.array_equal(M._half_up(x, 6), want, equal_nan=True)


def test_pairs_of_a_block_in_many_strips():
    n = W.STRIP * 2 + 3
    seen = np.zeros((n, n + 40), int)
    for same in (False, True):
        seen[:] = 0
        m = n if same else n + 40
        for r, c, diagonal in W.strips(n, m, same, wide=24):
            seen[r, c] += W.upper(r, c) if diagonal else 1
        assert (seen[:, :m] == (np.triu(np.ones((n, m), int), 1) if same else 1)).all()


def _agreement(x, y):
    i, j = np.triu_indices(len(x), 1)
    p, q = (np.linalg.norm(v[i] - v[j], axis=1) for v in (x, y))
    return np.corrcoef(p, q)[0, 1]


def test_agreements_of_many_and_of_few_different_vectors(spark):
    x = rows(200, 6)
    few = x[np.arange(200) % 3]
    df = spark.createDataFrame([(i, x[i].tolist(), x[i, :2].tolist(), few[i].tolist()) for i in range(200)], "id long, v array<double>, w array<double>, e array<double>")
    out = M.distance_agreements(df, {"vw": ("v", "w"), "ve": ("v", "e")})
    assert "MapInArrow" in plan(out) and "SortMergeJoin" in plan(out)  # blocks meet, not rows
    got = out.first()
    assert got["vw"] == pytest.approx(_agreement(x, x[:, :2]), abs=1e-12)
    assert got["ve"] == pytest.approx(_agreement(x, few), abs=1e-12)


def test_distances_near_zero_keep_their_digits():
    x = np.ones((20, 3)) * 0.7
    x[:, 0] += np.arange(20) * 1e-9
    d = W.Distances(x, x, 3).part(slice(0, 20), slice(0, 20))
    assert np.allclose(d, np.abs(x[:, None, 0] - x[None, :, 0]), rtol=1e-6, atol=0)
    assert (np.diag(d) == 0).all()


def _double_sum(x, pair):
    return np.prod([pair(x[:, None, d], x[None, :, d]) for d in range(x.shape[1])], axis=0).sum()


PAIRS = {
    "CD": lambda x, y: 1 + 0.5 * abs(x - 0.5) + 0.5 * abs(y - 0.5) - 0.5 * abs(x - y),
    "WD": lambda x, y: 1.5 - abs(x - y) * (1 - abs(x - y)),
    "MD": lambda x, y: 15 / 8 - 0.25 * abs(x - 0.5) - 0.25 * abs(y - 0.5) - 0.75 * abs(x - y) + 0.5 * (x - y) ** 2,
    "L2-star": lambda x, y: 1 - np.maximum(x, y),
}


@pytest.mark.parametrize("method", sorted(PAIRS))
def test_double_sums_of_discrepancies(spark, method):
    """Each pair of points once, copies by weight: no cross join of points with themselves."""
    x = rows(150, 3)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    terms, pair = M.DISCREPANCIES[method][-2:]
    out = W.sum_of(df, ["a", "b", "c"], terms, pair)
    assert "MapInArrow" in plan(out) and "Cartesian" not in plan(out)
    assert out.first()["s"] == pytest.approx(_double_sum(x, PAIRS[method]), rel=1e-12)


def test_similarity_over_pairs_is_dealt_over_tiles(spark):
    """A sample's pairs don't meet under its one key; a sample of one realization has none."""
    x = rows(60, 16)
    df = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(60)] + [(7, 99, x[0].tolist())], "sample_id int, realization long, data array<double>")
    out = D.ssim_pairs(df)
    assert "MapInArrow" in plan(out)
    want = {}
    for s in (0, 1):
        v = x[s::2]
        i, j = np.triu_indices(len(v), 1)
        m, w, c = v.mean(axis=1), v.var(axis=1, ddof=1), (v[i] * v[j]).mean(axis=1) - v[i].mean(axis=1) * v[j].mean(axis=1)
        want[s] = ((2 * m[i] * m[j] + 1e-4) * (2 * c + 9e-4) / ((m[i] ** 2 + m[j] ** 2 + 1e-4) * (w[i] + w[j] + 9e-4))).mean()
    got = {r["sample_id"]: r for r in out.collect()}
    assert set(got) == {0, 1} and all(got[s]["pairs"] == 435 and got[s]["ssim"] == pytest.approx(want[s], abs=1e-12) for s in want)
