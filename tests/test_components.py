"""Components by runs and by tiles against flooding."""

import numpy as np
import pandas as pd
import pytest
from plain_grids import _labels
from pyspark.sql import functions as F

from gridstat.operators import components as C


def masks():
    rng = np.random.default_rng(1)
    out = [rng.random((h, w)) < p for h, w in ((1, 1), (1, 9), (9, 1), (8, 8), (17, 5), (30, 31)) for p in (0.0, 0.2, 0.45, 0.7, 1.0)]
    spiral = np.zeros((15, 15), bool)
    for k in range(0, 8, 2):
        spiral[k, k : 15 - k] = spiral[k : 15 - k, 14 - k] = spiral[14 - k, k : 15 - k] = True
        spiral[k + 2 : 15 - k, k] = True
    return [*out, spiral, np.indices((12, 12)).sum(0) % 2 == 0]


def test_runs_agree_with_flooding():
    for m in masks():
        assert sorted(C.sizes_of(m)) == sorted(_labels(m))
        row, first, after, label = C.runs_of(m)
        cells = C._labelled(*m.shape, row, first, after, label)
        assert ((cells >= 0) == m).all() and np.bincount(cells[m]).tolist() == C.sizes_of(m)


def test_roots():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, e = int(rng.integers(1, 30)), int(rng.integers(0, 40))
        a, b = rng.integers(0, n, e), rng.integers(0, n, e)
        root = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                root[x] = root[y] = min(root[x], root[y])
        assert C.roots(n, a, b).tolist() == root


@pytest.mark.parametrize("side", [3, 8])
def test_tiles_agree_with_flooding(spark, side):
    every = masks()
    rows = [(i, m.shape[0], m.shape[1], m.ravel().astype(float).tolist()) for i, m in enumerate(every)]
    f = spark.createDataFrame(rows, "k long, h int, w int, data array<double>").repartition(6)
    tiles = C.tiled(f, "k", F.transform("data", lambda v: v > 0), side)
    got: dict = {}
    for r in C.component_sizes(tiles, "k").collect():
        got.setdefault(r["k"], []).append(r["n"])
    for i, m in enumerate(every):
        assert sorted(got.get(i, [])) == sorted(_labels(m)), i
    assert C.component_sizes(tiles.limit(0), "k").count() == 0


def test_a_large_grid_as_tiles(spark):
    """4,096 x 4,096 cells in 64 tiles: no task sees more than one."""

    def mask():
        rng = np.random.default_rng(7)
        coarse = rng.random((256, 256)) < 0.55
        return np.kron(coarse, np.ones((16, 16), bool)) & (rng.random((4096, 4096)) < 0.9)

    def cut(batches):
        whole = mask()
        for pdf in batches:
            for i in pdf["id"]:
                ty, tx = divmod(int(i), 8)
                part = whole[ty * 512 : (ty + 1) * 512, tx * 512 : (tx + 1) * 512]
                yield pd.DataFrame({"k": [1], "ty": [ty], "tx": [tx], "y": [ty * 512], "x": [tx * 512], "h": [512], "w": [512], "mask": [part.ravel()]})

    tiles = spark.range(0, 64, 1, 4).mapInPandas(cut, "k int, ty long, tx long, y long, x long, h int, w int, mask array<boolean>")
    got = sorted(r["n"] for r in C.component_sizes(tiles, "k").select("n").collect())
    assert got == sorted(C.sizes_of(mask()))


def test_tiles_of_many_shapes_together(spark):
    """Tiles are looked at many at a time; none reaches into the next, numbers begin anew in each."""
    rng = np.random.default_rng(8)
    tiles = [(k, int(h), int(w), rng.random(h * w) < 0.5) for k, (h, w) in enumerate(rng.integers(1, 6, (40, 2)))] + [(40, 3, 3, np.ones(9, bool)), (41, 3, 3, np.zeros(9, bool)), (42, 3, 3, np.ones(9, bool))]
    df = spark.createDataFrame([(k, 0, 0, 0, 0, h, w, m.tolist()) for k, h, w, m in tiles], "k long, ty long, tx long, y long, x long, h long, w long, mask array<boolean>").coalesce(1)
    out = C.tile_components(df, "k")
    got: dict = {}
    for r in out.where(f"kind = {C.SIZE}").orderBy("k", "component").collect():
        got.setdefault(r["k"], []).append((r["component"], r["n"]))
    assert 41 not in got and got[40] == got[42] == [(0, 9)]
    for k, h, w, m in tiles:
        assert [n for _, n in got.get(k, [])] == C.sizes_of(m.reshape(h, w)) and [c for c, _ in got.get(k, [])] == list(range(len(got.get(k, []))))
