"""Recurrence and correlation dimension by tiles against whole matrices."""

import numpy as np
import pytest
from plain_recurrence import correlation_dimension, recurrence

from gridstat.operators import recurrence as C
from gridstat.operators import tiles as T


def frame(spark, seqs):
    rows = [(k, i, None if x is None else float(x)) for k, s in seqs.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "sample_id long, t int, y double").repartition(5)


def same(got, want):
    np.testing.assert_allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(("block", "dim", "delay"), [(7, 2, 1), (16, 3, 2)])
def test_tiles_agree_with_whole_matrices(spark, block, dim, delay):
    rng = np.random.default_rng(1)
    seqs = {
        1: rng.normal(size=150).cumsum(), 2: np.sin(np.arange(100) / 5), 3: rng.integers(0, 3, 60), 4: np.zeros(30), 5: [1.0], 6: [1.0, np.nan, 2.0, 3.0, 4.0, 5.0, 6.0], 7: rng.normal(size=block + 1 + (dim - 1) * delay),
        8: [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0],
    }
    df = frame(spark, seqs)
    got = {r[0]: tuple(r)[1:] for r in T.recurrences(df, dim=dim, delay=delay, block=block).collect()}
    assert set(got) == set(seqs)
    for k, s in seqs.items():
        same(got[k], recurrence(np.array(s, dtype=float), dim, delay))
    dims = dict(T.correlation_dimensions(df, dim=dim, delay=delay, block=block).collect())
    for k, s in seqs.items():
        same(dims[k], correlation_dimension(np.array(s, dtype=float), dim, delay))


def test_a_long_sequence_is_dealt_over_tiles(spark):
    rng = np.random.default_rng(2)
    y = np.sin(np.arange(5_000) / 9) + 0.2 * rng.normal(size=5_000)
    df = frame(spark, {1: y, 2: y[:50]})
    packed = T.blocks(df, "sample_id")
    assert max(len(r["ys"]) for r in packed.collect()) <= T.BLOCK + 3
    made = T.tiles(packed, "sample_id").groupBy("sample_id").count().collect()
    assert dict(made) == {1: 55, 2: 1}
    got = {r[0]: tuple(r)[1:] for r in T.recurrences(df).collect()}
    same(got[1], recurrence(y))
    same(got[2], recurrence(y[:50]))


def test_runs_of_random_cells():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, block = int(rng.integers(2, 30)), int(rng.integers(2, 9))
        full = rng.random((n, n)) < 0.6
        full = np.triu(full) | np.triu(full).T
        counts: dict[int, int] = {}
        pieces = []
        m = -(-n // block)
        for i in range(m):
            for j in range(i, m):
                t = T.Tile.__new__(T.Tile)
                t.n, t.i, t.j, t.row, t.column = n, i, j, i * block, j * block
                own, some = T.diagonal_runs(full[i * block : (i + 1) * block, j * block : (j + 1) * block], t)
                for k in np.flatnonzero(own):
                    counts[int(k)] = counts.get(int(k), 0) + int(own[k])
                pieces += some
        ends: dict = {}
        for d, row, length in sorted(pieces):
            before = ends.pop((d, row), 0)
            ends[d, row + length] = before + length
        for (d, _), length in ends.items():
            counts[length] = counts.get(length, 0) + (1 if d == 0 else 2)
        want: dict[int, int] = {}
        for d in range(-n + 1, n):
            for run in "".join("x" if c else " " for c in np.diagonal(full, d)).split():
                want[len(run)] = want.get(len(run), 0) + 1
        assert counts == want


def test_frequencies_and_no_rows(spark):
    df = frame(spark, {1: np.sin(2 * np.pi * np.arange(100) / 20)})
    assert C.nonlinear(df).select("dominant_frequency").first()[0] == pytest.approx(0.05)
    assert T.recurrences(df.limit(0)).count() == 0 == T.correlation_dimensions(df.limit(0)).count()


def test_sequences_of_one_block_are_measured_whole(spark, monkeypatch):
    """Their distances are all in one place: nothing of them is counted by ranges over all tasks."""
    rng = np.random.default_rng(5)
    seqs = {k: rng.normal(size=20 + k).cumsum() for k in range(6)}
    real, asked = T._rank_narrowing, []
    monkeypatch.setattr(T, "_rank_narrowing", lambda made, key, ranks, *a: asked.append(ranks.count()) or real(made, key, ranks, *a))
    dims = dict(T.correlation_dimensions(frame(spark, seqs)).collect())
    assert asked == [0]
    for k, s in seqs.items():
        same(dims[k], correlation_dimension(s))
