"""Recurrence and correlation dimension of one sequence in plain numpy, row by row: what the tiles are compared with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_CELLS = 1_000_000  # cells of a matrix that are held at a time, whatever the length of the sequence


def _embedded(y: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(y) - (dim - 1) * delay
    return np.stack([y[i * delay : i * delay + n] for i in range(dim)], axis=1) if n > 0 else np.zeros((0, dim))


def _distances(p: np.ndarray, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows of the distance matrix, with the number of their first row."""
    step = max(1, cells // max(1, len(p)))
    for at in range(0, len(p), step):
        yield at, np.sqrt(((p[at : at + step, None] - p[None]) ** 2).sum(axis=2))


def _pairs(p: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Distances between different points, each pair once, block by block."""
    for at, d in _distances(p, cells):
        yield d[np.arange(len(p))[None] > at + np.arange(len(d))[:, None]]


def recurrence(
    y: np.ndarray, dim: int = 2, delay: int = 1, share: float = 0.1, bins: int = 20, cells: int = BLOCK_CELLS
) -> tuple[float, float, float, float]:
    """Recurrence rate, determinism, laminarity, entropy of diagonal lengths.

    Of every point of the sequence: runs of a row end with it (columns are rows, by symmetry), runs of diagonals
    are carried from row to row.
    """
    p = _embedded(y, dim, delay)
    if len(p) < 2 or not np.isfinite(p).all():
        return (float("nan"),) * 4
    size = len(p)
    most = max(d.max() for _, d in _distances(p, cells))
    n = lam = 0
    lengths = np.zeros(size + 1, np.int64)  # runs of diagonals by length
    run = np.zeros(size, np.int64)  # those that end in the row before
    for _, d in _distances(p, cells):
        r = d <= share * most
        n += int(r.sum())
        beside = np.zeros_like(r)
        beside[:, 1:] |= r[:, :-1]
        beside[:, :-1] |= r[:, 1:]
        lam += int((r & beside).sum())
        for row in r:
            ended = run.copy()
            ended[:-1][row[1:]] = 0  # goes on, except at the right edge
            np.add.at(lengths, ended[ended > 0], 1)
            run = np.where(row, np.concatenate([[0], run[:-1]]) + 1, 0)
    np.add.at(lengths, run[run > 0], 1)
    long = np.flatnonzero(lengths[2:]) + 2
    counts = np.histogram(long, bins=bins, weights=lengths[long])[0] if len(long) else np.zeros(1)
    q = counts[counts > 0] / max(1, counts.sum())
    return n / size**2, float((long * lengths[long]).sum() / n), lam / n, float(-(q * np.log(q)).sum())


def _ranked(p: np.ndarray, rank: int, cells: int) -> float:
    """The pair distance of a rank from 0, exactly: ranges that hold it are narrowed until their values fit a block."""
    lo, hi = -np.inf, np.inf
    while True:
        inside = 0
        least, most = np.inf, -np.inf
        below = 0
        for d in _pairs(p, cells):
            below += int((d < lo).sum())
            d = d[(d >= lo) & (d <= hi)]
            if len(d):
                inside, least, most = inside + len(d), min(least, d.min()), max(most, d.max())
        if least == most:
            return float(least)
        if inside <= cells:
            held = np.concatenate([d[(d >= lo) & (d <= hi)] for d in _pairs(p, cells)])
            return float(np.partition(held, rank - below)[rank - below])
        edges = np.linspace(least, most, 4097)
        if not (np.diff(edges) > 0).all():  # hardly any numbers lie between
            edges = np.array([least, np.nextafter(least, np.inf), most])
        counts = np.zeros(len(edges), np.int64)
        for d in _pairs(p, cells):
            d = d[(d >= lo) & (d <= hi)]
            counts += np.bincount(np.searchsorted(edges, d, side="right") - 1, minlength=len(edges))
        k = int(np.searchsorted(np.cumsum(counts), rank - below, side="right"))
        lo, hi = edges[k], np.nextafter(edges[k + 1], -np.inf) if k + 1 < len(edges) else edges[k]


def _percentile(p: np.ndarray, percent: float, cells: int) -> float:
    """numpy's percentile (linear) of the pair distances."""
    at = (len(p) * (len(p) - 1) // 2 - 1) * percent / 100
    k = int(at)
    a = _ranked(p, k, cells)
    return a + (_ranked(p, k + 1, cells) - a) * (at - k) if at > k else a


def correlation_dimension(y: np.ndarray, dim: int = 2, delay: int = 1, radii: int = 10, cells: int = BLOCK_CELLS) -> float:
    """Slope of log pair counts over log radius between the percentiles 1 and 99 of distances between different points."""
    p = _embedded(y, dim, delay)
    if len(p) < 3 or not np.isfinite(p).all():
        return float("nan")
    pairs = len(p) * (len(p) - 1) // 2
    if len(p) ** 2 <= cells:  # one block: the same numbers, sorted once
        d = np.concatenate(list(_pairs(p, cells)))
        lo, hi = np.percentile(d, 1), np.percentile(d, 99)
    else:
        lo, hi = _percentile(p, 1, cells), _percentile(p, 99, cells)
    if not 0 < lo < hi:
        return float("nan")
    r = np.geomspace(lo, hi, radii)
    c = sum(np.searchsorted(np.sort(d), r, side="left") for d in _pairs(p, cells)) / pairs
    use = c > 0
    return float(np.polyfit(np.log(r[use]), np.log(c[use]), 1)[0]) if use.sum() > 1 else float("nan")
