"""Measures of a sequence's matrix of distances, tile by tile: recurrence and correlation dimension at any length.

A sequence (key, t, y), t dense from 0, is cut into blocks of `BLOCK` points; every pair of
blocks is a tile with a key of its own, so one long sequence is dealt over all tasks. A tile
hands on sums and, for diagonals, a mergeable summary: lengths of runs that begin and end
inside, and the piece of each run that touches its border. Pieces of a diagonal that follow
one another are one run. The matrix is symmetric, so only its upper half is looked at.
Nothing that grows with a sequence's length comes together in a task: what a tile sees are
two blocks, and pieces meet by diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstat.operators.ranks import PARTS, narrow
from gridstat.sources.steps import Steps

#: Points of a block.
BLOCK = 512


def blocks(series: DataFrame, key: str, dim: int = 2, delay: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, n, block, ys): n embedded points of a sequence, and the values that a block's points and one more on either side need.

    Only sequences of two points at least, all of them finite.
    """
    span = (dim - 1) * delay
    y = F.col("y").cast("double")
    known = series.groupBy(key).agg(F.count("*").alias("values"), F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("odd"))
    sizes = known.where((F.col("odd") == 0) & (F.col("values") - span >= 2)).select(key, (F.col("values") - span).alias("n"))
    t, last = F.col("t").cast("long"), F.floor((F.col("n") - 1) / block)
    first = F.greatest(F.lit(0), F.floor((t - 1 - span) / block))
    dealt = series.join(sizes, key).select(key, "n", t.alias("t"), y.alias("y"), F.explode(F.sequence(first, F.least(last, F.floor((t + 1) / block)))).alias("block"))
    inside = (F.col("t") >= F.col("block") * block - 1) & (F.col("t") <= (F.col("block") + 1) * block + span)
    packed = dealt.where(inside).groupBy(key, "n", "block").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s"))
    return packed.select(key, "n", "block", F.transform("s", lambda e: e["y"]).alias("ys"))


def tiles(packed: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, n, i, j, a, b): all pairs of blocks with i <= j, each a row of its own key."""
    last = F.floor((F.col("n") - 1) / block)
    own = packed.select(key, "n", F.col("block").alias("i"), F.col("block").alias("j"), F.col("ys").alias("a"), F.col("ys").alias("b"))
    long = packed.where(F.col("n") > block)  # a sequence of one block is its own tile: nothing to meet
    rows = long.select(key, "n", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), last)).alias("j"), F.col("ys").alias("a")).where("i < j")
    columns = long.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("ys").alias("b")).where("i < j")
    return own.unionByName(rows.join(columns, [key, "i", "j"]).select(key, "n", "i", "j", "a", "b"))


class Tile:
    """Distances of a pair of blocks with a cell more on every side that the matrix has."""

    def __init__(self, n: int, i: int, j: int, a: np.ndarray, b: np.ndarray, dim: int, delay: int, block: int):
        self.n, self.i, self.j, self.block = n, i, j, block
        self.top, self.left = max(0, i * block - 1), max(0, j * block - 1)
        p, q = self._points(a, self.top, i, dim, delay), self._points(b, self.left, j, dim, delay)
        d = np.zeros((len(p), len(q)))
        for k in range(dim):
            d += (p[:, None, k] - q[None, :, k]) ** 2
        self.wide = np.sqrt(d)
        self.row, self.column = i * block, j * block
        self.rows, self.columns = min(block, n - self.row), min(block, n - self.column)

    def _points(self, y: np.ndarray, begin: int, at: int, dim: int, delay: int) -> np.ndarray:
        m = min(self.n, (at + 1) * self.block + 1) - begin
        return np.stack([y[k * delay : k * delay + m] for k in range(dim)], axis=1)

    def core(self, wide: np.ndarray) -> np.ndarray:
        r, c = self.row - self.top, self.column - self.left
        return wide[r : r + self.rows, c : c + self.columns]

    def above(self) -> np.ndarray:
        """Distances of different points, each pair once."""
        d = self.core(self.wide)
        return d[np.triu_indices(self.rows, 1)] if self.i == self.j else d.ravel()


def _mapped(made: DataFrame, key: str, out: str, dim: int, delay: int, block: int, fn: Callable[[Tile, tuple], Iterator[tuple]]) -> DataFrame:
    """fn's rows of each tile after its key. Columns beyond a tile's own are handed to fn. Rows are yielded a tile at a time."""
    kind = made.schema[key].dataType.simpleString()
    more = [c for c in made.columns if c not in (key, "n", "i", "j", "a", "b")]
    made = made.select(key, "n", "i", "j", "a", "b", *more)
    names = [key, *(c.split()[0] for c in out.split(", "))]
    types = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                n, i, j = (one.column(c)[0].as_py() for c in (1, 2, 3))
                a, b = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5))
                found = list(fn(Tile(n, i, j, a, b, dim, delay, block), tuple(one.column(5 + k)[0].as_py() for k in range(1, 1 + len(more)))))
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([one.column(0)[0].as_py()] * len(found), batch.schema.field(0).type), *columns], names=names)

    # A tile's blocks are some kilobytes; a batch holds few.
    return made.mapInArrow(run, f"{key} {kind}, {out}")


def extents(made: DataFrame, key: str, dim: int = 2, delay: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, pairs, least, most): number and range of the distances of different points."""

    def fn(t: Tile, _: tuple) -> Iterator[tuple]:
        d = t.above()
        if len(d):
            yield len(d), float(d.min()), float(d.max())

    parts = _mapped(made, key, "pairs long, least double, most double", dim, delay, block, fn)
    return parts.groupBy(key).agg(F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most"))


def diagonal_runs(r: np.ndarray, tile: Tile) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Runs along the diagonals of a tile's cells: counts of whole ones by length, and (diagonal, first row, length) of those at a border.

    Of a tile on the main diagonal only the upper half. A border of the matrix ends a run.
    """
    h, w = r.shape
    # Row k moved left by k: a diagonal becomes a column. The room before a row's cells is empty.
    flat = np.zeros(h * (h + w) + h + w, bool)
    np.lib.stride_tricks.as_strided(flat[h - 1 :], (h, w), (h + w, 1))[:] = r
    skew = np.lib.stride_tricks.as_strided(flat, (h, h + w - 1), (h + w + 1, 1))
    padded = np.zeros((h + w - 1, h + 2), np.int8)
    padded[:, 1:-1] = skew.T
    step = np.diff(padded, axis=1)
    at, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    diagonal = at - (h - 1) + tile.column - tile.row
    length = end - begin
    if tile.i == tile.j:
        upper = diagonal >= 0
        begin, end, diagonal, length, at = begin[upper], end[upper], diagonal[upper], length[upper], at[upper]
    # A run touches a side if the cell before it or after it lies in another tile of the matrix.
    row, column = tile.row + begin, tile.row + begin + diagonal
    opens = (row > 0) & ((begin == 0) | (column == tile.column))
    after_row, after_column = tile.row + end, tile.row + end + diagonal
    goes_on = (after_column < tile.n) & ((end == h) | (after_column == tile.column + w)) & (after_row < tile.n)
    border = opens | goes_on
    weight = np.where(diagonal[~border] == 0, 1, 2)
    counts = np.bincount(length[~border], weights=weight, minlength=1).astype(np.int64)
    return counts, list(zip(diagonal[border].tolist(), row[border].tolist(), length[border].tolist(), strict=True))


#: Kinds of rows that a tile hands on: sums (cells, cells beside others), counts of runs (length, times), pieces (diagonal, row, length).
SUMS, RUNS, PIECES = 0, 1, 2


def recurrences(series: DataFrame, key: str = "sample_id", dim: int = 2, delay: int = 1, share: float = 0.1, bins: int = 20, block: int = BLOCK) -> DataFrame:
    """(key, recurrence_rate, determinism, laminarity, diagonal_entropy) over all pairs of points; null for sequences that can't be embedded.

    Two points recur within a share of the largest distance. Determinism weighs recurrent cells of diagonals
    by runs of two and more, laminarity counts those beside another one, entropy is that of lengths of diagonal runs in bins.
    """
    steps = Steps(series.sparkSession)
    packed = steps.write(0, blocks(series, key, dim, delay, block))
    made = tiles(packed, key, block)
    most = extents(made, key, dim, delay, block).select(key, (share * F.col("most")).alias("within"))

    def fn(t: Tile, more: tuple) -> Iterator[tuple]:
        wide = np.zeros((t.rows + 2, t.columns + 2), bool)
        r = t.wide <= more[0]
        at, left = 1 - (t.row - t.top), 1 - (t.column - t.left)
        wide[at : at + r.shape[0], left : left + r.shape[1]] = r[: t.rows + 2 - at, : t.columns + 2 - left]
        core = wide[1:-1, 1:-1]
        across, down = core & (wide[1:-1, :-2] | wide[1:-1, 2:]), core & (wide[:-2, 1:-1] | wide[2:, 1:-1])
        if t.i == t.j:
            yield SUMS, int(core.sum()), int(across.sum()), 0
        else:
            yield SUMS, 2 * int(core.sum()), int(across.sum() + down.sum()), 0
        counts, pieces = diagonal_runs(core, t)
        yield from ((RUNS, int(k), int(counts[k]), 0) for k in np.flatnonzero(counts))
        yield from ((PIECES, *p) for p in pieces)

    said = steps.write(1, _mapped(made.join(most, key), key, "kind int, a long, b long, c long", dim, delay, block, fn))
    sums = said.where(f"kind = {SUMS}").groupBy(key).agg(F.sum("a").alias("cells"), F.sum("b").alias("beside"))
    by = Window.partitionBy(key, "a").orderBy("b")
    pieces = said.where(f"kind = {PIECES}").withColumn("new", (F.col("b") != F.coalesce(F.lag(F.col("b") + F.col("c")).over(by), F.lit(-1))).cast("int"))
    runs = pieces.withColumn("run", F.sum("new").over(by)).groupBy(key, "a", "run").agg(F.sum("c").alias("length"))
    whole = said.where(f"kind = {RUNS}").select(key, F.col("a").alias("length"), F.col("b").alias("times"))
    counts = whole.unionByName(runs.select(key, "length", F.when(F.col("a") == 0, 1).otherwise(2).cast("long").alias("times"))).groupBy(key, "length").agg(F.sum("times").alias("times"))
    long = counts.where("length >= 2")
    bounds = long.groupBy(key).agg(F.min("length").alias("lo"), F.max("length").alias("hi"), F.sum("times").alias("total"), F.sum(F.col("length") * F.col("times")).alias("inside"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.call_function("div", (F.col("length") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(bins - 1))).otherwise(0)
    share_of = F.sum("times") / F.first("total")
    entropy = long.join(bounds, key).groupBy(key, place.alias("bin")).agg(share_of.alias("p")).groupBy(key).agg((-F.sum(F.col("p") * F.log("p"))).alias("diagonal_entropy"))
    out = packed.select(key, "n").distinct().join(sums, key).join(bounds.select(key, "inside"), key, "left").join(entropy, key, "left")
    cells = F.col("cells")
    found = out.select(
        key, (cells / (F.col("n") * F.col("n"))).alias("recurrence_rate"), (F.coalesce("inside", F.lit(0)) / cells).alias("determinism"),
        (F.col("beside") / cells).alias("laminarity"), F.coalesce("diagonal_entropy", F.lit(0.0)).alias("diagonal_entropy"),
    )
    return series.select(key).distinct().join(found, key, "left")


def _rank_narrowing(made: DataFrame, key: str, ranks: DataFrame, steps: Steps, step: int, dim: int, delay: int, block: int) -> DataFrame:
    """(key, place, value): distances of given ranks (key, place, rank, lo, hi, n), by counts in ranges that narrow to one value."""
    state = steps.write(step, ranks)
    while not state.where("lo < hi").isEmpty():
        asked = state.where("lo < hi").groupBy(key).agg(*[F.collect_list(c).alias(f"{c}s") for c in ("place", "lo", "hi")])

        def fn(t: Tile, more: tuple) -> Iterator[tuple]:
            d = t.above()
            for place, lo, hi in zip(*more, strict=True):
                x = d[(d >= lo) & (d <= hi)]
                if len(x):
                    part = np.clip(((x - lo) / (hi - lo) * PARTS).astype(np.int64), 0, PARTS - 1) + 1
                    part[x == lo], part[x == hi] = 0, PARTS + 1
                    order = np.argsort(part, kind="stable")
                    part, x = part[order], x[order]
                    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    times = np.diff(np.r_[first, len(part)])
                    yield from zip([place] * len(first), part[first].tolist(), times.tolist(), np.minimum.reduceat(x, first).tolist(), np.maximum.reduceat(x, first).tolist(), strict=True)

        counted = _mapped(made.join(asked, key), key, "place int, part long, n long, least double, most double", dim, delay, block, fn)
        counted = counted.groupBy(key, "place", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        step += 1
        state = steps.write(step, state.where("lo >= hi").unionByName(narrow(counted, state.where("lo < hi"), [key])))
    return state.select(key, "place", F.col("lo").alias("value"))


def correlation_dimensions(series: DataFrame, key: str = "sample_id", dim: int = 2, delay: int = 1, radii: int = 10, block: int = BLOCK) -> DataFrame:
    """(key, correlation_dimension): slope of log shares of pairs over log radius, between the percentiles 1 and 99 of the distances of different points."""
    steps = Steps(series.sparkSession)
    packed = steps.write(0, blocks(series, key, dim, delay, block))

    def whole(t: Tile, _: tuple) -> Iterator[tuple]:
        """The counts of a sequence of one block, whose distances are all here, between its own percentiles."""
        d = np.sort(t.above())
        lo, hi = (float(d[int(np.floor(p))] + (d[int(np.ceil(p))] - d[int(np.floor(p))]) * (p - np.floor(p))) for p in ((len(d) - 1) * q / 100 for q in (1, 99))) if len(d) > 1 else (0.0, 0.0)
        if 0 < lo < hi:
            below = np.searchsorted(d, np.geomspace(lo, hi, radii), side="left")
            yield from ((k, int(c), len(d), lo, hi) for k, c in enumerate(below))

    short = tiles(packed.where(F.col("n") <= block), key, block)
    of_short = _mapped(short, key, "radius int, below long, pairs long, lo double, hi double", dim, delay, block, whole)
    made = tiles(packed.where(F.col("n") > block), key, block)
    size = steps.write(1, extents(made, key, dim, delay, block))
    at = [(F.col("pairs") - 1) * F.lit(q) / 100 for q in (1, 99)]
    ranks = F.posexplode(F.array(*[r for p in at for r in (F.floor(p), F.ceil(p))])).alias("place", "rank")
    asked = size.where("pairs > 1").select(key, ranks, F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("pairs").alias("n"))
    found = _rank_narrowing(made, key, asked, steps, 2, dim, delay, block)
    value = lambda i: F.max(F.when(F.col("place") == i, F.col("value")))
    ends = size.join(found.groupBy(key).agg(*[value(i).alias(f"v{i}") for i in range(4)]), key)
    between = lambda a, b, p: F.col(a) + (F.col(b) - F.col(a)) * (p - F.floor(p))
    ends = ends.select(key, "pairs", between("v0", "v1", at[0]).alias("lo"), between("v2", "v3", at[1]).alias("hi")).where((F.col("lo") > 0) & (F.col("lo") < F.col("hi")))

    def fn(t: Tile, more: tuple) -> Iterator[tuple]:
        below = np.searchsorted(np.sort(t.above()), np.geomspace(more[0], more[1], radii), side="left")
        yield from ((k, int(c)) for k, c in enumerate(below))

    counted = _mapped(made.join(ends.drop("pairs"), key), key, "radius int, below long", dim, delay, block, fn).groupBy(key, "radius").agg(F.sum("below").alias("below"))
    x = F.log("lo") + (F.log("hi") - F.log("lo")) * F.col("radius") / (radii - 1)
    lines = counted.join(ends, key).unionByName(of_short).where("below > 0").select(key, x.alias("x"), F.log(F.col("below") / F.col("pairs")).alias("y"))
    slopes = lines.groupBy(key).agg(F.when(F.count("*") > 1, F.regr_slope("y", "x")).alias("correlation_dimension"))
    return series.select(key).distinct().join(slopes, key, "left")
