"""Measures of all pairs of rows, tile by tile.

Rows are dealt by a hash into blocks of at most about `ROWS`; every pair of blocks is a tile
with a key of its own, so one large group is spread over all tasks. What a task sees are two
blocks; inside, pairs are computed a strip at a time. A tile hands on sums, or a batch a strip.
The work is the square of a group's size, by definition; memory is not, and each row is handed
on once a block.

Where every pair is a row of the result, blocks are bands of as many rows as a task can hold (`of_bands`): what is
handed on then grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and the least number of blocks that a group is cut into.
ROWS, LEAST = 8_192, 8
#: Numbers in the vectors of a band, about at most; partitions for tiles of bands, each of which has one of its own while they suffice.
HELD, PARTS = 2**23, 144
#: Pairs of a strip: what is computed at a time stays in a processor's cache.
STRIP, WIDTH = 32, 1_024


def tiles(df: DataFrame, id: list[str], columns: list[str], keys: list[str] | None = None, rows: int = ROWS, least: int = LEAST) -> DataFrame:
    """(keys, i, j, a, b): all pairs of blocks with i <= j; a and b are structs of arrays, a column each. Rows of a block have no order."""
    keys = keys or []
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(least), F.ceil(F.count("*") / rows)).cast("int").alias("blocks"))
    of_size = df.join(sizes, keys) if keys else df.join(F.broadcast(sizes))  # one row without keys
    own = F.pmod(F.xxhash64(*id), F.col("blocks")).cast("int")
    packed = of_size.groupBy(*keys, "blocks", own.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("s"))
    arrays = [(F.flatten(x) if df.schema[c].dataType.typeName() == "array" else x).alias(c) for c, x in ((c, F.col("s").getField(c)) for c in columns)]
    packed = packed.select(*keys, "blocks", "block", F.struct(*arrays).alias("s"))
    a = packed.select(*keys, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.col("s").alias("a"))
    b = packed.select(*keys, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("s").alias("b"))
    # Dealt by tile even where one side is small: the other side's own partitions are blocks, not tiles.
    return a.hint("merge").join(b, [*keys, "i", "j"])


Block = dict[str, np.ndarray]


def mapped(made: DataFrame, out: str, fn: Callable[[Block, Block, bool], Iterator[list]], keys: list[str] | None = None) -> DataFrame:
    """(keys, out): the columns that fn yields for each tile's blocks; True says that both are the same block."""
    keys = keys or []
    k = len(keys)
    names = [*keys, *(c.split()[0] for c in out.split(", "))]
    types = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in out.split(", ")]

    def block(x: pa.StructScalar) -> Block:
        return {c: v.values.to_numpy(zero_copy_only=False) for c, v in x.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column(k)[at].as_py() == batch.column(k + 1)[at].as_py()
                a = block(batch.column(k + 2)[at])
                for columns in fn(a, a if same else block(batch.column(k + 3)[at]), same):
                    values = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    own = [pa.array([batch.column(i)[at].as_py()] * len(values[0]), batch.schema.field(i).type) for i in range(k)]
                    yield pa.RecordBatch.from_arrays([*own, *values], names=names)

    kinds = [f"{c} {made.schema[c].dataType.simpleString()}" for c in keys]
    return made.select(*keys, "i", "j", "a", "b").mapInArrow(run, ", ".join([*kinds, out]))


class Band(NamedTuple):
    """Rows of a band by id; of a null vector, `there` is False and the values are NaN."""

    id: np.ndarray
    v: np.ndarray
    there: np.ndarray


def _band(parts: list[tuple[pa.Array, pa.Array]]) -> Band:
    there = np.concatenate([v.is_valid().to_numpy(zero_copy_only=False) for _, v in parts])
    lengths = {n for _, v in parts for n in v.value_lengths().drop_null().unique().to_pylist()}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    given = np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for _, v in parts]).reshape(int(there.sum()), max(lengths, default=0))
    v = given
    if not there.all():
        v = np.full((len(there), given.shape[1]), np.nan, given.dtype)
        v[there] = given
    return Band(np.concatenate([x.to_numpy() for x, _ in parts]), v, there)


def of_bands(df: DataFrame, id: str, vector: str, out: str, fn: Callable[[Band, Band], Iterator[list]], held: int = HELD, least: int = LEAST) -> DataFrame:
    """The columns that fn yields for pairs of bands, which shall be those of all pairs with an id of the first below one of the second.

    Two bands come in either order, a band with itself once. Each row is handed on once a band, and there are more
    than `least` bands only where one would hold more than `held` numbers. Rows whose id is null have no pairs.
    """
    plain = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    rows = df.select(F.col(id).cast("long").alias("id"), (F.col(vector) if plain else F.col(vector).cast("array<double>")).alias("v")).where(F.col("id").isNotNull())
    numbers = F.sum(F.greatest(F.lit(1), F.size("v")))
    bands = rows.agg(F.greatest(F.lit(least), F.ceil(numbers / held)).cast("int").alias("bands"))
    own, every = F.pmod(F.xxhash64("id"), F.col("bands")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("bands") - 1))
    met = rows.join(F.broadcast(bands)).select("id", "v", own.alias("own"), every.alias("other"))
    tiled = met.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "v")
    # By ranges: a hash would put several of the few tiles into one task and none into another.
    dealt = tiled.repartitionByRange(PARTS, "i", "j").sortWithinPartitions("i", "j", "second", "id")
    names = [c.split()[0] for c in out.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in out.split(", ")]

    def tile(i: int, j: int, parts: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        found = [_band(x) for x in parts if x]
        meet = [(found[0], found[0])] if i == j else [(found[0], found[1]), (found[1], found[0])] if len(found) == 2 else []
        for a, b in meet:
            for columns in fn(a, b):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                i, j, second = marks[:, at].tolist()
                if key != (i, j):
                    if key:
                        yield from tile(*key, parts)
                    key, parts = (i, j), ([], [])
                parts[second].append((batch.column(3).slice(at, to - at), batch.column(4).slice(at, to - at)))
        if key:
            yield from tile(*key, parts)

    return dealt.mapInArrow(run, out)


def ascending(p: np.ndarray, q: np.ndarray, high: int = STRIP, wide: int = WIDTH) -> Iterator[tuple[slice, slice, bool]]:
    """Parts of the matrix of sorted ids p and q that have cells p < q, and whether they have others."""
    for at in range(0, len(p), high):
        rows = slice(at, min(at + high, len(p)))
        for left in range(int(np.searchsorted(q, p[at], "right")), len(q), wide):
            yield rows, slice(left, min(left + wide, len(q))), bool(q[left] <= p[rows.stop - 1])


def strips(n: int, m: int, same: bool, high: int = STRIP, wide: int = WIDTH) -> Iterator[tuple[slice, slice, bool]]:
    """Parts of an n x m matrix, and whether one lies on the diagonal of a block with itself; of that, only parts that have pairs p < q."""
    for at in range(0, n, high):
        for left in range(at if same else 0, m, wide):
            yield slice(at, min(at + high, n)), slice(left, min(left + wide, m)), same and left < at + high


def upper(rows: slice, columns: slice) -> np.ndarray:
    """Cells p < q of a part."""
    return np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)[None, :]


class Distances:
    """Euclidean distances between vectors of two blocks, a part at a time.

    Few different vectors on either side: a table of theirs. Else products of centred vectors; what comes out
    near zero, where a product has lost its digits, is found again from differences.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, dims: int):
        self.a, self.b = a.reshape(-1, dims), b.reshape(-1, dims)
        (ua, self.ia), (ub, self.ib) = (self._different(x) for x in (self.a, self.b))
        self.table = None
        if 8 * len(ua) <= len(self.a) and 8 * len(ub) <= len(self.b):
            self.table = np.sqrt(np.stack([((ub - x) ** 2).sum(axis=1) for x in ua]))
            return
        middle = (self.a.mean(axis=0) + self.b.mean(axis=0)) / 2
        self.p, self.q = self.a - middle, self.b - middle
        self.pp, self.qq = (self.p**2).sum(axis=1), (self.q**2).sum(axis=1)
        self.near = 1e-7 * max(self.pp.max(), self.qq.max())

    @staticmethod
    def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        return x[first], inverse.ravel()

    def part(self, rows: slice, columns: slice) -> np.ndarray:
        if self.table is not None:
            return self.table[self.ia[rows]][:, self.ib[columns]]
        d = self.p[rows] @ self.q[columns].T
        d *= -2
        d += self.pp[rows, None]
        d += self.qq[None, columns]
        if not d.min() > self.near:
            i, j = np.nonzero(~(d > self.near))
            d[i, j] = ((self.a[rows][i] - self.b[columns][j]) ** 2).sum(axis=1)
        return np.sqrt(d, out=d)


def sum_of(points: DataFrame, dims: list[str], terms: Callable[[np.ndarray], list[np.ndarray]], pair: Callable[..., np.ndarray]) -> DataFrame:
    """One row `s`: the sum, over all ordered pairs of points and each with itself, of a product over dimensions.

    `terms` makes arrays of a dimension's values once a block; `pair` makes a part of the matrix of a symmetric
    function from its rows' terms and its columns'. Equal points are one point with a weight.
    """
    whole = points.groupBy(*dims).agg(F.count("*").cast("double").alias("_n"))

    def fn(a: Block, b: Block, same: bool) -> Iterator[list]:
        p, q = ([terms(x[d]) for d in dims] for x in (a, b))
        total = 0.0
        for rows, columns, diagonal in strips(len(a["_n"]), len(b["_n"]), same):
            out = None
            for x, y in zip(p, q, strict=True):
                one = pair(*[t[rows, None] for t in x], *[t[None, columns] for t in y])
                out = one if out is None else np.multiply(out, one, out=out)
            if diagonal:
                at = np.arange(rows.start, rows.stop)[:, None] - np.arange(columns.start, columns.stop)[None, :]
                out *= np.where(at < 0, 2.0, np.where(at == 0, 1.0, 0.0))
            else:
                out *= 2.0
            total += float(a["_n"][rows] @ (out @ b["_n"][columns]))
        yield [[total]]

    return mapped(tiles(whole, dims, [*dims, "_n"]), "s double", fn).agg(F.sum("s").alias("s"))
