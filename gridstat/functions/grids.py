"""Column functions over packed grids (h, w, data array<double> in row-major order): row-local, built-in functions only.

Arrays that several terms need are bound once by `bind`: Spark evaluates a bound
value a single time, however often a lambda refers to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, exp

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def bind(body: Callable[..., Column], *values: Column) -> Column:
    """body(*values), each value evaluated once."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(held, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


# --- arrays; those that are named twice in a function should be bound by the caller


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def sum_of(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def mean_of(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.try_divide(sum_of(a, f), F.size(a))


def variance(a: Column, ddof: int = 1) -> Column:
    """Variance of an array's values; null for too few of them."""
    return bind(lambda m: F.when(F.size(a) > ddof, sum_of(a, lambda v: (v - m) * (v - m)) / (F.size(a) - ddof)), mean(a))


def deviation(a: Column, ddof: int = 1) -> Column:
    return F.sqrt(variance(a, ddof))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; null where one is constant."""

    def of(p: Column, q: Column) -> Column:
        return bind(lambda norm: F.when(norm > 0, dot(p, q) / norm), F.sqrt(sum_of(p, lambda v: v * v) * sum_of(q, lambda v: v * v)))

    return bind(of, centred(a), centred(b))


def centred(a: Column) -> Column:
    return bind(lambda m: F.transform(a, lambda v: v - m), mean(a))


def median(a: Column) -> Column:
    """The middle value, or the mean of the two in the middle."""
    return bind(lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2, F.array_sort(a))


def share_of(a: Column, f: Callable[[Column], Column]) -> Column:
    """Share of an array's values that meet a condition."""
    return mean_of(a, lambda v: F.when(f(v), F.lit(1.0)).otherwise(F.lit(0.0)))


def first_place(a: Column, value: Column) -> Column:
    """Index of the first such value, from 0."""
    return (F.array_position(a, value) - 1).cast("int")


def squared_counts(a: Column) -> Column:
    """Sum over different values of the square of how often they occur."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda s, v: F.struct(
        v.alias("last"), F.when(v == s["last"], s["n"] + 1).otherwise(F.lit(1.0)).alias("n"), (s["s"] + F.when(v == s["last"], 2 * s["n"] + 1).otherwise(F.lit(1.0))).alias("s")
    )
    return F.aggregate(F.array_sort(a), start, step, lambda s: s["s"])


def entropy(weights: Column, floor: float = 1e-10) -> Column:
    """Shannon entropy (natural) of weights as shares of their total."""
    return bind(lambda t: -sum_of(weights, lambda v: v / t * F.log(v / t + floor)), total(weights) + EPS)


# --- grids


@dataclass(frozen=True)
class Grid:
    """A packed grid's columns. Positions may be columns or integers."""

    h: Column
    w: Column
    data: Column

    @property
    def n(self) -> Column:
        return self.h * self.w

    def inside(self, y: Column, x: Column) -> Column:
        """The value at a position that is known to lie inside."""
        return F.get(self.data, (y * self.w + x).cast("int"))

    def near(self, y: Column, x: Column) -> Column:
        """The value at a position, zero outside."""
        return F.when((y >= 0) & (y < self.h) & (x >= 0) & (x < self.w), self.inside(y, x)).otherwise(F.lit(0.0))

    def around(self, y: Column, x: Column) -> Column:
        """The value at a position, periodic."""
        return self.inside(F.pmod(y, self.h), F.pmod(x, self.w))

    def cells(self, f: Callable[[Column, Column], Column]) -> Column:
        """f(y, x) of every cell, in row-major order."""
        return cells(self.h, self.w, f)

    def with_data(self, data: Column) -> Grid:
        return Grid(self.h, self.w, data)


def cells(h: Column, w: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(y, x) over a grid of h rows and w columns; an empty array where there is no cell."""
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform(F.sequence(F.lit(0), w - 1), lambda x: f(y, x)))
    return F.when((h > 0) & (w > 0), F.flatten(rows)).otherwise(F.array().cast("array<double>"))


def on(h: Column, w: Column, data: Column, body: Callable[[Grid], Column]) -> Column:
    """body of a grid whose data are evaluated once."""
    return bind(lambda a, b, d: body(Grid(a, b, d)), h, w, data)


def moments(g: Grid) -> Column:
    """Struct of the sums of v, v y, v x, v y y, v x x and v y x."""
    names = ("s", "y", "x", "yy", "xx", "yx")
    start = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def step(a: Column, p: Column) -> Column:
        v, y, x = F.get(g.data, p), F.floor(p / g.w), F.pmod(p, g.w)
        terms = (v, v * y, v * x, v * y * y, v * x * x, v * y * x)
        return F.struct(*[(a[n] + t).cast("double").alias(n) for n, t in zip(names, terms, strict=True)])

    return F.aggregate(F.sequence(F.lit(0), F.size(g.data) - 1), start, step)


def rows_of(g: Grid) -> Column:
    """The grid's rows: slices of its data."""
    return F.transform(F.sequence(F.lit(0), g.h - 1), lambda y: F.slice(g.data, y * g.w + 1, g.w))


def _moved(a: Column, n: Column, i: int, nothing: Column) -> Column:
    """An array of n entries, moved so that each place holds the entry i places on; `nothing` where there is none."""
    if i == 0:
        return a
    kept, lost = F.greatest(n - abs(i), F.lit(0)), F.least(n, F.lit(abs(i)))
    gap = F.array_repeat(nothing, lost)
    return F.concat(F.slice(a, F.lit(i + 1), kept), gap) if i > 0 else F.concat(gap, F.slice(a, F.lit(1), kept))


def box(g: Grid, size: int, join: Callable[[Column, Column], Column], weights: list[float] | None = None) -> Column:
    """The (weighted) values in each cell's size x size box, joined two by two, zero outside: along rows, then along columns.

    Whole rows are moved and joined entry by entry: no positions are computed.
    """
    reach = list(range(-(size // 2), size // 2 + 1))
    weigh = [None if weights is None else F.lit(v) for v in weights or reach]

    def joined(parts: list[Column], entries: Callable[[Column, Column, Callable], Column], scaled: Callable[[Column, Column], Column]) -> Column:
        parts = [p if c is None else scaled(p, c) for p, c in zip(parts, weigh, strict=True)]
        out = parts[0]
        for p in parts[1:]:
            out = entries(out, p, join)
        return out

    row_scaled = lambda r, c: F.transform(r, lambda v: v * c)
    along = lambda row: joined([_moved(row, g.w, i, F.lit(0.0)) for i in reach], F.zip_with, row_scaled)

    def across(rows: Column, empty: Column) -> Column:
        entries = lambda a, b, f: F.zip_with(a, b, lambda p, q: F.zip_with(p, q, f))
        return F.flatten(joined([_moved(rows, g.h, i, empty) for i in reach], entries, lambda rows, c: F.transform(rows, lambda r: row_scaled(r, c))))

    return bind(across, F.transform(rows_of(g), along), F.array_repeat(F.lit(0.0), g.w))


def lower(a: Column, b: Column) -> Column:
    return F.least(a, b)


def higher(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def box_sum(g: Grid, size: int) -> Column:
    return box(g, size, lambda a, b: a + b)


def smoothed(g: Grid, sigma: float = 1.0) -> Column:
    """Gaussian blur, zero outside; the kernel is cut at three deviations."""
    k = ceil(3 * sigma)
    weights = [exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return box(g, 2 * k + 1, lambda a, b: a + b, [v / sum(weights) for v in weights])


def padded(g: Grid, size: int) -> Column:
    """The grid in the middle of a size x size one, zero around (the odd row and column come last); as it is if it is as large already."""
    top, left = (F.floor((F.lit(size) - n) / 2).cast("int") for n in (g.h, g.w))
    return F.when((g.h >= size) & (g.w >= size), g.data).otherwise(cells(F.lit(size), F.lit(size), lambda y, x: g.near(y - top, x - left)))


def block_means(g: Grid, size: int) -> Column:
    """Means of size x size blocks (a rest at the edge is left out); an empty array for a smaller grid."""
    span = range(size)

    def block(y: Column, x: Column) -> Column:
        out = F.lit(0.0)
        for i in span:
            for j in span:
                out = out + g.inside(y * size + i, x * size + j)
        return out / (size * size)

    return cells(F.floor(g.h / size).cast("int"), F.floor(g.w / size).cast("int"), block)


def half_frequencies(h: Column, w: Column) -> tuple[Column, Column, Column]:
    """Frequencies along y, along x, and their distance from zero, for the half spectrum of a real h x w grid (cells in row-major order)."""
    width = F.floor(w / 2).cast("int") + 1
    along_y = lambda k: F.when(k * 2 < h, k).otherwise(k - h) / h
    fy = cells(h, width, lambda y, x: along_y(y))
    fx = cells(h, width, lambda y, x: x / w)
    f = cells(h, width, lambda y, x: F.sqrt(along_y(y) * along_y(y) + (x / w) * (x / w)))
    return fy, fx, f


def framed(data: Column, h: Column, w: Column, side: int) -> Column:
    """A packed grid in the middle of a square of zeros; of an odd difference the larger part follows. A grid whose width is `side` or more stays as it is."""
    above, before = (F.floor((F.lit(side) - n) / 2).cast("int") for n in (h, w))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    row = lambda i: F.concat(zeros(before), F.slice(data, (i * w + 1).cast("int"), w.cast("int")), zeros(side - w - before))
    inner = F.flatten(F.transform(F.sequence(F.lit(0), (h - 1).cast("int")), row))
    return F.when((w >= side) | (h > side), data).otherwise(F.concat(zeros(above * side), inner, zeros((side - h - above) * side)))


def gradient_energy(data: Column, w: Column) -> Column:
    """Sum of squared differences of neighbours, to the right and below; nothing beyond the borders."""
    n = F.size(data)
    right = lambda p: F.when((p + 1) % w != 0, F.get(data, p + 1) - F.get(data, p)).otherwise(F.lit(0.0))
    below = lambda p: F.when(p + w < n, F.get(data, (p + w).cast("int")) - F.get(data, p)).otherwise(F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, p: s + right(p) * right(p) + below(p) * below(p))
