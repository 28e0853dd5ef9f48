"""Measures of packed grids: row-local expressions over a grid's array, no shuffle and no exploded cells.

A kernel turns a grid into a struct of doubles, in built-in functions. Fourier
transforms, singular values, eigenvalues and component labels have no built-in
form: `transformed` computes them in batches of rows and hands on plain arrays,
which kernels read like any other column. Grids of any size may share a table; a
null, empty or misshaped grid has nulls, and so has a measure that needs a larger
grid than it gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridstat.functions import grids as A
from gridstat.functions.grids import EPS, Grid, bind, on
from gridstat.operators.components import sizes_of

Transforms = dict[str, Column]


@dataclass(frozen=True)
class Kernel:
    """Names of measures, the struct that holds them, the transforms it reads, and columns to be made before, each layer from those before it."""

    columns: list[str]
    of: Callable[[Grid, Transforms], Column]
    needs: dict[str, tuple[str, Callable[[Grid], Column]]] = field(default_factory=dict)
    layers: list[dict[str, Callable[[Grid, Transforms], Column]]] = field(default_factory=list)


def _struct(**values: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def _square(v: Column) -> Column:
    return v * v


# --- transforms


def _flat(x: np.ndarray) -> list[list[float]]:
    return x.reshape(len(x), -1).tolist()


#: Over a batch of grids (grids, h, w): an array of doubles for each.
TRANSFORMS: dict[str, Callable[[np.ndarray], list[list[float]]]] = {
    "power": lambda x: _flat(np.abs(np.fft.rfft2(x, norm="ortho")) ** 2),
    "full_power": lambda x: _flat(np.abs(np.fft.fft2(x)) ** 2),
    "autocovariance": lambda x: _flat(np.fft.ifft2(np.abs(np.fft.fft2(x - x.mean(axis=(1, 2), keepdims=True))) ** 2).real),
    "row_spectra": lambda x: _flat(np.fft.rfft(x, axis=2).view(np.float64)),
    "singular_values": lambda x: np.linalg.svd(x, compute_uv=False).tolist(),
    "eigenvalues": lambda x: np.linalg.eigvalsh(x)[:, ::-1].tolist(),
    "component_sizes": lambda x: [sizes_of(mask > 0) for mask in x],
}


def transformed(df: DataFrame, needs: dict[str, tuple[str, Callable[[Grid], Column]]]) -> DataFrame:
    """df (key, h, w, data) with a column for each need: a transform of a grid made of that row."""
    if not needs:
        return df
    g = Grid(F.col("h"), F.col("w"), F.col("data"))
    given = df.select("*", *[F.when(F.col("data").isNotNull(), of(g)).alias(f"of_{name}") for name, (_, of) in needs.items()])
    kept, kinds = df.columns, {name: kind for name, (kind, _) in needs.items()}
    schema = df.schema
    for name in needs:
        schema = schema.add(name, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, kind in kinds.items():
                found: list[list[float] | None] = [None] * batch.num_rows
                shapes: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}
                for i, one in enumerate(batch.column(batch.schema.get_field_index(f"of_{name}")).to_pylist()):
                    if one is not None and one["data"] and None not in one["data"] and np.isfinite(one["data"]).all():
                        shapes.setdefault((one["h"], one["w"]), []).append((i, one["data"]))
                for (h, w), rows in shapes.items():
                    for (i, _), values in zip(rows, TRANSFORMS[kind](np.array([d for _, d in rows]).reshape(-1, h, w)), strict=True):
                        found[i] = values
                made.append(pa.array(found, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *kinds])

    return given.mapInArrow(run, schema)


def _whole(g: Grid) -> Column:
    return _grid(g.h, g.w, g.data)


def _grid(h: Column, w: Column, data: Column) -> Column:
    return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), data.alias("data"))


POWER = {"power": ("power", _whole)}


def checked(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, h, w, data): keys in a struct; data null unless they are h x w values."""
    h, w, data = F.col("h").cast("int"), F.col("w").cast("int"), F.col("data").cast("array<double>")
    good = (h > 0) & (w > 0) & (F.size(data) == h * w) & ~F.exists(data, lambda v: v.isNull())
    return df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), h.alias("h"), w.alias("w"), F.when(good, data).alias("data"))


def measure(df: DataFrame, keys: list[str], kernels: Kernel | list[tuple[str, Kernel]]) -> DataFrame:
    """keys and the measures of each grid (h, w, data); of several kernels, each named by a prefix and the measure."""
    named = [("", kernels)] if isinstance(kernels, Kernel) else kernels
    needs = {name: need for _, k in named for name, need in k.needs.items()}
    have = transformed(checked(df, keys), needs)
    g, good = Grid(F.col("h"), F.col("w"), F.col("data")), F.col("data").isNotNull()
    known = [{name: F.col(name) for name in k.needs} for _, k in named]
    for depth in range(max((len(k.layers) for _, k in named), default=0)):
        layer = {}
        for i, (_, k) in enumerate(named):
            for name, step in (k.layers[depth] if depth < len(k.layers) else {}).items():
                layer[f"k{i}_{name}"] = F.when(good, step(g, known[i]))
        have = have.select("*", *[c.alias(name) for name, c in layer.items()])
        for i, (_, k) in enumerate(named):
            known[i] |= {name: F.col(f"k{i}_{name}") for name in (k.layers[depth] if depth < len(k.layers) else {})}
    made = [F.when(good, on(g.h, g.w, g.data, lambda q, k=k, own=known[i]: k.of(q, own))).alias(f"k{i}") for i, (_, k) in enumerate(named)]
    out = have.select("key", *made)
    return out.select("key.*", *[F.col(f"k{i}.{c}").alias(f"{p}{c}") for i, (p, k) in enumerate(named) for c in k.columns])


# --- stencils


def _gradients(g: Grid, t: Transforms) -> Column:
    gx = g.cells(lambda y, x: (g.around(y, x + 1) - g.around(y, x - 1)) / 2)
    gy = g.cells(lambda y, x: (g.around(y + 1, x) - g.around(y - 1, x)) / 2)
    lap = g.cells(lambda y, x: g.around(y + 1, x) + g.around(y - 1, x) + g.around(y, x + 1) + g.around(y, x - 1) - g.inside(y, x) * 4)

    def of(gx: Column, gy: Column, lap: Column, m: Column) -> Column:
        def out(ax: Column, ay: Column, mm: Column, sm: Column, top: Column) -> Column:
            return _struct(
                gradient_x=ax, gradient_y=ay, gradient_magnitude=mm, gradient_anisotropy=ax / (ay + EPS), laplacian=A.mean_of(lap, F.abs), laplacian_energy=A.mean_of(lap, _square),
                gradient_saturation=A.share_of(m, lambda v: v < top * 0.05), gradient_kurtosis=A.mean_of(m, lambda v: _square(_square((v - mm) / sm))) - 3,
                gradient_energy=A.sum_of(m, _square),
            )

        return bind(out, A.mean_of(gx, F.abs), A.mean_of(gy, F.abs), A.mean(m), F.greatest(A.deviation(m), F.lit(1e-12)), F.array_max(m))

    return bind(lambda gx, gy, lap: bind(lambda m: of(gx, gy, lap, m), F.zip_with(gx, gy, lambda a, b: F.sqrt(a * a + b * b))), gx, gy, lap)


#: Periodic central differences and the five-point Laplacian.
GRADIENTS = Kernel(
    ["gradient_x", "gradient_y", "gradient_magnitude", "gradient_anisotropy", "laplacian", "laplacian_energy", "gradient_saturation", "gradient_kurtosis", "gradient_energy"],
    _gradients,
)


def sobel(g: Grid) -> Column:
    """Magnitude of the Sobel gradient, zero outside."""

    def at(y: Column, x: Column) -> Column:
        near = {(i, j): g.near(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        gx = near[-1, 1] - near[-1, -1] + (near[0, 1] - near[0, -1]) * 2 + near[1, 1] - near[1, -1]
        gy = near[1, -1] - near[-1, -1] + (near[1, 0] - near[-1, 0]) * 2 + near[1, 1] - near[-1, 1]
        return bind(lambda a, b: F.sqrt(a * a + b * b), gx, gy)

    return g.cells(at)


EDGES = Kernel(
    ["edge_mean", "edge_std", "edge_density"],
    lambda g, t: bind(
        lambda m: bind(lambda a, d: _struct(edge_mean=a, edge_std=d, edge_density=A.share_of(m, lambda v: v > a + d)), A.mean(m), A.deviation(m)), sobel(g)
    ),
)
INITIAL_MORPHOLOGY = Kernel(
    ["density", "radial_gradient"],
    lambda g, t: bind(lambda m: _struct(density=A.share_of(g.data, lambda v: v > m), radial_gradient=A.mean(sobel(g))), A.mean(g.data)),
)


def total_variation(g: Grid) -> Column:
    """Sum of the absolute differences of neighbours, down and across."""
    rest = (g.h - 1) * g.w
    down = F.zip_with(F.slice(g.data, g.w + 1, rest), F.slice(g.data, F.lit(1), rest), lambda a, b: F.abs(a - b))
    across = A.cells(g.h, g.w - 1, lambda y, x: F.abs(g.inside(y, x + 1) - g.inside(y, x)))
    return A.total(down) + A.total(across)


TOTAL_VARIATION = Kernel(["total_variation"], lambda g, t: _struct(total_variation=total_variation(g)))


def glcm(levels: int = 8) -> Kernel:
    """Horizontal co-occurrence of equal levels: contrast, homogeneity, energy, correlation."""

    def of(g: Grid, t: Transforms) -> Column:
        level = bind(
            lambda lo, hi: F.transform(g.data, lambda v: F.floor((v - lo) / (hi - lo + EPS) * (levels - 1)).cast("double")), F.array_min(g.data), F.array_max(g.data)
        )

        def pairs(q: Grid) -> Column:
            first, second = (A.cells(q.h, q.w - 1, lambda y, x, k=k: q.inside(y, x + k)) for k in (0, 1))
            return bind(measures, first, second)

        def measures(i: Column, j: Column) -> Column:
            off = F.zip_with(i, j, lambda a, b: F.abs(a - b))
            both = F.zip_with(i, j, lambda a, b: a * levels + b)
            n = F.size(i)
            return bind(
                lambda d, ci, cj: _struct(
                    contrast=A.mean_of(d, _square), homogeneity=A.mean_of(d, lambda v: 1 / (v + 1)), energy=F.try_divide(A.squared_counts(both), n * n),
                    correlation=F.try_divide(A.dot(ci, cj), n) / (F.sqrt(A.mean_of(ci, _square) * A.mean_of(cj, _square)) + EPS),
                ),
                off, A.centred(i), A.centred(j),
            )

        return on(g.h, g.w, level, pairs)

    return Kernel(["contrast", "homogeneity", "energy", "correlation"], of)


GLCM = glcm()


def _image_moments(g: Grid, t: Transforms) -> Column:
    def of(m: Column) -> Column:
        def out(mass: Column, cy: Column, cx: Column) -> Column:
            n20, n02 = (m["xx"] - cx * m["x"] * 2 + cx * cx * m["s"]) / (mass * mass), (m["yy"] - cy * m["y"] * 2 + cy * cy * m["s"]) / (mass * mass)
            n11 = (m["yx"] - cy * m["x"] - cx * m["y"] + cy * cx * m["s"]) / (mass * mass)
            return bind(lambda a, b, d: _struct(centroid_y=cy, centroid_x=cx, log_hu1=F.log(F.abs(a + b) + EPS), hu2=_square(a - b) + d * d * 4), n20, n02, n11)

        return bind(lambda mass: bind(lambda cy, cx: out(mass, cy, cx), m["y"] / mass, m["x"] / mass), m["s"] + EPS)

    own = bind(lambda lo: F.transform(g.data, lambda v: v - lo), F.array_min(g.data))
    return bind(of, on(g.h, g.w, own, A.moments))


#: Centroid and the first two Hu invariants (log magnitude of the first) of the grid's own range from zero.
IMAGE_MOMENTS = Kernel(["centroid_y", "centroid_x", "log_hu1", "hu2"], _image_moments)


def _shape_descriptors(g: Grid, t: Transforms) -> Column:
    def of(area: Column, perimeter: Column, m: Column) -> Column:
        n = m["s"] + EPS
        cy, cx = m["y"] / n, m["x"] / n
        a, c = (m["yy"] - cy * m["y"] * 2 + cy * cy * m["s"]) / n, (m["xx"] - cx * m["x"] * 2 + cx * cx * m["s"]) / n
        d = (m["yx"] - cy * m["x"] - cx * m["y"] + cy * cx * m["s"]) / n

        def out(a: Column, c: Column, d: Column) -> Column:
            root = F.sqrt(_square(a - c) + d * d * 4)
            l1, l2 = (a + c + root) / 2, (a + c - root) / 2
            return _struct(
                area=area, perimeter=perimeter, circularity=area * 4 * pi / (perimeter * perimeter + EPS),
                eccentricity=F.sqrt(F.greatest(F.lit(0.0), 1 - F.greatest(l2, F.lit(0.0)) / (l1 + EPS))), solidity=area / F.greatest(area, F.lit(0.1)), extent=area,
            )

        return bind(out, a, c, d)

    mask = bind(lambda m: F.transform(g.data, lambda v: F.when(v > m, F.lit(1.0)).otherwise(F.lit(0.0))), A.mean(g.data))
    return on(g.h, g.w, mask, lambda b: bind(of, A.mean(b.data), total_variation(b) / b.n, A.moments(b)))


#: Area, perimeter, circularity and eccentricity of the cells above the mean (solidity and extent by area alone).
SHAPE_DESCRIPTORS = Kernel(["area", "perimeter", "circularity", "eccentricity", "solidity", "extent"], _shape_descriptors)


def haar(levels: int = 4) -> Kernel:
    """Energy, mean magnitude and deviation of the details at each level of a Haar transform; null where a side isn't even."""
    names = ("energy", "mean", "std")

    def quarter(g: Grid, signs: tuple[int, int, int]) -> Column:
        """Half the signed sum of each block of four cells."""

        def block(y: Column, x: Column) -> Column:
            out = g.inside(y * 2, x * 2)
            for sign, (i, j) in zip(signs, ((0, 1), (1, 0), (1, 1)), strict=True):
                v = g.inside(y * 2 + i, x * 2 + j)
                out = out + v if sign > 0 else out - v
            return out / 2

        return A.cells(F.floor(g.h / 2).cast("int"), F.floor(g.w / 2).cast("int"), block)

    def level(g: Grid, t: Transforms, k: int, body: Callable[[Grid], Column]) -> Column:
        """body of the low-passed grid before level k, if its sides are even."""
        n = 2 ** (k - 1)
        data = g.data if k == 1 else t[f"low_{k - 1}"]
        return F.when((g.h % (2 * n) == 0) & (g.w % (2 * n) == 0), on((g.h / n).cast("int"), (g.w / n).cast("int"), data, body))

    def details(q: Grid) -> Column:
        every = F.concat(quarter(q, (-1, 1, -1)), quarter(q, (1, -1, -1)), quarter(q, (-1, -1, 1)))
        return bind(lambda v: _struct(energy=A.mean_of(v, _square), mean=A.mean_of(v, F.abs), std=A.deviation(v)), every)

    def layer(k: int) -> dict:
        own = {f"details_{k}": lambda g, t: level(g, t, k, details)}
        return own if k == levels else own | {f"low_{k}": lambda g, t: level(g, t, k, lambda q: quarter(q, (1, 1, 1)))}

    return Kernel(
        [f"{n}_{k}" for k in range(1, levels + 1) for n in names], lambda g, t: _struct(**{f"{n}_{k}": t[f"details_{k}"][n] for k in range(1, levels + 1) for n in names}), {},
        [layer(k) for k in range(1, levels + 1)],
    )


def _moran(g: Grid, t: Transforms) -> Column:
    def of(z: Grid) -> Column:
        near = lambda y, x: (z.near(y + 1, x) + z.near(y - 1, x) + z.near(y, x + 1) + z.near(y, x - 1)) / 4
        return _struct(moran_i=A.total(z.cells(lambda y, x: z.inside(y, x) * near(y, x))) / (A.sum_of(z.data, _square) + EPS))

    return on(g.h, g.w, A.centred(g.data), of)


#: Moran's I with the mean of four neighbours, zero outside.
MORAN = Kernel(["moran_i"], _moran)


def _centroid_distance(g: Grid, t: Transforms) -> Column:
    def of(m: Column) -> Column:
        dy, dx = m["y"] / (m["s"] + EPS) - (g.h - 1) / 2, m["x"] / (m["s"] + EPS) - (g.w - 1) / 2
        return _struct(centroid_distance=F.sqrt(dy * dy + dx * dx) / (F.sqrt((g.h * g.h + g.w * g.w).cast("double")) / 2))

    return bind(of, on(g.h, g.w, F.transform(g.data, F.abs), A.moments))


#: Distance of the centroid of magnitudes from the middle, relative to half the diagonal.
CENTROID_DISTANCE = Kernel(["centroid_distance"], _centroid_distance)


def information(patch: int = 8, stride: int = 4) -> Kernel:
    """Binary transitions in row-major order, correlation with the next column (periodic), variance of patch variances."""

    def of(g: Grid, t: Transforms) -> Column:
        above = bind(lambda m: F.transform(g.data, lambda v: v > m), A.median(g.data))
        changes = bind(lambda b: F.zip_with(F.slice(b, F.lit(2), g.n - 1), F.slice(b, F.lit(1), g.n - 1), lambda p, q: F.when(p != q, F.lit(1.0)).otherwise(F.lit(0.0))), above)
        following = g.cells(lambda y, x: g.around(y, x + 1))
        rows, columns = ((F.floor((n - patch) / stride) + 1).cast("int") for n in (g.h, g.w))
        values = lambda i, j: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda k: F.slice(g.data, (i * stride + k) * g.w + j * stride + 1, F.lit(patch))))
        return _struct(
            lz_complexity=A.total(changes) / g.n, predictability=F.coalesce(F.abs(A.correlation(g.data, following)), F.lit(0.0)),
            local_variance=bind(A.variance, A.cells(rows, columns, lambda i, j: bind(A.variance, values(i, j)))),
        )

    return Kernel(["lz_complexity", "predictability", "local_variance"], of)


def _symmetry(g: Grid, t: Transforms) -> Column:
    last = g.h - 1
    turns = [g.cells(lambda y, x: g.inside(x, last - y)), F.reverse(g.data), g.cells(lambda y, x: g.inside(last - x, y))]
    same = [F.coalesce(F.abs(A.correlation(g.data, q)), F.lit(0.0)) for q in turns]
    return _struct(symmetry=F.when(g.h == g.w, (same[0] + same[1] + same[2]) / 3))


#: Mean absolute correlation with the grid turned by 90, 180 and 270 degrees (square grids).
SYMMETRY = Kernel(["symmetry"], _symmetry)


#: Correlation of each cell with the mean of its 3 x 3 box (zero outside).
CLUSTERING = Kernel(["clustering"], lambda g, t: _struct(clustering=F.coalesce(A.correlation(g.data, F.transform(A.box_sum(g, 3), lambda v: v / 9)), F.lit(0.0))))


# --- spectra


def _no_constant(p: Column) -> Column:
    """Power without that of the constant."""
    return F.transform(p, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v))


def _share(p: Column, f: Column, inside: Callable[[Column], Column]) -> Column:
    return A.total(F.zip_with(p, f, lambda v, x: F.when(inside(x), v).otherwise(F.lit(0.0))))


def _spectral(g: Grid, t: Transforms) -> Column:
    p = t["power"]

    def of(fy: Column, fx: Column, f: Column, whole: Column, others: Column) -> Column:
        weigh = lambda q: A.dot(p, q) / (whole + EPS)
        fall = F.aggregate(
            F.reverse(F.array_sort(p)), F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")),
            lambda s, v: F.struct((s["c"] + v).alias("c"), (s["n"] + F.when(F.try_divide(s["c"] + v, whole) < 0.85, 1).otherwise(0)).alias("n")),
        )
        center = weigh(f)
        return _struct(
            centroid_y=weigh(F.transform(fy, F.abs)), centroid_x=weigh(fx), centroid=center,
            bandwidth=bind(lambda c: F.sqrt(F.greatest(weigh(F.transform(f, _square)) - c * c, F.lit(0.0))), center),
            flatness=F.exp(A.mean_of(p, lambda v: F.log(v + 1e-10))) / (A.mean(p) + 1e-10), rolloff=(fall["n"] + 1) / F.size(p),
            low=_share(p, f, lambda x: x < 0.15) / (whole + EPS), mid=_share(p, f, lambda x: (x >= 0.15) & (x < 0.35)) / (whole + EPS), high=_share(p, f, lambda x: x >= 0.35) / (whole + EPS),
            dominant=F.get(f, A.first_place(others, F.array_max(others))), anisotropy=A.dot(p, F.transform(fy, F.abs)) / (A.dot(p, fx) + EPS), total_power=whole,
        )

    return bind(of, *A.half_frequencies(g.h, g.w), A.total(p), _no_constant(p))


#: Centroids, bandwidth, flatness, roll-off, band shares, dominant frequency and anisotropy of the power spectrum.
SPECTRAL = Kernel(
    ["centroid_y", "centroid_x", "centroid", "bandwidth", "flatness", "rolloff", "low", "mid", "high", "dominant", "anisotropy", "total_power"], _spectral, POWER
)
SPECTRAL_ENTROPY = Kernel(["spectral_entropy"], lambda g, t: _struct(spectral_entropy=F.least(A.entropy(t["power"]), F.lit(10.0))), POWER)
#: Shares of power below, within and above given frequencies.
BANDS = Kernel(
    ["low", "mid", "high"],
    lambda g, t: bind(
        lambda f, whole: _struct(
            low=F.try_divide(_share(t["power"], f, lambda x: x < 0.05), whole), mid=F.try_divide(_share(t["power"], f, lambda x: (x >= 0.05) & (x < 0.15)), whole),
            high=F.try_divide(_share(t["power"], f, lambda x: x >= 0.15), whole),
        ),
        A.half_frequencies(g.h, g.w)[2], A.total(t["power"]),
    ),
    POWER,
)


def radial_bands(bands: int = 4) -> Kernel:
    """Mean, largest and deviation of power in rings whose radii grow with the square root."""

    def of(g: Grid, t: Transforms) -> Column:
        def ring(f: Column, top: Column, k: int) -> Column:
            lo, hi = top * (k / bands) ** 0.5, top * ((k + 1) / bands) ** 0.5
            inside = lambda x: (x >= lo) & ((x <= hi) if k == bands - 1 else (x < hi))
            values = F.filter(t["power"], lambda v, i: inside(F.get(f, i)))
            return bind(lambda r: _struct(mean=A.mean(r), max=F.array_max(r), std=A.deviation(r, 0)), values)

        def rings(f: Column, top: Column) -> Column:
            every = [ring(f, top, k) for k in range(bands)]
            return bind(lambda *held: _struct(**{f"{n}_{k}": held[k][n] for k in range(bands) for n in ("mean", "max", "std")}), *every)

        return bind(lambda f: bind(lambda top: rings(f, top), F.array_max(f) + 1e-12), A.half_frequencies(g.h, g.w)[2])

    return Kernel([f"{n}_{k}" for k in range(bands) for n in ("mean", "max", "std")], of, POWER)


def _harmonics(g: Grid, t: Transforms) -> Column:
    def of(f: Column, p: Column, place: Column) -> Column:
        def out(f0: Column, p0: Column) -> Column:
            near = lambda k: _share(p, f, lambda x: F.abs(x - f0 * k) <= f0 * (0.1 * k))
            return bind(
                lambda h2, h3: _struct(second=h2 / (p0 + EPS), third=h3 / (p0 + EPS), distortion=F.sqrt(h2 + h3) / (F.sqrt(p0) + EPS), purity=p0 / (A.total(p) + EPS)), near(2), near(3)
            )

        return bind(out, F.get(f, place), F.get(p, place))

    others = _no_constant(t["power"])
    return bind(lambda f, p: bind(lambda place: of(f, p, place), A.first_place(p, F.array_max(p))), A.half_frequencies(g.h, g.w)[2], others)


#: Power near twice and three times the dominant frequency relative to it, distortion and purity.
HARMONICS = Kernel(["second", "third", "distortion", "purity"], _harmonics, POWER)


def _power_law(g: Grid, t: Transforms) -> Column:
    p, rest = t["power"], F.size(t["power"]) - 1
    u = F.transform(F.slice(A.half_frequencies(g.h, g.w)[2], F.lit(2), rest), lambda x: F.log(x))
    v = F.transform(F.slice(p, F.lit(2), rest), lambda x: F.log(x + EPS))
    slope = bind(lambda u, v: bind(lambda c: F.try_divide(A.dot(v, c), A.sum_of(c, _square)), A.centred(u)), u, v)
    index = F.transform(p, lambda v, i: v * i)
    # Two frequencies may mirror each other: the first that is as strong, but for rounding.
    strongest = bind(lambda top: A.first_place(F.transform(p, lambda v: v >= top), F.lit(True)), F.array_max(p) * (1 - 1e-9))
    return _struct(
        power_law=F.greatest(F.least(-slope, F.lit(5.0)), F.lit(-5.0)), dominant_index=strongest / F.size(p), index_centroid=A.total(index) / (A.total(p) + EPS) / F.size(p)
    )


#: Minus the slope of log power over log frequency, held within five; flat-index dominant and centroid.
POWER_LAW = Kernel(["power_law", "dominant_index", "index_centroid"], _power_law, POWER)


def entropies(scales: tuple[int, ...] = (2, 4, 8)) -> Kernel:
    """Entropies of spectra (of the grid, of its cells as one line, of block means), and an autocorrelation's ratio over all cells."""

    def of(g: Grid, t: Transforms) -> Column:
        def ratio(z: Column) -> Column:
            at = lambda k: F.abs(A.dot(F.slice(z, F.lit(k + 1), F.greatest(g.n - k, F.lit(0))), F.slice(z, F.lit(1), F.greatest(g.n - k, F.lit(0)))) / (A.sum_of(z, _square) + EPS)) + EPS
            return -F.log(at(3) / at(2))

        line = F.transform(t["line"], lambda v: v * g.n)
        return _struct(
            spectral_entropy=F.least(A.entropy(t["power"]), F.lit(10.0)), line_entropy=bind(A.entropy, line), acf_entropy=bind(ratio, A.centred(g.data)),
            **{f"multiscale_{s}": A.entropy(t[f"blocks_{s}"]) for s in scales},
        )

    needs = POWER | {"line": ("power", lambda g: _grid(F.lit(1), g.n, A.centred(g.data)))}
    for s in scales:
        needs[f"blocks_{s}"] = ("power", lambda g, s=s: _grid(F.floor(g.h / s), F.floor(g.w / s), A.block_means(g, s)))
    return Kernel(["spectral_entropy", "line_entropy", "acf_entropy", *(f"multiscale_{s}" for s in scales)], of, needs)


def _ranks(g: Grid, t: Transforms) -> Column:
    s = t["singular"]

    def of(e: Column, whole: Column) -> Column:
        k = F.size(e)
        need = F.aggregate(
            e, F.struct(F.lit(0.0).alias("c"), F.lit(1).alias("n")),
            lambda a, v: F.struct((a["c"] + v).alias("c"), (a["n"] + F.when((a["c"] + v) / (whole + EPS) < 0.9, 1).otherwise(0)).alias("n")),
        )["n"]
        return _struct(
            svd_entropy=A.entropy(s), participation_ratio=whole * whole / (A.sum_of(e, _square) + EPS) / k, components_90=need / k,
            rank_ratio=A.share_of(s, lambda v: v > F.get(s, F.lit(0)) * 1e-3),
        )

    return bind(lambda e: bind(lambda whole: of(e, whole), A.total(e)), F.transform(s, _square))


#: Entropy, participation and compressibility of singular values.
RANKS = Kernel(["svd_entropy", "participation_ratio", "components_90", "rank_ratio"], _ranks, {"singular": ("singular_values", _whole)})


def _correlation_structure(g: Grid, t: Transforms) -> Column:
    def near(n: Column, k: Column) -> Column:
        return F.least(k, n - k)

    radius = g.cells(lambda y, x: F.rint(F.sqrt((near(g.h, y) * near(g.h, y) + near(g.w, x) * near(g.w, x)).cast("double"))))

    def of(radius: Column, acf: Column) -> Column:
        ring = lambda values: (lambda k: bind(A.mean, F.filter(values, lambda v, i: F.get(radius, i) == k)))
        radii = F.sequence(F.lit(0), F.array_max(radius).cast("int"))
        lag, power = F.transform(radii, ring(acf)), F.transform(F.slice(radii, F.lit(2), F.size(radii)), ring(t["full"]))

        def out(lag: Column, s: Column, top: Column) -> Column:
            below = A.first_place(F.transform(lag, lambda v: v < exp(-1)), F.lit(True))
            return _struct(
                correlation_length=F.when(below >= 0, below).otherwise(F.size(lag)), axis_ratio=(F.abs(F.get(acf, F.when(g.h > 1, g.w))) + EPS) / (F.abs(F.get(acf, F.when(g.w > 1, F.lit(1)))) + EPS),
                structure_peak=A.first_place(s, top) + 1, structure_value=top, structure_width=A.sum_of(s, lambda v: F.when(v >= top / 2, F.lit(1.0)).otherwise(F.lit(0.0))),
                structure_integral=A.total(s),
            )

        return bind(lambda lag, s: bind(lambda top: out(lag, s, top), F.array_max(s)), lag, power)

    scaled = bind(lambda c: F.transform(t["autocovariance"], lambda v: v / (c + EPS)), F.get(t["autocovariance"], F.lit(0)))
    return bind(of, radius, scaled)


#: Radial autocorrelation (periodic): radius below 1/e, ratio of the axes; the structure factor's peak, place and width.
CORRELATION_STRUCTURE = Kernel(
    ["correlation_length", "axis_ratio", "structure_peak", "structure_value", "structure_width", "structure_integral"], _correlation_structure,
    {"autocovariance": ("autocovariance", _whole), "full": ("full_power", lambda g: _grid(g.h, g.w, A.centred(g.data)))},
)


# --- scales


def norms_by_scale(g: Grid, t: Transforms) -> Column:
    norm = lambda a: F.sqrt(A.sum_of(a, _square) + EPS)
    return bind(lambda low: _struct(raw=norm(g.data), low=norm(low), high=norm(F.zip_with(g.data, low, lambda a, b: a - b))), A.smoothed(g))


#: L2 norms of the grid, of its low-passed form and of the rest.
NORMS_BY_SCALE = Kernel(["raw", "low", "high"], norms_by_scale)


def scales(levels: int = 4) -> Kernel:
    """Energies of the low-passed grid and of the rest, and of a Laplacian pyramid with its contrast."""

    def side(n: Column, k: int) -> Column:
        return F.ceil(n / 2**k).cast("int")

    def before(g: Grid, t: Transforms, k: int, body: Callable[[Grid], Column]) -> Column:
        """body of the grid before level k, if it has more than a row and a column."""
        h, w = side(g.h, k - 1), side(g.w, k - 1)
        return F.when((h > 1) & (w > 1), on(h, w, g.data if k == 1 else t[f"small_{k - 1}"], body))

    def thinned(g: Grid, t: Transforms, k: int) -> Column:
        w = side(g.w, k - 1)
        low = t["low"] if k == 1 else t[f"low_{k}"]
        return F.when((side(g.h, k - 1) > 1) & (w > 1), bind(lambda v, w: A.cells(side(g.h, k), side(g.w, k), lambda y, x: F.get(v, (y * 2 * w + x * 2).cast("int"))), low, w))

    def rest(g: Grid, t: Transforms, k: int) -> Column:
        def of(q: Grid) -> Column:
            return on(side(q.h, 1), side(q.w, 1), t[f"small_{k}"], lambda small: q.cells(lambda y, x: q.inside(y, x) - small.inside(F.floor(y / 2), F.floor(x / 2))))

        return bind(lambda r: _struct(energy=A.mean_of(r, _square), contrast=A.deviation(r)), before(g, t, k, of))

    def small_and_rest(k: int) -> list[dict]:
        following = {} if k == levels else {f"low_{k + 1}": lambda g, t: before(g, t, k + 1, A.smoothed)}
        return [{f"small_{k}": lambda g, t: thinned(g, t, k)}, {f"rest_{k}": lambda g, t: rest(g, t, k)} | following]

    def out(g: Grid, t: Transforms) -> Column:
        high = F.zip_with(g.data, t["low"], lambda a, b: a - b)
        pyramid = {f"pyramid_{n}_{k}": t[f"rest_{k}"][n] for k in range(1, levels + 1) for n in ("energy", "contrast")}
        return _struct(low_energy=A.sum_of(t["low"], _square), high_energy=A.sum_of(high, _square), **pyramid)

    return Kernel(
        ["low_energy", "high_energy", *(f"pyramid_{n}_{k}" for k in range(1, levels + 1) for n in ("energy", "contrast"))], out, {},
        [{"low": lambda g, t: A.smoothed(g)}, *(layer for k in range(1, levels + 1) for layer in small_and_rest(k))],
    )


# --- shapes


def _above(data: Column, cut: Column) -> Column:
    return bind(lambda c: F.transform(data, lambda v: F.when(v > c, F.lit(1.0)).otherwise(F.lit(0.0))), cut)


def _components(g: Grid, t: Transforms) -> Column:
    s = t["sizes"]
    some = lambda v: F.when(F.size(s) > 0, v).otherwise(F.lit(0.0))
    return _struct(components=F.size(s), largest=some(F.array_max(s) / g.n), mean_size=some(A.mean(s) / g.n), std_size=some(A.deviation(s, 0) / g.n))


#: Number, largest, mean and deviation of the sizes of components above the median plus half a deviation.
COMPONENTS = Kernel(
    ["components", "largest", "mean_size", "std_size"], _components,
    {"sizes": ("component_sizes", lambda g: _grid(g.h, g.w, _above(g.data, A.median(g.data) + F.coalesce(A.deviation(g.data), F.lit(0.0)) / 2)))},
)


def granulometry(widths: tuple[int, ...] = (3, 5, 7, 9)) -> Kernel:
    """Share of the area above the mean that openings of growing width take away: mean and deviation of that width."""

    def of(g: Grid, t: Transforms) -> Column:
        def opened(b: Grid, k: int) -> Column:
            return A.total(on(b.h, b.w, A.box(b, k, A.lower), lambda e: A.box(e, k, A.higher)))

        def lost(*areas: Column) -> Column:
            return F.array(*[F.greatest(a - c, F.lit(0.0)) for a, c in zip(areas, areas[1:], strict=False)])

        sizes = F.array(*[F.lit(float(k)) for k in widths])

        def out(lost: Column) -> Column:
            whole = A.total(lost) + EPS
            return bind(
                lambda m: _struct(size_mean=m, size_std=F.sqrt(F.greatest(A.total(F.zip_with(lost, sizes, lambda a, k: a * k * k)) / whole - m * m, F.lit(0.0)))),
                A.dot(lost, sizes) / whole,
            )

        areas = lambda b: bind(lambda *a: bind(out, lost(*a)), A.total(b.data), *[opened(b, k) for k in widths])
        return on(g.h, g.w, _above(g.data, A.mean(g.data)), areas)

    return Kernel(["size_mean", "size_std"], of)


def _clusters(g: Grid, t: Transforms) -> Column:
    def of(b: Grid) -> Column:
        def peaks(inner: Column, x: Grid) -> Column:
            highest = A.box(x, 3, A.higher)
            return A.total(F.zip_with(inner, F.zip_with(x.data, highest, lambda a, c: a >= c), lambda i, p: F.when((i > 0) & p, F.lit(1.0)).otherwise(F.lit(0.0))))

        found = bind(lambda inner: on(g.h, g.w, F.zip_with(g.data, inner, lambda a, i: a * i), lambda x: peaks(inner, x)), A.box(b, 3, A.lower))
        wide = A.total(A.box(b, 11, A.higher))
        return _struct(clusters=F.log1p(found), largest_fraction=F.least(wide / (A.total(b.data) + EPS), F.lit(1.0)))

    return on(g.h, g.w, _above(g.data, A.median(g.data)), of)


#: log1p of the number of local maxima of the eroded median mask, and the dilated share of area (held at 1).
CLUSTERS = Kernel(["clusters", "largest_fraction"], _clusters)


# --- channels: a grid's values in equal parts


def _channel(g: Grid, k: Column | int, channels: int) -> Column:
    n = F.floor(g.n / channels).cast("int")
    return F.slice(g.data, n * k + 1, n)


def channel_eigen(channels: int = 4) -> Kernel:
    """Eigenvalues of the correlation of a grid's channels: largest two, trace, condition, participation."""

    def matrix(g: Grid) -> Column:
        def one(k: Column) -> Column:
            return bind(lambda c: bind(lambda s: F.transform(A.centred(c), lambda v: v / s), A.deviation(c) + EPS), _channel(g, k, channels))

        def products(z: Column) -> Column:
            return A.cells(F.lit(channels), F.lit(channels), lambda i, j: A.dot(F.get(z, i), F.get(z, j)) / (g.n / channels))

        values = bind(products, F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), one))
        return F.when(g.n % channels == 0, _grid(F.lit(channels), F.lit(channels), values))

    def of(g: Grid, t: Transforms) -> Column:
        e = t["eigen"]
        at = lambda k: F.get(e, F.lit(k))
        whole = A.total(e)
        return _struct(
            eigen_1=at(0), eigen_2=at(1), trace=whole, condition=F.abs(at(0)) / (F.abs(at(channels - 1)) + EPS), participation=whole * whole / (A.sum_of(e, _square) + EPS)
        )

    return Kernel(["eigen_1", "eigen_2", "trace", "condition", "participation"], of, {"eigen": ("eigenvalues", matrix)})


def _norm_of(part: Callable[[Column, int], Column]) -> Callable[[Column], Column]:
    return lambda k: part(k, 0) * part(k, 0) + part(k, 1) * part(k, 1)


def coherence(channels: int = 4) -> Kernel:
    """Cross-spectral coherence of neighbouring channels, averaged over pairs of frequencies, and its largest place."""

    def of(g: Grid, t: Transforms) -> Column:
        rows, n = t["rows"], (F.floor(g.n / channels / 2) + 1).cast("int")
        part = lambda c, k, p: F.get(rows, ((n * c + k) * 2 + p).cast("int"))

        def at(c: int, k: Column) -> Column:
            def summed(f: Callable[[Column], Column]) -> Column:  # two frequencies: with one alone, coherence is one everywhere
                return f(k) + f(k + 1)

            a, b = (lambda k, p: part(c, k, p)), (lambda k, p: part(c + 1, k, p))
            real, imaginary = summed(lambda k: a(k, 0) * b(k, 0) + a(k, 1) * b(k, 1)), summed(lambda k: a(k, 1) * b(k, 0) - a(k, 0) * b(k, 1))
            own, other = (summed(_norm_of(v)) for v in (a, b))
            return bind(lambda r, i, o, p: (r * r + i * i) / (o * p + EPS), real, imaginary, own, other)

        places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        pairs = F.transform(places, lambda k: F.array(*[at(c, k) for c in range(channels - 1)]))

        def out(pairs: Column, by_place: Column) -> Column:
            every = F.flatten(pairs)
            return _struct(coherence_mean=A.mean(every), coherence_max=F.array_max(every), coherence_peak=A.first_place(by_place, F.array_max(by_place)))

        return bind(lambda p: bind(out, p, F.transform(p, A.mean)), pairs)

    rows = lambda g: F.when(g.n % channels == 0, _grid(F.lit(channels), g.n / channels, g.data))
    return Kernel(["coherence_mean", "coherence_max", "coherence_peak"], of, {"rows": ("row_spectra", rows)})
