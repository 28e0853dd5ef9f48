"""Queries of kernels over packed grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import descriptive as D
from gridstat.operators import components as T
from gridstat.operators import grid as G
from gridstat.plans.descriptive import rounded
from gridstat.plans.registry import query, r
from gridstat.sources import relations as R

_P = "p AS (SELECT vec_id AS sample_id, embedding, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i))"


def _at(dy: int, dx: int) -> str:
    """The value at a periodic neighbour."""
    return f"CAST(embedding[((y + {dy + 8}) % 8) * 8 + (x + {dx + 8}) % 8 + 1] AS DOUBLE)"


def _near(dy: int, dx: int, minus: str = "0") -> str:
    """The value at a neighbour, less something; zero outside."""
    return f"(CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN CAST(embedding[(y + {dy}) * 8 + x + {dx} + 1] AS DOUBLE) - {minus} ELSE 0 END)"


def kernel_query(name: str, kernel: G.Kernel, sql: str | None = None, digits: int = 6, finish: dict[str, int] | None = None, columns: list[str] | None = None) -> None:
    """Register a kernel over the fields relation."""
    kept = columns or kernel.columns

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = G.measure(R.fields(spark, sf_dir), ["sample_id"], kernel)
        return out.select("sample_id", *[S.rounded(c, (finish or {}).get(c, digits)).alias(c) for c in kept])

    query(name, sql)(run)


kernel_query(
    "grid_gradients", G.GRADIENTS,
    f"""WITH {_P}, g AS (SELECT sample_id, ({_at(0, 1)} - {_at(0, -1)}) / 2 AS gx, ({_at(1, 0)} - {_at(-1, 0)}) / 2 AS gy, {_at(1, 0)} + {_at(-1, 0)} + {_at(0, 1)} + {_at(0, -1)} - 4 * v AS l FROM p),
m AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM g), t AS (SELECT sample_id, max(m) AS top, avg(m) AS mm, stddev_samp(m) AS sm FROM m GROUP BY sample_id)
SELECT sample_id, {r("avg(abs(gx))")} AS gradient_x, {r("avg(abs(gy))")} AS gradient_y, {r("avg(m)")} AS gradient_magnitude, {r("avg(abs(gx)) / (avg(abs(gy)) + 1e-8)")} AS gradient_anisotropy,
  {r("avg(abs(l))")} AS laplacian, {r("avg(l * l)")} AS laplacian_energy, {r("avg(CASE WHEN m < 0.05 * top THEN 1.0 ELSE 0.0 END)")} AS gradient_saturation,
  {r("avg(pow((m - mm) / sm, 4)) - 3")} AS gradient_kurtosis, {r("sum(gx * gx + gy * gy)")} AS gradient_energy FROM m JOIN t USING (sample_id) GROUP BY sample_id""",
)

_SOBEL = f"""s AS (SELECT sample_id, v, sqrt(pow({_near(-1, 1)} - {_near(-1, -1)} + 2 * ({_near(0, 1)} - {_near(0, -1)}) + {_near(1, 1)} - {_near(1, -1)}, 2)
  + pow({_near(1, -1)} - {_near(-1, -1)} + 2 * ({_near(1, 0)} - {_near(-1, 0)}) + {_near(1, 1)} - {_near(-1, 1)}, 2)) AS m FROM p)"""
kernel_query(
    "grid_edges", G.EDGES,
    f"""WITH {_P}, {_SOBEL}, t AS (SELECT sample_id, avg(m) AS a, stddev_samp(m) AS d FROM s GROUP BY sample_id)
SELECT sample_id, {r("any_value(a)")} AS edge_mean, {r("any_value(d)")} AS edge_std, {r("avg(CASE WHEN m > a + d THEN 1.0 ELSE 0.0 END)")} AS edge_density FROM s JOIN t USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_initial_morphology", G.INITIAL_MORPHOLOGY,
    f"""WITH {_P}, {_SOBEL}, t AS (SELECT sample_id, avg(v) AS a FROM s GROUP BY sample_id)
SELECT sample_id, {r("avg(CASE WHEN v > a THEN 1.0 ELSE 0.0 END)")} AS density, {r("avg(m)")} AS radial_gradient FROM s JOIN t USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_total_variation", G.TOTAL_VARIATION,
    f"""WITH {_P} SELECT sample_id, {r(f"sum(CASE WHEN y < 7 THEN abs({_near(1, 0)} - v) ELSE 0 END) + sum(CASE WHEN x < 7 THEN abs({_near(0, 1)} - v) ELSE 0 END)")} AS total_variation FROM p GROUP BY sample_id""",
)
kernel_query(
    "grid_glcm", G.GLCM,
    f"""WITH {_P}, b AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY sample_id), q AS (SELECT sample_id, y, x, floor((v - lo) / (hi - lo + 1e-8) * 7) AS q FROM p JOIN b USING (sample_id)),
j AS (SELECT sample_id, a.q AS i, b.q AS j, count(*) / 56.0 AS p FROM q a JOIN q b USING (sample_id, y) WHERE b.x = a.x + 1 GROUP BY ALL),
m AS (SELECT sample_id, sum(p * i) AS mi, sum(p * j) AS mj FROM j GROUP BY sample_id)
SELECT sample_id, {r("sum(p * pow(i - j, 2))")} AS contrast, {r("sum(p / (1 + abs(i - j)))")} AS homogeneity, {r("sum(p * p)")} AS energy,
  {r("sum(p * (i - mi) * (j - mj)) / (sqrt(sum(p * pow(i - mi, 2))) * sqrt(sum(p * pow(j - mj, 2))) + 1e-8)")} AS correlation FROM j JOIN m USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_image_moments", G.IMAGE_MOMENTS,
    f"""WITH {_P}, b AS (SELECT sample_id, min(v) AS lo FROM p GROUP BY sample_id), w AS (SELECT sample_id, y, x, v - lo AS v FROM p JOIN b USING (sample_id)),
c AS (SELECT sample_id, sum(v) + 1e-8 AS m, sum(v * y) / (sum(v) + 1e-8) AS cy, sum(v * x) / (sum(v) + 1e-8) AS cx FROM w GROUP BY sample_id),
e AS (SELECT sample_id, any_value(cy) AS cy, any_value(cx) AS cx, sum(v * pow(x - cx, 2)) / any_value(m * m) AS a, sum(v * pow(y - cy, 2)) / any_value(m * m) AS b, sum(v * (x - cx) * (y - cy)) / any_value(m * m) AS d FROM w JOIN c USING (sample_id) GROUP BY sample_id)
SELECT sample_id, {r("cy")} AS centroid_y, {r("cx")} AS centroid_x, {r("ln(abs(a + b) + 1e-8)")} AS log_hu1, {r("pow(a - b, 2) + 4 * d * d", 8)} AS hu2 FROM e""",
    finish={"hu2": 8},
)
kernel_query(
    "grid_shape_descriptors", G.SHAPE_DESCRIPTORS,
    f"""WITH {_P}, t AS (SELECT sample_id, avg(v) AS mu FROM p GROUP BY sample_id), b AS (SELECT p.*, CASE WHEN v > mu THEN 1.0 ELSE 0.0 END AS b, mu FROM p JOIN t USING (sample_id)),
n AS (SELECT sample_id, y, x, b, CASE WHEN y < 7 THEN abs(b - CASE WHEN {_near(1, 0)} > mu THEN 1 ELSE 0 END) ELSE 0 END + CASE WHEN x < 7 THEN abs(b - CASE WHEN {_near(0, 1)} > mu THEN 1 ELSE 0 END) ELSE 0 END AS e FROM b),
a AS (SELECT sample_id, avg(b) AS area, sum(e) / 64 AS per, sum(b) + 1e-8 AS n, sum(b * y) / (sum(b) + 1e-8) AS cy, sum(b * x) / (sum(b) + 1e-8) AS cx FROM n GROUP BY sample_id),
i AS (SELECT sample_id, any_value(area) AS area, any_value(per) AS per, sum(b * pow(y - cy, 2)) / any_value(n) AS a, sum(b * pow(x - cx, 2)) / any_value(n) AS c, sum(b * (y - cy) * (x - cx)) / any_value(n) AS d FROM b JOIN a USING (sample_id) GROUP BY sample_id),
l AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * d * d)) / 2 AS l1, (a + c - sqrt(pow(a - c, 2) + 4 * d * d)) / 2 AS l2 FROM i)
SELECT sample_id, {r("area")} AS area, {r("per")} AS perimeter, {r("4 * pi() * area / (per * per + 1e-8)")} AS circularity, {r("sqrt(greatest(0, 1 - greatest(l2, 0) / (l1 + 1e-8)))")} AS eccentricity,
  {r("area / greatest(area, 0.1)")} AS solidity, {r("area")} AS extent FROM l""",
)


def _haar_sql(levels: int = 3) -> str:
    steps, details = ["h0 AS (SELECT sample_id, y, x, v FROM p)"], []
    for k in range(1, levels + 1):
        cell = lambda i, j: f"sum(v) FILTER (WHERE y % 2 = {i} AND x % 2 = {j})"
        a, b, c, d = cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)
        steps.append(f"q{k} AS (SELECT sample_id, y // 2 AS yy, x // 2 AS xx, {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM h{k - 1} GROUP BY sample_id, yy, xx)")
        steps.append(f"h{k} AS (SELECT sample_id, yy AS y, xx AS x, (a + b + c + d) / 2 AS v FROM q{k})")
        steps.append(f"d{k} AS (SELECT sample_id, unnest([(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2]) AS d FROM q{k})")
        details.append(f"(SELECT sample_id, {r('avg(d * d)')} AS energy_{k}, {r('avg(abs(d))')} AS mean_{k}, {r('stddev_samp(d)')} AS std_{k} FROM d{k} GROUP BY sample_id)")
    return f"WITH {_P}, {', '.join(steps)} SELECT * FROM {' JOIN '.join(d + f' AS e{i}' + (' USING (sample_id)' if i else '') for i, d in enumerate(details))}"


kernel_query("grid_haar", G.haar(3), _haar_sql())
kernel_query(
    "grid_moran", G.MORAN,
    f"""WITH {_P}, t AS (SELECT sample_id, avg(v) AS mu FROM p GROUP BY sample_id)
SELECT sample_id, {r(f"sum((v - mu) * ({_near(1, 0, 'mu')} + {_near(-1, 0, 'mu')} + {_near(0, 1, 'mu')} + {_near(0, -1, 'mu')}) / 4) / (sum(pow(v - mu, 2)) + 1e-8)")} AS moran_i FROM p JOIN t USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_centroid_distance", G.CENTROID_DISTANCE,
    f"""WITH {_P} SELECT sample_id, {r("sqrt(pow(sum(abs(v) * y) / (sum(abs(v)) + 1e-8) - 3.5, 2) + pow(sum(abs(v) * x) / (sum(abs(v)) + 1e-8) - 3.5, 2)) / (sqrt(128) / 2)")} AS centroid_distance FROM p GROUP BY sample_id""",
)
kernel_query(
    "grid_information", G.information(4, 2),
    f"""WITH {_P}, t AS (SELECT sample_id, median(v) AS md FROM p GROUP BY sample_id), b AS (SELECT p.*, v > md AS b, {_at(0, 1)} AS nxt FROM p JOIN t USING (sample_id)),
l AS (SELECT *, lag(b) OVER (PARTITION BY sample_id ORDER BY y, x) AS pb FROM b), a AS (SELECT sample_id, count(*) FILTER (WHERE b <> pb) / 64.0 AS lz, abs(corr(v, nxt)) AS pr FROM l GROUP BY sample_id),
w AS (SELECT sample_id, i, j, var_samp(v) AS s FROM p, (SELECT unnest([0, 2, 4]) AS i), (SELECT unnest([0, 2, 4]) AS j) WHERE y BETWEEN i AND i + 3 AND x BETWEEN j AND j + 3 GROUP BY ALL),
u AS (SELECT sample_id, var_samp(s) AS lv FROM w GROUP BY sample_id)
SELECT sample_id, {r("lz")} AS lz_complexity, {r("pr")} AS predictability, {r("lv", 9)} AS local_variance FROM a JOIN u USING (sample_id)""",
    finish={"local_variance": 9},
)
kernel_query(
    "grid_symmetry", G.SYMMETRY,
    f"""WITH {_P}, t AS (SELECT sample_id, v, CAST(embedding[x * 8 + 7 - y + 1] AS DOUBLE) AS a, CAST(embedding[(7 - y) * 8 + 7 - x + 1] AS DOUBLE) AS b, CAST(embedding[(7 - x) * 8 + y + 1] AS DOUBLE) AS c FROM p)
SELECT sample_id, {r("(abs(corr(v, a)) + abs(corr(v, b)) + abs(corr(v, c))) / 3")} AS symmetry FROM t GROUP BY sample_id""",
)
_BOX = " + ".join(_near(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
kernel_query("grid_clustering", G.CLUSTERING, f"WITH {_P} SELECT sample_id, {r(f'corr(v, ({_BOX}) / 9)')} AS clustering FROM p GROUP BY sample_id")

#: The power spectrum as explicit sums: 8 x 5 frequencies of an 8 x 8 grid.
_DFT = f"""{_P}, k AS (SELECT a AS ky, b AS kx, CASE WHEN a < 4 THEN a ELSE a - 8 END / 8.0 AS fy, b / 8.0 AS fx FROM range(8) s(a), range(5) t(b)),
s AS (SELECT sample_id, ky, kx, any_value(fy) AS fy, any_value(fx) AS fx, sqrt(any_value(fy * fy + fx * fx)) AS f,
  (pow(sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)), 2)) / 64 AS p FROM p, k GROUP BY sample_id, ky, kx)"""
kernel_query(
    "grid_spectral", G.SPECTRAL,
    f"""WITH {_DFT}, o AS (SELECT *, sum(p) OVER (PARTITION BY sample_id ORDER BY p DESC, ky, kx) / sum(p) OVER (PARTITION BY sample_id) AS share FROM s),
t AS (SELECT sample_id, sum(p) + 1e-8 AS t FROM s GROUP BY sample_id)
SELECT sample_id, {r("sum(p * abs(fy)) / any_value(t)")} AS centroid_y, {r("sum(p * fx) / any_value(t)")} AS centroid_x, {r("sum(p * f) / any_value(t)")} AS centroid,
  {r("sqrt(greatest(sum(p * f * f) / any_value(t) - pow(sum(p * f) / any_value(t), 2), 0))")} AS bandwidth, {r("exp(avg(ln(p + 1e-10))) / (avg(p) + 1e-10)")} AS flatness,
  {r("(count(*) FILTER (WHERE share < 0.85) + 1) / 40.0")} AS rolloff, {r("coalesce(sum(p) FILTER (WHERE f < 0.15), 0) / any_value(t)")} AS low, {r("coalesce(sum(p) FILTER (WHERE f >= 0.15 AND f < 0.35), 0) / any_value(t)")} AS mid,
  {r("coalesce(sum(p) FILTER (WHERE f >= 0.35), 0) / any_value(t)")} AS high, {r("arg_max(f, p) FILTER (WHERE ky + kx > 0)")} AS dominant, {r("sum(p * abs(fy)) / (sum(p * fx) + 1e-8)")} AS anisotropy, {r("sum(p)")} AS total_power
FROM o JOIN t USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_spectral_entropy", G.SPECTRAL_ENTROPY,
    f"""WITH {_DFT}, t AS (SELECT sample_id, p / (sum(p) OVER (PARTITION BY sample_id) + 1e-8) AS q FROM s)
SELECT sample_id, {r("least(-sum(q * ln(q + 1e-10)), 10)")} AS spectral_entropy FROM t GROUP BY sample_id""",
)
kernel_query(
    "grid_power_law", G.POWER_LAW,
    f"""WITH {_DFT} SELECT sample_id, {r("greatest(least(-regr_slope(ln(p + 1e-8), ln(f)), 5), -5)")} AS power_law FROM s WHERE f > 0 GROUP BY sample_id""",
    columns=["power_law"],
)

def _bands_sql(bands: int = 4) -> str:
    edge = lambda k: f"top * sqrt({k} / {bands})"
    inside = lambda k: f"f >= {edge(k)} AND f {'<=' if k == bands - 1 else '<'} {edge(k + 1)}"
    measures = [f"{r(f'{fn}(p) FILTER (WHERE {inside(k)})')} AS {n}_{k}" for k in range(bands) for n, fn in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop"))]
    return f"WITH {_DFT}, t AS (SELECT max(f) + 1e-12 AS top FROM s) SELECT sample_id, {', '.join(measures)} FROM s, t GROUP BY sample_id"


kernel_query("grid_radial_bands", G.radial_bands(), _bands_sql())
kernel_query(
    "grid_harmonics", G.HARMONICS,
    f"""WITH {_DFT}, d AS (SELECT sample_id, arg_max(f, p) AS f0, max(p) AS p0, sum(p) AS whole FROM s WHERE ky + kx > 0 GROUP BY sample_id),
h AS (SELECT sample_id, any_value(p0) AS p0, any_value(whole) AS whole, coalesce(sum(p) FILTER (WHERE abs(f - 2 * f0) <= 0.2 * f0), 0) AS h2, coalesce(sum(p) FILTER (WHERE abs(f - 3 * f0) <= 0.3 * f0), 0) AS h3
  FROM s JOIN d USING (sample_id) WHERE ky + kx > 0 GROUP BY sample_id)
SELECT sample_id, {r("h2 / (p0 + 1e-8)")} AS second, {r("h3 / (p0 + 1e-8)")} AS third, {r("sqrt(h2 + h3) / (sqrt(p0) + 1e-8)")} AS distortion, {r("p0 / (whole + 1e-8)")} AS purity FROM h""",
)


def _blocks_sql(size: int) -> str:
    """Entropy of the power of means of blocks of an 8 x 8 grid."""
    side = 8 // size
    return f"""b{size} AS (SELECT sample_id, y // {size} AS y, x // {size} AS x, avg(v) AS v FROM p GROUP BY ALL),
f{size} AS (SELECT sample_id, ky, kx, (pow(sum(v * cos(2 * pi() * (ky * y + kx * x) / {side})), 2) + pow(sum(v * sin(2 * pi() * (ky * y + kx * x) / {side})), 2)) / {side * side} AS p
  FROM b{size}, range({side}) s(ky), range({side // 2 + 1}) t(kx) GROUP BY ALL),
m{size} AS (SELECT sample_id, -sum(q * ln(q + 1e-10)) AS multiscale_{size} FROM (SELECT sample_id, p / (sum(p) OVER (PARTITION BY sample_id) + 1e-8) AS q FROM f{size}) GROUP BY sample_id)"""


kernel_query(
    "grid_entropies", G.entropies((2, 4)),
    f"""WITH {_DFT}, e AS (SELECT sample_id, least(-sum(q * ln(q + 1e-10)), 10) AS spectral_entropy FROM (SELECT sample_id, p / (sum(p) OVER (PARTITION BY sample_id) + 1e-8) AS q FROM s) GROUP BY sample_id),
z AS (SELECT sample_id, y * 8 + x AS i, v - avg(v) OVER (PARTITION BY sample_id) AS z FROM p),
l AS (SELECT sample_id, k, pow(sum(z * cos(2 * pi() * k * i / 64)), 2) + pow(sum(z * sin(2 * pi() * k * i / 64)), 2) AS p FROM z, range(33) r(k) GROUP BY ALL),
n AS (SELECT sample_id, -sum(q * ln(q + 1e-10)) AS line_entropy FROM (SELECT sample_id, p / (sum(p) OVER (PARTITION BY sample_id) + 1e-8) AS q FROM l) GROUP BY sample_id),
a AS (SELECT sample_id, sum(z * z) + 1e-8 AS c0, sum(z * z2) AS c2, sum(z * z3) AS c3 FROM (SELECT *, lead(z, 2) OVER w AS z2, lead(z, 3) OVER w AS z3 FROM z WINDOW w AS (PARTITION BY sample_id ORDER BY i)) GROUP BY sample_id),
{_blocks_sql(2)}, {_blocks_sql(4)}
SELECT sample_id, {r("spectral_entropy")} AS spectral_entropy, {r("line_entropy")} AS line_entropy, {r("-ln((abs(c3 / c0) + 1e-8) / (abs(c2 / c0) + 1e-8))", 5)} AS acf_entropy, {r("multiscale_2")} AS multiscale_2, {r("multiscale_4")} AS multiscale_4
FROM e JOIN n USING (sample_id) JOIN a USING (sample_id) JOIN m2 USING (sample_id) JOIN m4 USING (sample_id)""",
    finish={"acf_entropy": 5},
)
kernel_query("grid_ranks", G.RANKS)
kernel_query(
    "grid_correlation_structure", G.CORRELATION_STRUCTURE,
    f"""WITH {_P}, z AS (SELECT sample_id, y, x, v - avg(v) OVER (PARTITION BY sample_id) AS z FROM p),
a AS (SELECT a.sample_id, (b.y - a.y + 8) % 8 AS y, (b.x - a.x + 8) % 8 AS x, sum(a.z * b.z) AS c FROM z a JOIN z b USING (sample_id) GROUP BY ALL),
n AS (SELECT sample_id, y, x, c / (max(c) FILTER (WHERE y = 0 AND x = 0) OVER (PARTITION BY sample_id) + 1e-8) AS c, round_even(sqrt(pow(least(y, 8 - y), 2) + pow(least(x, 8 - x), 2)), 0) AS rad FROM a),
g AS (SELECT sample_id, rad, avg(c) AS c FROM n GROUP BY ALL), l AS (SELECT sample_id, coalesce(min(rad) FILTER (WHERE c < exp(-1.0)), count(*)) AS len FROM g GROUP BY sample_id),
x AS (SELECT sample_id, (abs(max(c) FILTER (WHERE y = 1 AND x = 0)) + 1e-8) / (abs(max(c) FILTER (WHERE y = 0 AND x = 1)) + 1e-8) AS ratio FROM n GROUP BY sample_id),
f AS (SELECT sample_id, ky, kx, pow(sum(z * cos(2 * pi() * (ky * y + kx * x) / 8)), 2) + pow(sum(z * sin(2 * pi() * (ky * y + kx * x) / 8)), 2) AS p FROM z, range(8) s(ky), range(8) t(kx) GROUP BY ALL),
s AS (SELECT sample_id, round_even(sqrt(pow(least(ky, 8 - ky), 2) + pow(least(kx, 8 - kx), 2)), 0) AS rad, avg(p) AS p FROM f WHERE ky + kx > 0 GROUP BY ALL), t AS (SELECT sample_id, max(p) AS top FROM s GROUP BY sample_id)
SELECT sample_id, {r("any_value(len)")} AS correlation_length, {r("any_value(ratio)")} AS axis_ratio, {r("arg_max(rad, p)")} AS structure_peak, {r("max(p)")} AS structure_value,
  {r("sum(CASE WHEN p >= top / 2 THEN 1.0 ELSE 0.0 END)")} AS structure_width, {r("sum(p)")} AS structure_integral FROM s JOIN t USING (sample_id) JOIN l USING (sample_id) JOIN x USING (sample_id) GROUP BY sample_id""",
)
kernel_query(
    "grid_frequency_index", G.POWER_LAW,
    f"""WITH {_DFT}, l AS (SELECT sample_id, greatest(least(-regr_slope(ln(p + 1e-8), ln(f)), 5), -5) AS power_law FROM s WHERE f > 0 GROUP BY sample_id),
m AS (SELECT sample_id, max(p) AS top FROM s GROUP BY sample_id),
i AS (SELECT sample_id, min(ky * 5 + kx) FILTER (WHERE p >= top * (1 - 1e-9)) / 40 AS dominant, sum(p * (ky * 5 + kx)) / (sum(p) + 1e-8) / 40 AS centroid FROM s JOIN m USING (sample_id) GROUP BY sample_id)
SELECT sample_id, {r("power_law")} AS power_law, {r("dominant")} AS dominant_index, {r("centroid")} AS index_centroid FROM l JOIN i USING (sample_id)""",
)


def low_sql(source: str, target: str) -> str:
    """The cells of a grid blurred by a Gaussian of deviation 1, zero outside."""
    return f"""{target} AS (SELECT a.sample_id, a.y, a.x, sum(b.v * exp(-0.5 * (pow(a.y - b.y, 2) + pow(a.x - b.x, 2)))) / pow((SELECT sum(exp(-0.5 * k * k)) FROM range(-3, 4) r(k)), 2) AS v
  FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY ALL)"""


#: low: blurred cells of p; h: the rest.
LOW_SQL = f"{low_sql('p', 'low')}, h AS (SELECT sample_id, y, x, p.v - low.v AS v FROM p JOIN low USING (sample_id, y, x))"


def _pyramid_sql() -> str:
    level = lambda k, big, low: f"""n{k} AS (SELECT sample_id, y // 2 AS y, x // 2 AS x, v FROM {low} WHERE y % 2 = 0 AND x % 2 = 0),
r{k} AS (SELECT b.sample_id, avg(pow(b.v - n.v, 2)) AS e, stddev_samp(b.v - n.v) AS c FROM {big} b JOIN n{k} n ON n.sample_id = b.sample_id AND n.y = b.y // 2 AND n.x = b.x // 2 GROUP BY b.sample_id)"""  # noqa: E731
    return f"""WITH {_P}, {LOW_SQL}, {level(1, "p", "low")}, {low_sql("n1", "low2")}, {level(2, "n1", "low2")},
e AS (SELECT sample_id, sum(v * v) AS low FROM low GROUP BY sample_id), g AS (SELECT sample_id, sum(v * v) AS high FROM h GROUP BY sample_id)
SELECT sample_id, {r("low")} AS low_energy, {r("high")} AS high_energy, {r("r1.e")} AS pyramid_energy_1, {r("r1.c")} AS pyramid_contrast_1, {r("r2.e")} AS pyramid_energy_2, {r("r2.c")} AS pyramid_contrast_2
FROM e JOIN g USING (sample_id) JOIN r1 USING (sample_id) JOIN r2 USING (sample_id)"""


kernel_query("grid_scales", G.scales(2), _pyramid_sql())
#: Cells above the median plus half a deviation, what each of them reaches, and the sizes of the sets that reach one another.
_PARTS_SQL = f"""WITH RECURSIVE {_P}, c AS (SELECT sample_id, median(v) + 0.5 * stddev_samp(v) AS cut FROM p GROUP BY sample_id),
m AS (SELECT sample_id, y, x, y * 8 + x AS cell FROM p JOIN c USING (sample_id) WHERE v > cut),
reached AS (SELECT sample_id, cell AS start, y, x FROM m UNION SELECT r.sample_id, r.start, m.y, m.x FROM reached r JOIN m ON m.sample_id = r.sample_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
first AS (SELECT sample_id, y, x, min(start) AS root FROM reached GROUP BY ALL), sizes AS (SELECT sample_id, root, count(*) AS n FROM first GROUP BY ALL)"""
kernel_query(
    "grid_components", G.COMPONENTS,
    f"""{_PARTS_SQL} SELECT vec_id AS sample_id, CAST(count(n) AS DOUBLE) AS components, {r("coalesce(max(n), 0) / 64", 12)} AS largest, {r("coalesce(avg(n), 0) / 64", 12)} AS mean_size, {r("coalesce(stddev_pop(n), 0) / 64", 12)} AS std_size
FROM embeddings LEFT JOIN sizes ON sample_id = vec_id GROUP BY vec_id""",
    digits=12,  # shares of 64 cells end in a five at six digits
)


@query("tiled_components", f"{_PARTS_SQL} SELECT sample_id, n, count(*) AS components FROM sizes GROUP BY ALL")
def tiled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components of each size a grid has, found in tiles of three by three cells."""
    cut = R.cells(spark, sf_dir).groupBy("sample_id").agg((F.median("v") + 0.5 * F.stddev_samp("v")).alias("cut"))  # 64 cells a grid
    f = R.fields(spark, sf_dir).join(cut, "sample_id")
    tiles = T.tiled(f.select("sample_id", "h", "w", F.struct("data", "cut").alias("both")), "sample_id", F.transform("both.data", lambda v: v > F.col("both.cut")), 3)
    return T.component_sizes(tiles, "sample_id").groupBy("sample_id", "n").agg(F.count("*").alias("components"))


def _box_sql(source: str, target: str, reach: int, pick: str) -> str:
    """Smallest or largest value of each cell's box; outside the grid, values are zero."""
    least = f"CASE WHEN count(*) < {(2 * reach + 1) ** 2} THEN {pick}({'min' if pick == 'least' else 'max'}(b.v), 0) ELSE {'min' if pick == 'least' else 'max'}(b.v) END"
    return f"{target} AS (SELECT a.sample_id, a.y, a.x, {least} AS v FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id AND abs(a.y - b.y) <= {reach} AND abs(a.x - b.x) <= {reach} GROUP BY ALL)"


def _granulometry_sql(widths: tuple[int, ...] = (3, 5, 7, 9)) -> str:
    steps = ["b AS (SELECT sample_id, y, x, CASE WHEN v > avg(v) OVER (PARTITION BY sample_id) THEN 1.0 ELSE 0.0 END AS v FROM p)", "a1 AS (SELECT sample_id, sum(v) AS a FROM b GROUP BY sample_id)"]
    for k in widths:
        steps += [_box_sql("b", f"e{k}", k // 2, "least"), _box_sql(f"e{k}", f"o{k}", k // 2, "greatest"), f"a{k} AS (SELECT sample_id, sum(v) AS a FROM o{k} GROUP BY sample_id)"]
    lost = [f"greatest(a{p}.a - a{k}.a, 0)" for p, k in zip((1, *widths), widths, strict=False)]
    weighed = lambda f: " + ".join(f"{c} * {f(k)}" for c, k in zip(lost, widths, strict=True))
    joined = " ".join(f"JOIN a{k} USING (sample_id)" for k in widths)
    return f"""WITH {_P}, {", ".join(steps)}, w AS (SELECT sample_id, {" + ".join(lost)} + 1e-8 AS w, {weighed(lambda k: k)} AS s, {weighed(lambda k: k * k)} AS q FROM a1 {joined})
SELECT sample_id, {r("s / w")} AS size_mean, {r("sqrt(greatest(q / w - pow(s / w, 2), 0))")} AS size_std FROM w"""


kernel_query("grid_granulometry", G.granulometry(), _granulometry_sql())
kernel_query(
    "grid_clusters", G.CLUSTERS,
    f"""WITH {_P}, m AS (SELECT sample_id, median(v) AS md FROM p GROUP BY sample_id), b AS (SELECT sample_id, y, x, CASE WHEN v > md THEN 1.0 ELSE 0.0 END AS v FROM p JOIN m USING (sample_id)),
{_box_sql("b", "i", 1, "least")}, xi AS (SELECT sample_id, y, x, p.v * i.v AS v FROM p JOIN i USING (sample_id, y, x)), {_box_sql("xi", "hi", 1, "greatest")}, {_box_sql("b", "wide", 5, "greatest")},
c AS (SELECT sample_id, count(*) FILTER (WHERE i.v > 0 AND xi.v >= hi.v) AS n FROM i JOIN xi USING (sample_id, y, x) JOIN hi USING (sample_id, y, x) GROUP BY sample_id),
a AS (SELECT sample_id, sum(wide.v) AS w, sum(b.v) AS b FROM wide JOIN b USING (sample_id, y, x) GROUP BY sample_id)
SELECT sample_id, {r("ln(1 + n)")} AS clusters, {r("least(w / (b + 1e-8), 1)")} AS largest_fraction FROM c JOIN a USING (sample_id)""",
)
kernel_query("channel_eigenvalues", G.channel_eigen())
kernel_query(
    "channel_coherence", G.coherence(),
    f"""WITH c AS (SELECT vec_id AS sample_id, i // 16 AS c, i % 16 AS p, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
f AS (SELECT sample_id, c, k, sum(v * cos(2 * pi() * k * p / 16)) AS re, -sum(v * sin(2 * pi() * k * p / 16)) AS im FROM c, range(9) s(k) GROUP BY ALL),
q AS (SELECT sample_id, a.c, k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS p, b.re * b.re + b.im * b.im AS q FROM f a JOIN f b USING (sample_id, k) WHERE b.c = a.c + 1),
t AS (SELECT x.sample_id, x.c, x.k, (pow(x.re + y.re, 2) + pow(x.im + y.im, 2)) / ((x.p + y.p) * (x.q + y.q) + 1e-8) AS coh FROM q x JOIN q y ON x.sample_id = y.sample_id AND x.c = y.c AND y.k = x.k + 1),
k AS (SELECT sample_id, arg_max(k, m) AS peak FROM (SELECT sample_id, k, avg(coh) AS m FROM t GROUP BY ALL) GROUP BY sample_id)
SELECT sample_id, {r("avg(coh)")} AS coherence_mean, {r("max(coh)")} AS coherence_max, {r("any_value(peak)")} AS coherence_peak FROM t JOIN k USING (sample_id) GROUP BY sample_id""",
)


@query(
    "spectral_isolation",
    f"""WITH {_DFT}, b AS (SELECT sample_id, sum(p) FILTER (WHERE f < 0.05) / sum(p) AS low, sum(p) FILTER (WHERE f >= 0.05 AND f < 0.15) / sum(p) AS mid, sum(p) FILTER (WHERE f >= 0.15) / sum(p) AS high FROM s GROUP BY sample_id)
SELECT label, {r("avg(low)")} AS low, {r("avg(mid)")} AS mid, {r("avg(high)")} AS high, avg(high) >= 0.5 AS isolated FROM b JOIN embeddings ON sample_id = vec_id GROUP BY label""",
)
def spectral_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of power by band for each label, and whether the high band holds at least half."""
    shares = G.measure(R.fields(spark, sf_dir), ["sample_id", "label"], G.BANDS)
    out = shares.groupBy("label").agg(*[F.avg(c).alias(c) for c in ("low", "mid", "high")])
    return rounded(out.withColumn("isolated", F.col("high") >= 0.5), ["label"])


@query(
    "ensemble_spectrum",
    f"WITH {_DFT} SELECT label AS sample_id, ky * 5 + kx AS k, {r('avg(log10(p + 1e-10))')} AS log_power FROM s JOIN embeddings ON s.sample_id = vec_id GROUP BY ALL",
)
def ensemble_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log10 power of each label's realizations at every frequency."""
    spectra = G.transformed(G.checked(R.ensemble_fields(spark, sf_dir), ["sample_id"]), G.POWER)
    flat = spectra.select("key.sample_id", F.posexplode("power").alias("k", "p"))
    return rounded(flat.groupBy("sample_id", "k").agg(F.avg(F.log10(F.col("p") + 1e-10)).alias("log_power")), ["sample_id", "k"])


@query("ensemble_pca_modes")
def ensemble_pca_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm over the first three principal modes of each label's realizations, by cell.

    The modes come from the 64 x 64 second-moment matrix of cells, which is summed
    map-side; no task holds an ensemble.
    """
    import numpy as np
    import pandas as pd

    f = R.ensemble_fields(spark, sf_dir)
    n = 64
    pairs = f.select("sample_id", F.posexplode("data").alias("i", "a"), "data").select("sample_id", "i", F.transform("data", lambda b: b * F.col("a")).alias("row"), "a")
    sums = pairs.groupBy("sample_id", "i").agg(*[F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(n)], F.sum("a").alias("s"), F.count("*").alias("m"))
    rows = sums.select("sample_id", "i", "s", "m", F.array(*[F.col(f"s{j}") for j in range(n)]).alias("row"))

    def modes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")  # 64 rows a label
        mean = pdf["s"].to_numpy() / pdf["m"].to_numpy()
        cov = np.stack(pdf["row"]) / pdf["m"].iloc[0] - np.outer(mean, mean)
        values, vectors = np.linalg.eigh(cov)
        top = vectors[:, ::-1][:, :3] * np.sqrt(np.maximum(values[::-1][:3], 0))
        return pd.DataFrame({"sample_id": pdf["sample_id"].to_numpy(), "cell": pdf["i"].to_numpy(), "mode_norm": np.linalg.norm(top, axis=1)})

    return rounded(rows.groupBy("sample_id").applyInPandas(modes, "sample_id int, cell int, mode_norm double"), ["sample_id", "cell"])


@query(
    "channel_pair_correlation",
    f"""WITH c AS (SELECT vec_id AS sample_id, i // 16 AS c, i % 16 AS p, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
q AS (SELECT sample_id, a.c AS c1, b.c AS c2, covar_pop(a.v, b.v) / (stddev_samp(a.v) * stddev_samp(b.v) + 1e-8) AS r FROM c a JOIN c b USING (sample_id, p) WHERE a.c < b.c GROUP BY ALL)
SELECT sample_id, {r("avg(r)")} AS mean, {r("max(r)")} AS max, {r("min(r)")} AS min, {r("stddev_samp(r)")} AS std FROM q GROUP BY sample_id""",
)
def channel_pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstat.operators.sequence import mixed_corr

    c = R.channels(spark, sf_dir)
    a = c.select("sample_id", "y", "x", F.col("c").alias("c1"), F.col("v").alias("v1"))
    b = c.select("sample_id", "y", "x", F.col("c").alias("c2"), F.col("v").alias("v2"))
    pairs = a.join(b, ["sample_id", "y", "x"]).where("c1 < c2").groupBy("sample_id", "c1", "c2").agg(mixed_corr("v1", "v2").alias("r"))
    return rounded(D.reduce_over(pairs, ["sample_id"], "r", ["mean", "max", "min", "std"]), ["sample_id"])


_CHANNEL_BINS = """c AS (SELECT vec_id AS sample_id, i // 16 AS c, i % 16 AS p, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
g AS (SELECT sample_id, c, min(v) AS lo, max(v) AS hi FROM c GROUP BY ALL), b AS (SELECT sample_id, c, p, floor((v - lo) / (hi - lo + 1e-8) * 3) AS b FROM c JOIN g USING (sample_id, c))"""


def _channel_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.with_group_range(R.channels(spark, sf_dir), ["sample_id", "c"], "v")
    return c.select("sample_id", "c", (F.col("y") * 4 + F.col("x")).alias("p"), S.floor_bins(F.col("v"), F.col("lo"), F.col("hi"), 4).alias("b"))


def _joint_entropy(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    n = df.groupBy(*keys, *by).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias(name))


@query(
    "channel_mutual_information",
    f"""WITH {_CHANNEL_BINS}, j AS (SELECT sample_id, x.c AS c1, y.c AS c2, x.b AS bx, y.b AS bj FROM b x JOIN b y USING (sample_id, p) WHERE x.c < y.c),
n AS (SELECT sample_id, c1, c2, count(*) OVER (PARTITION BY sample_id, c1, c2, bx, bj) AS nxy, count(*) OVER (PARTITION BY sample_id, c1, c2, bx) AS nx, count(*) OVER (PARTITION BY sample_id, c1, c2, bj) AS ny FROM j),
m AS (SELECT sample_id, c1, c2, avg(ln(nxy * 16.0 / (nx * ny))) AS mi FROM n GROUP BY ALL) SELECT sample_id, {r("avg(mi)")} AS mean, {r("max(mi)")} AS max FROM m GROUP BY sample_id""",
)
def channel_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, keys = _channel_bins(spark, sf_dir), ["sample_id", "c1", "c2"]
    both = b.select("sample_id", "p", F.col("c").alias("c1"), F.col("b").alias("bx")).join(b.select("sample_id", "p", F.col("c").alias("c2"), F.col("b").alias("by")), ["sample_id", "p"])
    both = both.where("c1 < c2")
    parts = [_joint_entropy(both, keys, by, name) for by, name in ((["bx"], "hx"), (["by"], "hy"), (["bx", "by"], "hxy"))]
    mi = parts[0].join(parts[1], keys).join(parts[2], keys).withColumn("mi", F.col("hx") + F.col("hy") - F.col("hxy"))
    return rounded(D.reduce_over(mi, ["sample_id"], "mi", ["mean", "max"]), ["sample_id"])


@query(
    "channel_conditional_information",
    f"""WITH {_CHANNEL_BINS}, j AS (SELECT sample_id, x.b AS bx, y.b AS bj, z.b AS bz FROM b x JOIN b y USING (sample_id, p) JOIN b z USING (sample_id, p) WHERE x.c = 0 AND y.c = 1 AND z.c = 2),
n AS (SELECT sample_id, count(*) OVER (PARTITION BY sample_id, bx, bj, bz) AS nxyz, count(*) OVER (PARTITION BY sample_id, bz) AS nz, count(*) OVER (PARTITION BY sample_id, bx, bz) AS nxz, count(*) OVER (PARTITION BY sample_id, bj, bz) AS nyz FROM j)
SELECT sample_id, {r("avg(ln(nxyz * nz * 1.0 / (nxz * nyz)))")} AS conditional_information FROM n GROUP BY sample_id""",
)
def channel_conditional_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I(X; Y | Z) of the first three channels."""
    b = _channel_bins(spark, sf_dir)
    wide = b.where("c < 3").groupBy("sample_id", "p").pivot("c", [0, 1, 2]).agg(F.first("b")).toDF("sample_id", "p", "bx", "by", "bz")
    parts = [_joint_entropy(wide, ["sample_id"], by, name) for by, name in ((["bx", "bz"], "hxz"), (["by", "bz"], "hyz"), (["bx", "by", "bz"], "hxyz"), (["bz"], "hz"))]
    all_four = parts[0].join(parts[1], "sample_id").join(parts[2], "sample_id").join(parts[3], "sample_id")
    return rounded(all_four.select("sample_id", (F.col("hxz") + F.col("hyz") - F.col("hxyz") - F.col("hz")).alias("conditional_information")), ["sample_id"])
