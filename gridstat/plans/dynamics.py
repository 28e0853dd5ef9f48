"""Queries of nonlinear dynamics and whole extraction jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridstat.functions import stats as S
from gridstat.operators import descriptive as D
from gridstat.operators import extractors as E
from gridstat.operators import grid as G
from gridstat.operators import recurrence as C
from gridstat.operators import tiles as T
from gridstat.plans import grid as _grid  # noqa: F401  registers the SQL that this module puts together
from gridstat.plans.descriptive import MOMENTS_SQL, rounded
from gridstat.plans.registry import ORACLE_SQL, query, r, with_relations
from gridstat.sources import relations as R

_PARTS = ["moran", "centroid_distance", "information", "symmetry", "initial_morphology", "clusters", "frequency_index"]


def _initial_sql(prefix: str) -> str:
    """The family as its own queries side by side; on 8 x 8 cells there is a single patch of eight, and no variance of patches."""
    names = [c for kernel in E.get_family("initial") for c in kernel.columns]
    columns = ", ".join(f"{'CAST(NULL AS DOUBLE)' if c == 'local_variance' else c} AS {prefix}{c}" for c in names)
    parts = " JOIN ".join(f"({ORACLE_SQL[f'grid_{n}']}) AS {n}_part" + (" USING (sample_id)" if i else "") for i, n in enumerate(_PARTS))
    return f"SELECT sample_id, {columns} FROM {parts}"


def _aligned_sql() -> str:
    moments = ", ".join(f'"{c}" AS moments__{c}' for c in ("mean", "variance", "std", "min", "max", "range", "skewness", "kurtosis"))
    spectral = ", ".join(f"{c} AS spectral__spectral__{c}" for c in G.SPECTRAL.columns)
    families = [f"(SELECT sample_id, {moments} FROM ({MOMENTS_SQL}))", f"({_initial_sql('initial__initial__')})", f"(SELECT sample_id, {spectral} FROM ({ORACLE_SQL['grid_spectral']}))"]
    return f"SELECT * FROM {families[0]} AS a JOIN {families[1]} AS b USING (sample_id) JOIN {families[2]} AS c USING (sample_id)"


@query("series_nonlinear")
def series_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.nonlinear(R.user_series(spark, sf_dir)), ["sample_id"])


@query(
    "series_recurrence",
    f"""{with_relations("user_series")}, p AS (SELECT sample_id, t, y AS a, lead(y) OVER (PARTITION BY sample_id ORDER BY t) AS b FROM user_series QUALIFY b IS NOT NULL),
c AS (SELECT x.sample_id, x.t AS i, z.t AS j, sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)) AS d FROM p x JOIN p z ON x.sample_id = z.sample_id),
m AS (SELECT sample_id, 0.1 * max(d) AS within, sqrt(count(*)) AS n FROM c GROUP BY sample_id HAVING count(*) > 1),
k AS (SELECT sample_id, i, j, j - 1 IS NOT DISTINCT FROM lag(j) OVER w OR j + 1 IS NOT DISTINCT FROM lead(j) OVER w AS beside FROM c JOIN m USING (sample_id) WHERE d <= within WINDOW w AS (PARTITION BY sample_id, i ORDER BY j)),
g AS (SELECT sample_id, j - i AS diagonal, i - row_number() OVER (PARTITION BY sample_id, j - i ORDER BY i) AS island FROM k),
l AS (SELECT sample_id, count(*) AS length FROM g GROUP BY sample_id, diagonal, island),
b AS (SELECT sample_id, min(length) AS lo, max(length) AS hi, count(*) AS total, sum(length) AS inside FROM l WHERE length >= 2 GROUP BY sample_id),
h AS (SELECT sample_id, count(*) / any_value(total) AS share FROM l JOIN b USING (sample_id) WHERE length >= 2 GROUP BY sample_id, CASE WHEN hi > lo THEN least((length - lo) * 20 // (hi - lo), 19) ELSE 0 END),
e AS (SELECT sample_id, -sum(share * ln(share)) AS entropy FROM h GROUP BY sample_id),
s AS (SELECT sample_id, count(*) AS cells, count(*) FILTER (WHERE beside) AS beside FROM k GROUP BY sample_id)
SELECT u.sample_id, {r("cells / (n * n)")} AS recurrence_rate, {r("CASE WHEN cells IS NOT NULL THEN coalesce(inside, 0) / cells END")} AS determinism,
  {r("beside / cells")} AS laminarity, {r("CASE WHEN cells IS NOT NULL THEN coalesce(entropy, 0) END")} AS diagonal_entropy
FROM (SELECT DISTINCT sample_id FROM user_series) u LEFT JOIN m USING (sample_id) LEFT JOIN s USING (sample_id) LEFT JOIN b USING (sample_id) LEFT JOIN e USING (sample_id)""",
)
def series_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurrence of every user's series, tile by tile."""
    return rounded(T.recurrences(R.user_series(spark, sf_dir)), ["sample_id"])


@query("summary_features")
def summary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction: per-grid families in one pass, reduced over each label's realizations."""
    wide = E.extract(R.members(spark, sf_dir), ["sample_id", "realization"], ["gradients", "spectral", "structural", "physics", "morphological", "multiscale", "distributional"])
    out = E.summarize(wide, "sample_id", ["mean", "std", "cv"])
    return out.select("sample_id", "feature", *[S.rounded(c, 5).alias(c) for c in ("mean", "std", "cv")])


@query("initial_features", _initial_sql("initial__"))
def initial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.extract(R.fields(spark, sf_dir), ["sample_id"], ["initial"]), ["sample_id"])


@query("aligned_families", _aligned_sql())
def aligned_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three families side by side by sample."""
    f = R.fields(spark, sf_dir)
    moments = D.moments(R.cells(spark, sf_dir), ["sample_id"])
    initial, spectral = (E.extract(f, ["sample_id"], [x]) for x in ("initial", "spectral"))
    both = E.align({"moments": moments, "initial": initial, "spectral": spectral})
    return both.select("sample_id", *[S.rounded(c, 5 if c in ("moments__skewness", "moments__kurtosis") else 6).alias(c) for c in both.columns if c != "sample_id"])
