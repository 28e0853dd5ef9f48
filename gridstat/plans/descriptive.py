"""Queries of descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstat.functions import grids as A
from gridstat.functions import stats as S
from gridstat.operators import descriptive as D
from gridstat.plans.registry import query, r, with_relations
from gridstat.sources import relations as R


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Keys as they are; doubles rounded, so that the order of sums does not show."""
    return df.select(*keys, *[S.rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


_Z = "(v - mean) / std"
MOMENTS_SQL = f"""
{with_relations("cells")},
m AS (SELECT sample_id, avg(v) AS mean, var_samp(v) AS variance, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM cells GROUP BY sample_id)
SELECT sample_id, {r("any_value(mean)")} AS mean, {r("any_value(variance)")} AS variance, {r("any_value(std)")} AS std, {r("any_value(min)")} AS min,
  {r("any_value(max)")} AS max, {r("any_value(max) - any_value(min)")} AS range, {r(f"avg(pow({_Z}, 3))", 5)} AS skewness, {r(f"avg(pow({_Z}, 4)) - 3", 5)} AS kurtosis
FROM cells JOIN m USING (sample_id) GROUP BY sample_id
"""


@query("field_moments", MOMENTS_SQL)
def field_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.moments(R.cells(spark, sf_dir), ["sample_id"])
    return out.select("sample_id", *[S.rounded(c, 5 if c in ("skewness", "kurtosis") else 6).alias(c) for c in out.columns[1:]])


@query(
    "field_percentiles",
    f"{with_relations('cells')} SELECT sample_id, "
    + ", ".join(f"{r(f'quantile_cont(v, {p})')} AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    + f", {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')} AS iqr FROM cells GROUP BY sample_id",
)
def field_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.percentiles(R.cells(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(
    "field_mad",
    f"{with_relations('cells')}, m AS (SELECT sample_id, quantile_disc(v, 0.5) AS med FROM cells GROUP BY sample_id) "
    f"SELECT sample_id, {r('quantile_disc(abs(v - med), 0.5)')} AS mad FROM cells JOIN m USING (sample_id) GROUP BY sample_id",
)
def field_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.median_absolute_deviation(R.cells(spark, sf_dir), ["sample_id"]), ["sample_id"])


def _bins_sql(bins: int, expression: str) -> str:
    return f"""
{with_relations("cells")},
g AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM cells GROUP BY sample_id),
b AS (SELECT sample_id, {expression.format(bins=bins)} AS bin, count(*) AS n FROM cells JOIN g USING (sample_id) GROUP BY ALL),
p AS (SELECT sample_id, n / 64.0 AS p FROM b)
"""


_EQUAL = "least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1)"


@query(
    "field_histogram",
    _bins_sql(16, _EQUAL)
    + f"SELECT sample_id, {r('-sum(p * ln(p))')} AS entropy, {r('max(p)')} AS peak, CAST(count(*) FILTER (WHERE p > 0.01) AS BIGINT) AS filled_bins FROM p GROUP BY sample_id",
)
def field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.histogram(R.cells(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(
    "field_entropy_floor_bins",
    _bins_sql(32, "floor((v - lo) / (hi - lo + 1e-8) * ({bins} - 1))") + f"SELECT sample_id, {r('-sum(p * ln(p))')} AS entropy FROM p GROUP BY sample_id",
)
def field_entropy_floor_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.floor_entropy(R.cells(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(
    "field_entropy_base_2",
    _bins_sql(32, "floor((v - lo) / (hi - lo + 1e-8) * ({bins} - 1))") + f"SELECT sample_id, {r('-sum(p * log2(p))')} AS bits, {r('-sum(p * log2(p)) / log2(32)')} AS share FROM p GROUP BY sample_id",
)
def field_entropy_base_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy in bits, and as a share of what 32 bins can have."""
    out = D.floor_entropy(R.cells(spark, sf_dir), ["sample_id"], bins=32)
    bits = F.col("entropy") / F.log(F.lit(2.0))
    return rounded(out.select("sample_id", bits.alias("bits"), (bits / 5).alias("share")), ["sample_id"])


@query(
    "framed_grids",
    f"{with_relations('cells')} SELECT sample_id, CAST(169 AS BIGINT) AS cells, {r('sum(v * ((y + 2) * 13 + x + 2))')} AS place, {r('sum(v)')} AS total FROM cells GROUP BY sample_id",
)
def framed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids in the middle of 13 x 13 cells: where their values lie, and that nothing was added."""
    f = R.fields(spark, sf_dir).select("sample_id", A.framed(F.col("data"), F.col("h"), F.col("w"), 13).alias("data"))
    place = F.aggregate(F.zip_with("data", F.sequence(F.lit(0), F.size("data") - 1), lambda v, p: v * p), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return f.select("sample_id", F.size("data").cast("long").alias("cells"), S.rounded(place).alias("place"), S.rounded(total).alias("total"))


@query(
    "field_norms",
    f"{with_relations('cells')} SELECT sample_id, {r('sum(abs(v))')} AS l1, {r('sqrt(sum(v * v) + 1e-8)')} AS l2, {r('max(abs(v))')} AS linf FROM cells GROUP BY sample_id",
)
def field_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.norms(R.cells(spark, sf_dir), ["sample_id"]), ["sample_id"])


@query(
    "outlier_clip",
    f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_linenumber, count(*) AS n, {r("avg(least(greatest(l_extendedprice, a - 0.1 * (b - a)), b + 0.1 * (b - a)))", 3)} AS clipped_mean FROM lineitem, q GROUP BY l_linenumber""",
)
def outlier_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = D.outlier_clip(R.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice"), "l_extendedprice", 0.1)
    return held.groupBy("l_linenumber").agg(F.count("*").alias("n"), S.rounded(F.avg("l_extendedprice"), 3).alias("clipped_mean"))


@query(
    "temporal_reductions",
    f"{with_relations('series')} SELECT sample_id, c, {r('avg(y)')} AS mean, {r('stddev_samp(y)')} AS std, {r('min(y)')} AS min, {r('max(y)')} AS max, {r('arg_max(y, t)')} AS final FROM series GROUP BY sample_id, c",
)
def temporal_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.reduce_over(R.series(spark, sf_dir), ["sample_id", "c"], "y", ["mean", "std", "min", "max", "final"], "t"), ["sample_id", "c"])


@query(
    "realization_reductions",
    f"""{with_relations("ensemble")}, m AS (SELECT sample_id, realization, avg(v) AS v FROM ensemble GROUP BY ALL)
SELECT sample_id, {r("avg(v)", 8)} AS mean, {r("stddev_samp(v)", 8)} AS std, {r("stddev_samp(v) / (abs(avg(v)) + 1e-8)", 3)} AS cv, {r("min(v)", 8)} AS min, {r("max(v)", 8)} AS max FROM m GROUP BY sample_id""",
)
def realization_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_trajectory = R.ensemble(spark, sf_dir).groupBy("sample_id", "realization").agg(F.avg("v").alias("v"))
    out = D.reduce_over(per_trajectory, ["sample_id"], "v", ["mean", "std", "cv", "min", "max"])
    return out.select("sample_id", *[S.rounded(c, 3 if c == "cv" else 8).alias(c) for c in ("mean", "std", "cv", "min", "max")])


@query(
    "density_fluctuations",
    f"""{with_relations("series")} SELECT sample_id, {r("least(greatest(var_samp(y) / (avg(y) * avg(y) + 1e-8), 0), 100)")} AS relative_variance,
  {r("least(greatest(var_samp(y) / (abs(avg(y)) + 1e-8), 0), 100)")} AS fano FROM series GROUP BY sample_id""",
)
def density_fluctuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.density_fluctuations(R.series(spark, sf_dir), ["sample_id"], "y"), ["sample_id"])


@query(
    "trajectory_features",
    f"""{with_relations("ensemble")}, m AS (SELECT sample_id, realization AS t, avg(v) AS mean, stddev_samp(v) AS std FROM ensemble GROUP BY ALL),
w AS (SELECT *, lag(mean, 1) OVER o AS m1, lag(mean, 2) OVER o AS m2 FROM m WINDOW o AS (PARTITION BY sample_id ORDER BY t))
SELECT sample_id, {r("avg(mean)")} AS mean, {r("avg(std)")} AS std, {r("avg(abs(mean - m1))")} AS speed, {r("avg(abs(mean - 2 * m1 + m2))")} AS acceleration FROM w GROUP BY sample_id""",
)
def trajectory_features(spark: SparkSession, sf_dir: str) -> DataFrame:

    m = R.ensemble(spark, sf_dir).groupBy("sample_id", F.col("realization").alias("t")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    o = Window.partitionBy("sample_id").orderBy("t")
    m = m.withColumns({"m1": F.lag("mean", 1).over(o), "m2": F.lag("mean", 2).over(o)})
    out = m.groupBy("sample_id").agg(
        F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg(F.abs(F.col("mean") - F.col("m1"))).alias("speed"),
        F.avg(F.abs(F.col("mean") - 2 * F.col("m1") + F.col("m2"))).alias("acceleration"),
    )
    return rounded(out, ["sample_id"])


@query("context_mean_std", f"{with_relations('series')} SELECT c, {r('avg(y)', 4)} AS mean, {r('stddev_samp(y)', 4)} AS std FROM series GROUP BY c")
def context_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.reduce_over(R.series(spark, sf_dir), ["c"], "y", ["mean", "std"]), ["c"], 4)


@query(
    "rollout_metrics",
    f"""{with_relations("ensemble")}, b AS (SELECT a.sample_id, a.realization AS t, a.v, p.v AS before FROM ensemble a LEFT JOIN ensemble p ON a.sample_id = p.sample_id AND a.y = p.y AND a.x = p.x AND a.realization = p.realization + 1)
SELECT sample_id, t, {r("sum(v * v)")} AS energy, {r("var_samp(v)")} AS variance, {r("avg(abs(v))")} AS mean_magnitude, {r("corr(v, before)")} AS autocorrelation FROM b GROUP BY sample_id, t""",
)
def rollout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.rollout_metrics(R.ensemble(spark, sf_dir).withColumnRenamed("realization", "t"), ["sample_id"]), ["sample_id", "t"])


@query("rollout_entropy", _bins_sql(50, _EQUAL) + f"SELECT sample_id, {r('-sum(p * ln(p))')} AS entropy FROM p GROUP BY sample_id")
def rollout_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.histogram(R.cells(spark, sf_dir), ["sample_id"], bins=50).select("sample_id", "entropy"), ["sample_id"])


@query(
    "ensemble_maps",
    f"""{with_relations("ensemble")} SELECT sample_id, y, x, {r("avg(v)")} AS mean, {r("var_samp(v)")} AS variance, {r("stddev_samp(v)")} AS std, {r("max(v) - min(v)")} AS envelope FROM ensemble GROUP BY sample_id, y, x""",
)
def ensemble_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.ensemble_maps(R.ensemble(spark, sf_dir)), ["sample_id", "y", "x"])


@query(
    "ensemble_channel_norms",
    f"""{with_relations("ensemble")}, m AS (SELECT sample_id, y, x, var_samp(v) AS a, stddev_samp(v) AS b, max(v) - min(v) AS e FROM ensemble GROUP BY ALL)
SELECT sample_id, x, {r("sqrt(sum(a * a))")} AS variance_norm, {r("sqrt(sum(b * b))")} AS std_norm, {r("sqrt(sum(e * e))")} AS envelope_norm FROM m GROUP BY sample_id, x""",
)
def ensemble_channel_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.ensemble_maps(R.ensemble(spark, sf_dir))  # rows stand for channels here
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    out = m.groupBy("sample_id", "x").agg(norm("variance").alias("variance_norm"), norm("std").alias("std_norm"), norm("envelope").alias("envelope_norm"))
    return rounded(out, ["sample_id", "x"])


@query(
    "entropy_map",
    f"""{with_relations("ensemble")}, g AS (SELECT min(v) AS lo, max(v) AS hi FROM ensemble),
b AS (SELECT sample_id, y, x, least(floor((v - lo) / (hi - lo) * 32), 31) AS bin, count(*) AS n FROM ensemble, g GROUP BY ALL),
p AS (SELECT sample_id, y, x, n / sum(n) OVER (PARTITION BY sample_id, y, x) AS p FROM b)
SELECT sample_id, y, x, {r("-sum(p * log2(p))")} AS entropy FROM p GROUP BY sample_id, y, x""",
)
def entropy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.entropy_map(R.ensemble(spark, sf_dir)), ["sample_id", "y", "x"])


@query(
    "ssim_neighbours",
    f"""{with_relations("ensemble")}, m AS (SELECT a.sample_id, a.realization, avg(a.v) AS ma, avg(b.v) AS mb, var_samp(a.v) AS va, var_samp(b.v) AS vb, covar_pop(a.v, b.v) AS cab
  FROM ensemble a JOIN ensemble b ON a.sample_id = b.sample_id AND a.y = b.y AND a.x = b.x AND b.realization = a.realization + 1 GROUP BY ALL)
SELECT sample_id, realization, {r("(2 * ma * mb + 1e-4) * (2 * cab + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))")} AS ssim FROM m""",
)
def ssim_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.ssim_neighbours(R.ensemble(spark, sf_dir)), ["sample_id", "realization"])


@query(
    "ssim_pairs",
    f"""WITH e AS (SELECT label AS sample_id, vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT sample_id, vec_id, x, list_avg(x) AS m, list_var_samp(x) AS v FROM e),
p AS (SELECT a.sample_id, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb, list_dot_product(a.x, b.x) / 64 - a.m * b.m AS cab FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.vec_id < b.vec_id)
SELECT sample_id, count(*) AS pairs, {r("avg((2 * ma * mb + 1e-4) * (2 * cab + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)))")} AS ssim FROM p GROUP BY sample_id""",
)
def ssim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.ssim_pairs(R.members(spark, sf_dir)), ["sample_id", "pairs"])


def _rolled(c: str, dy: int, dx: int) -> str:
    """The value at a periodic neighbour."""
    return f"{c}[((y + {dy + 8}) % 8) * 8 + (x + {dx + 8}) % 8 + 1]"


@query(
    "spatial_flow",
    f"""WITH e AS (SELECT label AS sample_id, vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS a, lead(list_transform(embedding, lambda z: CAST(z AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT sample_id, vec_id, ({_rolled("a", 0, 1)} - {_rolled("a", 0, -1)}) / 2 AS gx, ({_rolled("a", 1, 0)} - {_rolled("a", -1, 0)}) / 2 AS gy, b[y * 8 + x + 1] AS q
  FROM e, (SELECT i // 8 AS y, i % 8 AS x FROM range(64) r(i)) WHERE b IS NOT NULL),
f AS (SELECT sample_id, vec_id, covar_pop(gx, q) / (stddev_samp(gx) * stddev_samp(q) + 1e-8) AS fx, covar_pop(gy, q) / (stddev_samp(gy) * stddev_samp(q) + 1e-8) AS fy FROM c GROUP BY ALL)
SELECT sample_id, {r("avg(sqrt(fx * fx + fy * fy + 1e-8))")} AS flow_magnitude, {r("avg(abs(fx) / (abs(fy) + 1e-8))", 4)} AS flow_anisotropy FROM f GROUP BY sample_id""",
)
def spatial_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = D.spatial_flow(R.ensemble_fields(spark, sf_dir).withColumnRenamed("realization", "t"), ["sample_id"])
    return flow.select("sample_id", S.rounded("flow_magnitude").alias("flow_magnitude"), S.rounded("flow_anisotropy", 4).alias("flow_anisotropy"))


@query(
    "partition_operators",
    """SELECT p_brand AS brand, CAST(greatest(p_size // 16 * 16, 16) AS INT) AS channels, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY ALL""",
)
def partition_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = R.table(spark, sf_dir, "part")
    return D.partition_by_signature(part, {"brand": F.col("p_brand"), "channels": D.bucket_floor(F.col("p_size"), 16)}, "p_partkey")


@query(
    "partition_stats",
    f"""WITH g AS (SELECT p_brand, greatest(p_size // 16 * 16, 16) AS c, count(*) AS n FROM part GROUP BY ALL)
SELECT count(*) AS partitions, min(n) AS smallest, max(n) AS largest, {r("avg(n)")} AS mean_size FROM g""",
)
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_operators(spark, sf_dir).agg(
        F.count("*").alias("partitions"), F.min("n").alias("smallest"), F.max("n").alias("largest"), S.rounded(F.avg("n")).alias("mean_size")
    )


@query(
    "group_by_grid_size",
    "SELECT CAST(16 * power(2, p_size % 3) AS INT) AS grid_size, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY ALL",
)
def group_by_grid_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (16 * F.pow(F.lit(2), F.col("p_size") % 3)).cast("int")
    return D.partition_by_signature(R.table(spark, sf_dir, "part"), {"grid_size": size}, "p_partkey")


@query(
    "timing_stats",
    f"""SELECT event_type, count(*) AS n, {r("sum(value)", 3)} AS total, {r("min(value)")} AS min, {r("max(value)")} AS max, {r("avg(value)", 4)} AS mean, {r("sum(value) / count(DISTINCT user_id)", 3)} AS per_sample FROM events GROUP BY event_type""",
)
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = R.table(spark, sf_dir, "events"), "value"
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), S.rounded(F.sum(v), 3).alias("total"), S.rounded(F.min(v)).alias("min"), S.rounded(F.max(v)).alias("max"),
        S.rounded(F.avg(v), 4).alias("mean"), S.rounded(F.sum(v) / F.count_distinct("user_id"), 3).alias("per_sample"),
    )


@query(
    "category_rollup",
    f"SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS week, count(*) AS n, {r('sum(value)', 3)} AS total FROM events GROUP BY ROLLUP (event_type, week)",
)
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events").withColumn("week", (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 7).cast("int"))
    return e.rollup("event_type", "week").agg(F.count("*").alias("n"), S.rounded(F.sum("value"), 3).alias("total"))
