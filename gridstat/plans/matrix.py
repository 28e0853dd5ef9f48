"""Queries of feature matrices, codes and sampling quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.functions import sizes as Z
from gridstat.functions import stats as S
from gridstat.operators import matrix as M
from gridstat.operators import pca as P
from gridstat.operators import ranks as K
from gridstat.plans.descriptive import rounded
from gridstat.plans.registry import query, r, with_relations
from gridstat.sources import relations as R

_LINE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
#: A long matrix with a constant, a copied and a patchy feature besides real ones; orders are its samples.
_DIRTY = """dirty AS (SELECT o_orderkey AS sample_id, unnest(['price', 'day', 'constant', 'copy', 'patchy']) AS feature,
  unnest([o_totalprice / 1000, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE), 1.0, o_totalprice / 500, CASE WHEN o_orderkey % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END]) AS value FROM orders)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double")
    patchy = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double"))
    wide = o.select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 1000).alias("price"), day.alias("day"), F.lit(1.0).alias("constant"),
        (F.col("o_totalprice") / 500).alias("copy"), patchy.alias("patchy"),
    )
    return wide.unpivot("sample_id", ["price", "day", "constant", "copy", "patchy"], "feature", "value")


@query(
    "feature_stats",
    f"""WITH {_DIRTY}, v AS (SELECT feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM dirty)
SELECT feature, count(*) AS n, count(*) - count(v) AS n_missing, {r("avg(v)", 5)} AS mean, {r("stddev_pop(v)", 5)} AS std, {r("var_pop(v)", 2)} AS variance FROM v GROUP BY feature""",
)
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.feature_stats(dirty(spark, sf_dir))
    return out.select("feature", "n", "n_missing", *[S.rounded(c, 2 if c == "variance" else 5).alias(c) for c in ("mean", "std", "variance")])


@query(
    "variance_mask",
    f"WITH {_DIRTY}, v AS (SELECT feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM dirty) SELECT feature, stddev_pop(v) > 1e-10 AND NOT (var_pop(v) > 1e10 AND stddev_pop(v) / (abs(avg(v)) + 1e-10) > 100) AS keep FROM v GROUP BY feature",
)
def variance_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.variance_mask(dirty(spark, sf_dir))


@query(
    "informativeness",
    f"""{with_relations("features")}, q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi, count(*) AS total FROM features GROUP BY feature),
d AS (SELECT feature, value, q1, q3, total, least(floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 25), 24) AS bin FROM features JOIN q USING (feature)),
n AS (SELECT feature, bin, count(*) AS n, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o, any_value(q3 - q1) AS iqr, any_value(total) AS total FROM d GROUP BY feature, bin)
SELECT feature, {r("-sum(n / total * ln(n / total)) * any_value(iqr) * (1 - sum(o) / any_value(total))")} AS informativeness FROM n GROUP BY feature""",
)
def informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.informativeness(R.features(spark, sf_dir)), ["feature"])


@query(
    "greedy_dedup",
    f"""WITH RECURSIVE {_DIRTY}, v AS (SELECT sample_id, feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM dirty),
m AS (SELECT feature, median(v) AS med FROM v GROUP BY feature), f AS (SELECT sample_id, feature, coalesce(v, med) AS value FROM v JOIN m USING (feature)),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi, count(*) AS total FROM f GROUP BY feature),
d AS (SELECT feature, value, q1, q3, total, least(floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 25), 24) AS bin FROM f JOIN q USING (feature)),
n AS (SELECT feature, bin, count(*) AS n, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o, any_value(q3 - q1) AS iqr, any_value(total) AS total FROM d GROUP BY feature, bin),
i AS (SELECT feature, -sum(n / total * ln(n / total)) * any_value(iqr) * (1 - sum(o) / any_value(total)) AS score FROM n GROUP BY feature),
r AS (SELECT a.feature AS a, b.feature AS b FROM f a JOIN f b USING (sample_id) JOIN q x ON x.feature = a.feature JOIN q y ON y.feature = b.feature
  WHERE a.feature <> b.feature AND x.hi > x.lo AND y.hi > y.lo GROUP BY ALL HAVING abs(corr(a.value, b.value)) >= 0.99),
o AS (SELECT i.feature, row_number() OVER (ORDER BY score DESC, i.feature) AS n, coalesce(c.close, []) AS close FROM i LEFT JOIN (SELECT a AS feature, list(b) AS close FROM r GROUP BY a) c USING (feature)),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT o.n, CASE WHEN list_has_any(kept, close) THEN kept ELSE list_append(kept, o.feature) END FROM walk JOIN o ON o.n = walk.n + 1)
SELECT unnest(kept) AS feature FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)""",
)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = M.fill_missing(dirty(spark, sf_dir))
    return spark.createDataFrame([(f,) for f in M.greedy_dedup(clean, 0.99)], "feature string")


@query(
    "clean_features",
    f"""WITH {_DIRTY}, v AS (SELECT sample_id, feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM dirty WHERE feature <> 'constant'),
m AS (SELECT feature, median(v) AS med FROM v GROUP BY feature), f AS (SELECT sample_id, feature, coalesce(v, med) AS v FROM v JOIN m USING (feature)),
q AS (SELECT feature, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM f GROUP BY feature)
SELECT feature, count(*) AS n, {r("avg(least(greatest(v, lo), hi))", 4)} AS mean, {r("min(greatest(v, lo))", 4)} AS min, {r("max(least(v, hi))", 4)} AS max FROM f JOIN q USING (feature) GROUP BY feature""",
)
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance filter, then medians for missing values, then caps at percentiles."""
    d = dirty(spark, sf_dir)
    kept = d.join(F.broadcast(M.variance_mask(d).where("keep").select("feature")), "feature", "left_semi")  # five features at most
    out = M.cap(M.fill_missing(kept), "percentile")
    return out.groupBy("feature").agg(
        F.count("*").alias("n"), S.rounded(F.avg("value"), 4).alias("mean"), S.rounded(F.min("value"), 4).alias("min"), S.rounded(F.max("value"), 4).alias("max")
    )


@query(
    "missing_counts",
    f"WITH {_DIRTY} SELECT feature, count(*) FILTER (WHERE isnan(value)) AS n_nan, count(*) FILTER (WHERE isnan(value)) = count(*) AS all_nan FROM dirty GROUP BY feature",
)
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).groupBy("feature").agg(F.count_if(F.isnan("value")).alias("n_nan"), F.every(F.isnan("value")).alias("all_nan"))


_CAPS = {
    "iqr": "q AS (SELECT feature, quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM features GROUP BY feature)",
    "mad": "m AS (SELECT feature, median(value) AS med FROM features GROUP BY feature), d AS (SELECT feature, any_value(med) AS med, median(abs(value - med)) AS mad FROM features JOIN m USING (feature) GROUP BY feature), q AS (SELECT feature, med - 3 * mad AS lo, med + 3 * mad AS hi FROM d)",
}
for _s, _cte in _CAPS.items():
    query(
        f"cap_{_s}",
        f"{with_relations('features')}, {_cte} SELECT feature, count(*) FILTER (WHERE value < lo OR value > hi) AS n_outliers, {r('min(greatest(value, lo))')} AS min, {r('max(least(value, hi))')} AS max FROM features JOIN q USING (feature) GROUP BY feature",
    )(lambda spark, sf_dir, s=_s: _capped(spark, sf_dir, s))


def _capped(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    f = R.features(spark, sf_dir)
    both = M.cap(f.withColumn("raw", F.col("value")), strategy)
    return both.groupBy("feature").agg(F.count_if(F.col("value") != F.col("raw")).alias("n_outliers"), S.rounded(F.min("value")).alias("min"), S.rounded(F.max("value")).alias("max"))


@query(
    "standardize",
    f"{with_relations('features')}, s AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM features GROUP BY feature) SELECT sample_id, {r('sum(abs((value - mu) / sd))', 5)} AS total FROM features JOIN s USING (feature) GROUP BY sample_id",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.standardize(R.features(spark, sf_dir)).groupBy("sample_id").agg(S.rounded(F.sum(F.abs("value")), 5).alias("total"))


@query(
    "standardize_by_category",
    f"{with_relations('features')}, s AS (SELECT feature // 16 AS category, avg(value) AS mu, stddev_pop(value) AS sd FROM features GROUP BY 1) SELECT sample_id, category, {r('sum((value - mu) / sd)', 5)} AS total FROM features JOIN s ON feature // 16 = category GROUP BY ALL",
)
def standardize_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.features(spark, sf_dir).withColumn("category", F.expr("feature div 16").cast("int"))
    return M.standardize(f, ["category"], ddof=0).groupBy("sample_id", "category").agg(S.rounded(F.sum("value"), 5).alias("total"))


@query(
    "robust_normalize",
    f"""{with_relations("features")}, m AS (SELECT feature, median(value) AS med FROM features GROUP BY feature), d AS (SELECT feature, any_value(med) AS med, greatest(1.4826 * median(abs(value - med)), 1e-8) AS s FROM features JOIN m USING (feature) GROUP BY feature)
SELECT sample_id, {r("sum(abs((value - med) / s))", 5)} AS total FROM features JOIN d USING (feature) GROUP BY sample_id""",
)
def robust_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.robust(R.features(spark, sf_dir)).groupBy("sample_id").agg(S.rounded(F.sum(F.abs("value")), 5).alias("total"))


@query(
    "l2_normalize",
    f"{with_relations('features')}, n AS (SELECT sample_id, greatest(sqrt(sum(value * value)), 1e-8) AS n FROM features GROUP BY sample_id) SELECT sample_id, {r('sum(abs(value / n))')} AS total FROM features JOIN n USING (sample_id) GROUP BY sample_id",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), M.l2_rows(F.col("embedding").cast("array<double>")).alias("v"))
    return e.select("sample_id", S.rounded(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("total"))


@query(
    "min_max_normalize",
    f"{with_relations('cells')}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM cells) SELECT sample_id, {r('avg(least(greatest((v - lo) / (hi - lo), 0.1), 0.9))')} AS mean FROM cells, b GROUP BY sample_id",
)
def min_max_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescale by the range of the whole table, then clamp."""
    c = R.cells(spark, sf_dir)
    b = c.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    held = S.clipped((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.1), F.lit(0.9))
    return c.join(F.broadcast(b)).groupBy("sample_id").agg(S.rounded(F.avg(held)).alias("mean"))  # one row


@query(
    "percentile_normalize",
    f"{with_relations('cells')}, b AS (SELECT sample_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM cells GROUP BY sample_id) SELECT sample_id, {r('avg((least(greatest(v, lo), hi) - lo) / (hi - lo + 1e-8))')} AS mean FROM cells JOIN b USING (sample_id) GROUP BY sample_id",
)
def percentile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.cells(spark, sf_dir)
    b = K.quantiles(c, ["sample_id"], "v", [0.05, 0.95])
    lo, hi = F.col("q")[0], F.col("q")[1]
    return c.join(b, "sample_id").groupBy("sample_id").agg(S.rounded(F.avg((S.clipped("v", lo, hi) - lo) / (hi - lo + S.EPS))).alias("mean"))


_CORR = "corr AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS r FROM features a JOIN features b USING (sample_id) WHERE a.feature < b.feature GROUP BY ALL)"


@query("feature_correlations", f"{with_relations('features')}, {_CORR} SELECT f1, f2, {r('r')} AS r, {r('1 - abs(r)')} AS distance FROM corr")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.correlations(R.features(spark, sf_dir)).withColumn("distance", 1 - F.abs("r")), ["f1", "f2"])


@query("max_correlation", f"{with_relations('features')}, {_CORR} SELECT {r('max(abs(r))')} AS max_correlation FROM corr")
def max_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.correlations(R.features(spark, sf_dir)).agg(S.rounded(F.max(F.abs("r"))).alias("max_correlation"))


@query("pca_modes")
def pca_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance along the first three directions of all vectors, and their largest entries."""
    c = P.fit(_vectors(spark, sf_dir), "vec", 3)
    rows = [(i, float(v), float(s), int(abs(u).argmax()), float(u.max())) for i, (v, s, u) in enumerate(zip(c.variances, c.shares, c.directions, strict=True))]
    out = spark.createDataFrame(rows, "mode int, variance double, share double, feature int, entry double")
    return rounded(out, ["mode", "feature"])


@query("pca_project")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's coordinates along the first three directions, between 0 and 1 as colours need them."""
    v = _vectors(spark, sf_dir)
    c = P.fit(v, "vec", 3)
    at = v.select("vec_id", F.posexplode(P.project(F.col("vec"), c.mean, c.directions)).alias("mode", "score"))
    ends = at.groupBy("mode").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    shown = P.spread(F.col("score"), F.col("low"), F.col("high"))
    return at.join(F.broadcast(ends), "mode").select("vec_id", "mode", S.rounded("score", 5).alias("score"), S.rounded(shown, 5).alias("shade"))  # a row a direction


@query(
    "label_axes",
    f"""{with_relations("codebook")}, m AS (SELECT p AS feature, avg(CAST(embedding[p + 1] AS DOUBLE)) AS m FROM embeddings, range(64) r(p) GROUP BY p),
u AS (SELECT code, feature, e - m AS u FROM codebook JOIN m USING (feature) WHERE code < 3), l AS (SELECT code, sqrt(sum(u * u)) AS l FROM u GROUP BY code)
SELECT vec_id, code AS axis, {r("sum((CAST(embedding[feature + 1] AS DOUBLE) - m) * u / l)", 5)} AS score FROM embeddings, u JOIN l USING (code) JOIN m USING (feature) GROUP BY vec_id, code""",
)
def label_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's coordinates along the directions from the mean to the first three labels' means."""
    v = _vectors(spark, sf_dir)
    mean = np.array(v.agg(F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(64)])).first()[0], dtype=float)
    axes = np.array([r["vec"] for r in R.codebook(spark, sf_dir).where("code < 3").orderBy("code").collect()]) - mean
    axes /= np.sqrt((axes * axes).sum(axis=1, keepdims=True))
    return v.select("vec_id", F.posexplode(P.project(F.col("vec"), mean, axes)).alias("axis", "score")).withColumn("score", S.rounded("score", 5))


@query("feature_linkage")
def feature_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.feature_linkage(R.features(spark, sf_dir)), ["step", "a", "b", "size"])


@query("group_counts")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What silhouette and elbow choose the number of groups by."""
    out = M.group_counts(R.features(spark, sf_dir))
    return out.select("k", *[S.rounded(c).alias(c) for c in ("silhouette", "spread")], F.array_join("groups", " ").alias("groups"))


@query("feature_groups")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feature_groups(R.features(spark, sf_dir))


@query(
    "group_statistics",
    f"{with_relations('features')}, {_CORR} SELECT f1 // 16 = f2 // 16 AS within, count(*) AS pairs, {r('avg(abs(r))')} AS mean_abs, {r('max(abs(r))')} AS max_abs FROM corr GROUP BY 1",
)
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.range(64).select(F.col("id").cast("int").alias("feature"), F.expr("id div 16").alias("group"))
    return rounded(M.group_statistics(M.correlations(R.features(spark, sf_dir)), groups), ["within"])


@query(
    "group_centroid_error",
    f"""{with_relations("features")}, c AS (SELECT sample_id, feature // 16 AS g, avg(value) AS m FROM features GROUP BY ALL) SELECT g, {r("avg(pow(value - m, 2))")} AS error FROM features f JOIN c ON c.sample_id = f.sample_id AND c.g = f.feature // 16 GROUP BY g""",
)
def group_centroid_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance of features from their group's mean in each sample."""
    f = R.features(spark, sf_dir).withColumn("g", F.expr("feature div 16").cast("int"))
    c = f.groupBy("sample_id", "g").agg(F.avg("value").alias("m"))
    return f.join(c, ["sample_id", "g"]).groupBy("g").agg(S.rounded(F.avg((F.col("value") - F.col("m")) * (F.col("value") - F.col("m")))).alias("error"))


@query(
    "category_characteristics",
    f"""{with_relations("features")}, v AS (SELECT feature, var_pop(value) AS v FROM features GROUP BY feature), {_CORR},
c AS (SELECT f1 // 16 AS g, avg(abs(r)) AS m FROM corr WHERE f1 // 16 = f2 // 16 GROUP BY 1)
SELECT g, {r("median(v)")} AS median_variance, {r("ln(count(*))")} AS log_dim, {r("any_value(m)")} AS mean_abs_correlation FROM v JOIN c ON g = feature // 16 GROUP BY g""",
)
def category_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.features(spark, sf_dir)
    g = lambda c: F.expr(f"{c} div 16").cast("int")
    v = f.groupBy("feature").agg(F.var_pop("value").alias("v")).groupBy(g("feature").alias("g")).agg(F.median("v").alias("median_variance"), F.log(F.count("*")).alias("log_dim"))
    c = M.correlations(f).where(g("f1") == g("f2")).groupBy(g("f1").alias("g")).agg(F.avg(F.abs("r")).alias("mean_abs_correlation"))
    return rounded(v.join(c, "g"), ["g"])


_POINTS = "pts AS (SELECT (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS a, (CAST(embedding[2] AS DOUBLE) + 1) / 2 AS b, (CAST(embedding[3] AS DOUBLE) + 1) / 2 AS c FROM embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling design: the first three coordinates of every vector, moved into the unit cube."""
    e = R.table(spark, sf_dir, "embeddings")
    return e.select(*[((F.col("embedding")[i].cast("double") + 1) / 2).alias(n) for i, n in enumerate("abc")])


def _factor(x: str) -> str:
    return f"(1 + 0.5 * abs({x} - 0.5) - 0.5 * pow({x} - 0.5, 2))"


def _pair(d: str) -> str:
    return f"(1 + 0.5 * abs(x.{d} - 0.5) + 0.5 * abs(y.{d} - 0.5) - 0.5 * abs(x.{d} - y.{d}))"


@query(
    "centred_discrepancy",
    f"""WITH {_POINTS} SELECT {r(f"pow(13.0 / 12, 3) - 2.0 / (SELECT count(*) FROM pts) * (SELECT sum({_factor('a')} * {_factor('b')} * {_factor('c')}) FROM pts) + (SELECT sum({_pair('a')} * {_pair('b')} * {_pair('c')}) FROM pts x, pts y) / pow((SELECT count(*) FROM pts), 2)")} AS discrepancy""",
)
def centred_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.centred_discrepancy(_points(spark, sf_dir), ["a", "b", "c"]), [])


_SUMS = {
    "WD": ("-pow(4.0 / 3, 3)", "0", "1.0", "(1.5 - abs(x.{d} - y.{d}) * (1 - abs(x.{d} - y.{d})))"),
    "MD": (
        "pow(19.0 / 12, 3)", "-2.0", "(5.0 / 3 - 0.25 * abs({d} - 0.5) - 0.25 * pow({d} - 0.5, 2))",
        "(15.0 / 8 - 0.25 * abs(x.{d} - 0.5) - 0.25 * abs(y.{d} - 0.5) - 0.75 * abs(x.{d} - y.{d}) + 0.5 * pow(x.{d} - y.{d}, 2))",
    ),
    "L2-star": ("1.0 / 27", "-0.25", "(1 - {d} * {d})", "(1 - greatest(x.{d}, y.{d}))"),
}


def _discrepancy_sql(method: str) -> str:
    constant, factor, point, pair = _SUMS[method]
    one, two = (" * ".join(t.format(d=d) for d in "abc") for t in (point, pair))
    n = "(SELECT count(*) FROM pts)"
    out = f"{constant} + {factor} / {n} * (SELECT sum({one}) FROM pts) + (SELECT sum({two}) FROM pts x, pts y) / pow({n}, 2)"
    return f"WITH {_POINTS} SELECT {r(f'sqrt({out})' if method == 'L2-star' else out)} AS discrepancy"


for _name, _method in (("wraparound_discrepancy", "WD"), ("modified_discrepancy", "MD"), ("star_discrepancy", "L2-star")):
    query(_name, _discrepancy_sql(_method))(lambda spark, sf_dir, method=_method: rounded(M.discrepancy(_points(spark, sf_dir), ["a", "b", "c"], method), []))


@query(
    "coverage_uniformity",
    f"""WITH {_POINTS}, b AS (SELECT least(floor(a * 4), 3) AS a, least(floor(b * 4), 3) AS b, least(floor(c * 4), 3) AS c, count(*) AS n FROM pts GROUP BY 1, 2, 3), t AS (SELECT sum(n) / 64.0 AS e FROM b)
SELECT {r("sum(pow(n - e, 2) / e) + (64 - count(*)) * any_value(e)", 4)} AS chi_square FROM b, t""",
)
def coverage_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.coverage(_points(spark, sf_dir), ["a", "b", "c"], 4), [], 4)


@query(
    "min_distance",
    f"WITH {_POINTS}, q AS (SELECT *, row_number() OVER () AS i FROM pts) SELECT {r('min(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2)))')} AS min_distance FROM q x JOIN q y ON x.i < y.i",
)
def min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.min_distance(_points(spark, sf_dir), ["a", "b", "c"]), [])


_ROOT = "sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2))"


@query(
    "sample_quality",
    f"""WITH {_POINTS}, q AS (SELECT *, row_number() OVER () AS i FROM pts), b AS (SELECT count(*) AS n FROM pts GROUP BY least(floor(a * 4), 3), least(floor(b * 4), 3), least(floor(c * 4), 3)), t AS (SELECT sum(n) / 64.0 AS e FROM b),
o AS (SELECT pow(13.0 / 12, 3) - 2.0 / (SELECT count(*) FROM pts) * (SELECT sum({_factor("a")} * {_factor("b")} * {_factor("c")}) FROM pts) + (SELECT sum({_pair("a")} * {_pair("b")} * {_pair("c")}) FROM pts x, pts y) / pow((SELECT count(*) FROM pts), 2) AS discrepancy,
  (SELECT greatest(abs(corr(a, b)), abs(corr(a, c)), abs(corr(b, c)), 0) FROM pts) AS max_correlation, (SELECT sum(pow(n - e, 2) / e) + (64 - count(*)) * any_value(e) FROM b, t) AS chi_square,
  (SELECT min({_ROOT}) FROM q x JOIN q y ON x.i < y.i) AS min_distance)
SELECT {r("discrepancy")} AS discrepancy, {r("max_correlation")} AS max_correlation, {r("chi_square")} AS chi_square, {r("min_distance")} AS min_distance, discrepancy <= 0.01 AND max_correlation <= 0.05 AS passed FROM o""",
)
def sample_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.sample_quality(_points(spark, sf_dir), ["a", "b", "c"], 4), ["passed"])


# --- codes

_TOKENS = f"""{with_relations("codebook")}, d AS (SELECT vec_id, code, sqrt(sum(pow(CAST(embedding[feature + 1] AS DOUBLE) - e, 2))) AS d FROM embeddings, codebook GROUP BY ALL),
tokens AS (SELECT vec_id, arg_min(code, (d, code)) AS code, min(d) AS distance FROM d GROUP BY vec_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assign_codes(_vectors(spark, sf_dir), R.codebook(spark, sf_dir))


@query("assign_codes", f"{_TOKENS} SELECT vec_id, code, {r('distance')} AS distance FROM tokens")
def assign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tokens(spark, sf_dir).select("vec_id", "code", "distance"), ["vec_id", "code"])


@query(
    "codebook_lookup",
    f"{_TOKENS} SELECT vec_id, {r('sum(abs(e))')} AS code_l1 FROM tokens JOIN codebook USING (code) GROUP BY vec_id",
)
def codebook_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = R.codebook(spark, sf_dir).withColumnRenamed("vec", "entry")
    t = _tokens(spark, sf_dir).select("vec_id", "code").join(book, "code")
    return t.select("vec_id", S.rounded(F.aggregate("entry", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("code_l1"))


@query("code_usage", f"{_TOKENS} SELECT c.code, count(t.vec_id) AS n FROM (SELECT DISTINCT code FROM codebook) c LEFT JOIN tokens t ON c.code = t.code GROUP BY c.code")
def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.code_usage(_tokens(spark, sf_dir), R.codebook(spark, sf_dir))


@query(
    "codebook_metrics",
    f"""{_TOKENS}, u AS (SELECT c.code, count(t.vec_id) AS n FROM (SELECT DISTINCT code FROM codebook) c LEFT JOIN tokens t ON c.code = t.code GROUP BY c.code), p AS (SELECT n, n / sum(n) OVER () AS p FROM u)
SELECT {r("count(*) FILTER (WHERE n > 0) / count(*)")} AS utilization, {r("exp(-sum(CASE WHEN n > 0 THEN p * ln(p) ELSE 0 END))")} AS perplexity, {r("sum(n) / count(*) FILTER (WHERE n > 0)")} AS mean_active_usage FROM p""",
)
def codebook_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.usage_metrics(M.code_usage(_tokens(spark, sf_dir), R.codebook(spark, sf_dir))), [])


@query(
    "dead_codes",
    f"""{_TOKENS}, u AS (SELECT c.code, count(t.vec_id) AS n FROM (SELECT DISTINCT code FROM codebook) c LEFT JOIN tokens t ON c.code = t.code GROUP BY c.code), q AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.1) AS q FROM u)
SELECT code, n FROM u, q WHERE n <= q ORDER BY n, code LIMIT 2""",
)
def dead_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes at or below the tenth percentile of use, a quarter of all at most: those to be replaced."""
    u = M.code_usage(_tokens(spark, sf_dir), R.codebook(spark, sf_dir))
    q = u.agg(F.percentile("n", 0.1).alias("q"), F.floor(F.count("*") / 4).alias("most"))
    found = u.join(F.broadcast(q)).where("n <= q")  # one row
    n = q.first()["most"]
    return found.orderBy("n", "code").limit(int(n)).select("code", "n")


@query(
    "reconstruction_error",
    f"{_TOKENS} SELECT label, {r('avg(pow(CAST(embedding[feature + 1] AS DOUBLE) - e, 2))')} AS mse FROM tokens JOIN embeddings USING (vec_id) JOIN codebook USING (code) GROUP BY label",
)
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return t.groupBy("label").agg(S.rounded(F.avg(F.col("distance") * F.col("distance") / F.size("vec"))).alias("mse"))


@query(
    "quality_score",
    f"""{_TOKENS}, l AS (SELECT label, avg(pow(CAST(embedding[feature + 1] AS DOUBLE) - e, 2)) AS mse, count(DISTINCT code) / 10.0 AS u FROM tokens JOIN embeddings USING (vec_id) JOIN codebook USING (code) GROUP BY label),
k AS (SELECT *, row_number() OVER (ORDER BY mse) AS k FROM l), g AS (SELECT 2 * sum(k * mse) / (count(*) * sum(mse)) - (count(*) + 1) / count(*) AS g, avg(mse) AS e, avg(u) AS u FROM k)
SELECT {r("e")} AS error, {r("greatest(0, least(1, 1 - e))")} AS quality, {r("g")} AS gini, {r("pow(greatest(0, least(1, 1 - e)) / (1 + exp(-20 * (u - 0.25))) * (1 - g), 1.0 / 3)")} AS score FROM g""",
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    codes = 10.0
    per = t.groupBy("label").agg(F.avg(F.col("distance") * F.col("distance") / F.size("vec")).alias("mse"), (F.count_distinct("code") / codes).alias("u"))
    both = per.agg(F.avg("mse").alias("error"), F.avg("u").alias("u")).join(M.gini(per, "mse"), how="cross")  # one row each
    quality = S.clipped(1 - F.col("error"), F.lit(0.0), F.lit(1.0))
    return both.select(
        S.rounded("error").alias("error"), S.rounded(quality).alias("quality"), S.rounded("gini").alias("gini"), S.rounded(M.three_factor_quality(F.col("error"), F.col("u"), F.col("gini"))).alias("score")
    )


@query(
    "category_tokens",
    f"{_TOKENS} SELECT label, count(DISTINCT code) AS tokens, {r('count(DISTINCT code) / 10')} AS utilization FROM tokens JOIN embeddings USING (vec_id) GROUP BY label",
)
def category_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).groupBy("label").agg(F.count_distinct("code").alias("tokens"), S.rounded(F.count_distinct("code") / 10).alias("utilization"))


@query(
    "topographic_similarity",
    f"""{_TOKENS}, s AS (SELECT vec_id, embedding, code FROM tokens JOIN embeddings USING (vec_id)), v AS (SELECT code, list(e ORDER BY feature) AS vec FROM codebook GROUP BY code),
w AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x, vec FROM s JOIN v USING (code))
SELECT {r("corr(list_distance(a.x, b.x), list_distance(a.vec, b.vec))")} AS similarity FROM w a JOIN w b ON a.vec_id < b.vec_id""",
)
def topographic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of distances between vectors and between their codes, over all pairs."""
    book = R.codebook(spark, sf_dir).withColumnRenamed("vec", "entry")
    t = _tokens(spark, sf_dir).join(book, "code").select(F.col("vec_id").alias("id"), "vec", "entry")
    return rounded(M.distance_agreement(t, "vec", "entry"), [])


@query(
    "topology_breakdown",
    f"""{_TOKENS}, s AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x, code FROM tokens JOIN embeddings USING (vec_id)), v AS (SELECT code, list(e ORDER BY feature) AS vec FROM codebook GROUP BY code),
w AS (SELECT vec_id, x, x[1:32] AS z, vec FROM s JOIN v USING (code)), q AS (SELECT list_distance(a.x, b.x) AS i, list_distance(a.z, b.z) AS l, list_distance(a.vec, b.vec) AS c FROM w a JOIN w b ON a.vec_id < b.vec_id)
SELECT {r("corr(i, l)")} AS before_codes, {r("corr(l, c)")} AS after_codes, {r("corr(i, c)")} AS end_to_end, {r("corr(i, l) - corr(l, c)")} AS degradation FROM q""",
)
def topology_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of distances from input to latent (the first half of a vector), from latent to code, and from input to code."""
    book = R.codebook(spark, sf_dir).withColumnRenamed("vec", "entry")
    t = _tokens(spark, sf_dir).join(book, "code").select(F.col("vec_id").alias("id"), "vec", F.slice("vec", 1, 32).alias("latent"), "entry")
    out = M.distance_agreements(t, {"before_codes": ("vec", "latent"), "after_codes": ("latent", "entry"), "end_to_end": ("vec", "entry")})
    return rounded(out.withColumn("degradation", F.col("before_codes") - F.col("after_codes")), [])


_SIZES = """k AS (SELECT DISTINCT 4 * p_size AS dim, CAST(power(10, p_partkey % 5 + 2) AS BIGINT) AS n FROM part), b AS (SELECT dim, n, floor(log2(dim) * 7) AS base FROM k),
t AS (SELECT dim, n, CAST(CASE WHEN n > 1000 THEN greatest(floor(base / 4) * 4, least(28, greatest(5, floor(sqrt(n / 1000) * 4.8)))) ELSE floor(base / 4) * 4 END AS INT) AS tokens_0,
  CAST(greatest(6, floor(base / 2)) AS INT) AS tokens_1, CAST(greatest(6, floor(base / 4)) AS INT) AS tokens_2 FROM b)"""


def _own_dims(k: int) -> str:
    return f"(ceil(dim * (1 + 0.8 * pow(dim / 100, 0.7)) / {2**k} * greatest(1, log2(tokens_{k}) / 20) / 4) * 4)"


def _category_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and numbers of samples to size for."""
    part = R.table(spark, sf_dir, "part")
    return part.select((4 * F.col("p_size")).alias("dim"), F.pow(F.lit(10), F.col("p_partkey") % 5 + 2).cast("long").alias("n")).distinct()


@query("default_tokens", f"WITH {_SIZES} SELECT dim, n, tokens_0, tokens_1, tokens_2 FROM t")
def default_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default numbers of tokens of three levels."""
    made = Z.default_tokens(F.col("dim"), F.col("n"))
    return _category_sizes(spark, sf_dir).select("dim", "n", *[c.alias(f"tokens_{k}") for k, c in enumerate(made)])


@query(
    "default_dims",
    f"""WITH {_SIZES}, l0 AS (SELECT *, CASE WHEN n > 1000 THEN greatest(least(64, greatest(8, ceil(log10(n) * 12 / 4) * 4)), {_own_dims(0)}) ELSE greatest(8, {_own_dims(0)}) END AS d0, greatest(8, {_own_dims(1)}) AS o1, greatest(8, {_own_dims(2)}) AS o2 FROM t),
l1 AS (SELECT *, CASE WHEN o1 >= d0 THEN greatest(d0 - 4, floor(d0 / 2), 4) ELSE o1 END AS d1 FROM l0), l2 AS (SELECT *, CASE WHEN o2 >= d1 THEN greatest(d1 - 4, floor(d1 / 2), 4) ELSE o2 END AS d2 FROM l1)
SELECT dim, n, CAST(d0 AS INT) AS dims_0, CAST(d1 AS INT) AS dims_1, CAST(d2 AS INT) AS dims_2, CAST(greatest(4, ceil(dim * 0.4 / 4) * 4) AS INT) AS by_ratio FROM l2""",
)
def default_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default lengths of vectors of three levels, and one by a given ratio."""
    dim, n = F.col("dim"), F.col("n")
    made = Z.default_dims(dim, Z.default_tokens(dim, n), n)
    return _category_sizes(spark, sf_dir).select("dim", "n", *[c.alias(f"dims_{k}") for k, c in enumerate(made)], Z.dims_by_ratio(dim, [F.lit(0.4)])[0].alias("by_ratio"))


def _picked(score: str, table: list, k: int) -> str:
    (a, x), (b, y), (_, z) = table
    return f"CASE WHEN {score} > {a} THEN {x[k]} WHEN {score} > {b} THEN {y[k]} ELSE {z[k]} END"


@query(
    "compression_ratios",
    f"""{with_relations("features")}, v AS (SELECT feature // 16 AS g, feature, var_pop(value * (1 + feature // 16)) AS v FROM features GROUP BY ALL), s AS (SELECT g, least(greatest(median(v) * 10, 0), 1) AS variance, log10(count(*) + 1) / log10(101) AS dimensions FROM v GROUP BY g)
SELECT g, {", ".join(f"CAST({_picked('variance', Z.BY_VARIANCE, k)} AS DOUBLE) AS by_variance_{k}, CAST({_picked('dimensions', Z.BY_DIMENSIONS, k)} AS DOUBLE) AS by_dimensions_{k}" for k in range(3))} FROM s""",
)
def compression_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of three levels for each category of features, by its variance and by its number of features."""
    f = R.features(spark, sf_dir).withColumn("g", F.expr("feature div 16").cast("int"))
    v = f.groupBy("g", "feature").agg(F.var_pop(F.col("value") * (1 + F.col("g"))).alias("v"))
    s = v.groupBy("g").agg(S.clipped(F.median("v") * 10, F.lit(0.0), F.lit(1.0)).alias("variance"), (F.log10(F.count("*") + 1) / F.log10(F.lit(101.0))).alias("dimensions"))
    none = F.lit(0.0)
    made = {n: Z.adaptive_ratios(strategy, F.col("variance"), F.col("dimensions"), none, none) for n, strategy in (("by_variance", "variance"), ("by_dimensions", "dimensionality"))}
    return s.select("g", *[c.alias(f"{n}_{k}") for n, cs in made.items() for k, c in enumerate(cs)])


@query("adaptive_ratios")
def adaptive_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each category of features and the balanced ratios that they give."""
    f = R.features(spark, sf_dir).withColumn("g", F.expr("feature div 16").cast("int"))
    scores = M.category_scores(f, "g")
    made = Z.adaptive_ratios("balanced", *[F.col(c) for c in ("variance", "dimensions", "information", "correlation")])
    out = scores.select("g", *[S.rounded(c).alias(c) for c in ("variance", "dimensions", "information", "correlation")], *[c.alias(f"ratio_{k}") for k, c in enumerate(made)])
    return out


@query(
    "outlier_counts",
    f"""{with_relations("features")}, m AS (SELECT feature, median(value) AS med FROM features GROUP BY feature), a AS (SELECT feature, any_value(med) AS med, median(abs(value - med)) AS mad FROM features JOIN m USING (feature) GROUP BY feature)
SELECT feature, count(*) FILTER (WHERE abs(value - med) > 3 * mad) AS outliers FROM features JOIN a USING (feature) GROUP BY feature""",
)
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outlier_counts(R.features(spark, sf_dir))


@query(
    "codebook_orthogonality",
    f"""{with_relations("codebook")}, v AS (SELECT code, list(e ORDER BY feature) AS vec FROM codebook GROUP BY code) SELECT {r("avg(pow(list_cosine_similarity(a.vec, b.vec), 2))")} AS mean_squared_cosine FROM v a JOIN v b ON a.code <> b.code""",
)
def codebook_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.codebook(spark, sf_dir).select("code", M.l2_rows(F.col("vec")).alias("v"))
    cos = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return b.alias("a").join(b.alias("b"), F.col("a.code") != F.col("b.code")).agg(S.rounded(F.avg(cos * cos)).alias("mean_squared_cosine"))


@query(
    "pairwise_distances",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS x FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, {r("list_distance(a.x, b.x)")} AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id""",
)
def pairwise_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of distances, one row for each pair i < j."""
    return M.pairwise_distances(R.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", digits=6)


@query(
    "category_semantics",
    f"""WITH n AS (SELECT p_type AS category, p_brand AS family, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, family) AS k, sum(n) OVER (PARTITION BY category) AS t FROM n)
SELECT category, family || ' (' || CAST(CAST(floor(100 * n / t) AS INT) AS VARCHAR) || '%)' AS semantics FROM k WHERE k = 1""",
)
def category_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("family")).agg(F.count("*").alias("n"))
    top = n.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("k"), "family")).alias("t"), F.sum("n").alias("total"))
    share = F.floor(100 * -F.col("t.k") / F.col("total")).cast("int").cast("string")
    return top.select("category", F.concat("t.family", F.lit(" ("), share, F.lit("%)")).alias("semantics"))


@query(
    "utilization_matrix",
    "SELECT p_type AS category, count(DISTINCT p_size) FILTER (WHERE p_partkey % 3 = 0) AS level_0, count(DISTINCT p_size) FILTER (WHERE p_partkey % 3 = 1) AS level_1, count(DISTINCT p_size) FILTER (WHERE p_partkey % 3 = 2) AS level_2 FROM part GROUP BY 1",
)
def utilization_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), (F.col("p_partkey") % 3).alias("level"), "p_size")
    return p.groupBy("category").pivot("level", [0, 1, 2]).agg(F.count_distinct("p_size")).toDF("category", "level_0", "level_1", "level_2")


@query("utilization_counts", "SELECT p_type AS category, CAST(count(DISTINCT p_size) AS VARCHAR) || '/50' AS used FROM part GROUP BY 1")
def utilization_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.concat_ws("/", F.count_distinct("p_size").cast("string"), F.lit("50")).alias("used"))
