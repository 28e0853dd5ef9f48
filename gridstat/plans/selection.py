"""Queries of parameters, sorts, samples, registries and rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import params as P
from gridstat.operators import selection as L
from gridstat.plans.descriptive import rounded
from gridstat.plans.registry import query, r, with_relations
from gridstat.sources import relations as R
from gridstat.sources.steps import shared_folder
from gridstat.sources.store import DatasetReader, DatasetWriter

DEPTH = {"kind": "integer", "lo": 1, "hi": 8}
RATE = {"kind": "continuous", "lo": 1e-4, "hi": 1e-1, "log": True}
SCALE = {"kind": "continuous", "lo": -2.0, "hi": 2.0}
ACTIVATION = {"kind": "choice", "choices": ["relu", "gelu", "silu"], "weights": [0.5, 0.3, 0.2]}
NORM = {"kind": "choice", "choices": ["none", "batch", "layer", "group"]}
_U = "u AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS u FROM lineitem)"


def _u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("u"))


@query(
    "decode_parameters",
    f"""WITH {_U} SELECT {r("u", 3)} AS u, CAST(round_even(1 + u * 7, 0) AS INT) AS depth, {r("pow(10, -4 + u * 3)", 9)} AS rate, {r("-2 + u * 4")} AS scale, u > 0.5 AS flag,
  CASE WHEN u < 0.5 THEN 'relu' WHEN u < 0.8 THEN 'gelu' ELSE 'silu' END AS activation, ['none', 'batch', 'layer', 'group'][least(CAST(floor(u * 4) AS INT), 3) + 1] AS norm, count(*) AS n FROM u GROUP BY ALL""",
)
def decode_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    d = _u(spark, sf_dir).select(
        S.rounded("u", 3).alias("u"), P.decode(u, DEPTH).alias("depth"), S.rounded(P.decode(u, RATE), 9).alias("rate"), S.rounded(P.decode(u, SCALE)).alias("scale"),
        P.decode(u, {"kind": "boolean"}).alias("flag"), P.decode(u, ACTIVATION).alias("activation"), P.decode(u, NORM).alias("norm"),
    )
    return d.groupBy(*d.columns).agg(F.count("*").alias("n"))


@query(
    "one_hot",
    f"WITH {_U} SELECT {', '.join(f'{r(c)} AS hot_{i}' for i, c in enumerate(['avg(CASE WHEN u < 0.5 THEN 1.0 ELSE 0.0 END)', 'avg(CASE WHEN u >= 0.5 AND u < 0.8 THEN 1.0 ELSE 0.0 END)', 'avg(CASE WHEN u >= 0.8 THEN 1.0 ELSE 0.0 END)']))} FROM u",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = P.one_hot(P.choice_index(F.col("u"), ACTIVATION), 3)
    return _u(spark, sf_dir).agg(*[S.rounded(F.avg(h)).alias(f"hot_{i}") for i, h in enumerate(hot)])


@query(
    "architecture_features",
    f"""SELECT p_partkey, {r("log10((1 + p_size % 8) * pow(16 * (1 + p_size % 4), 2) + 1e-8)")} AS log_size, {r("log10(p_retailprice + 1e-8)")} AS log_price, CAST(p_brand = 'Brand#1' AS INT) AS is_brand_1,
  {r("least(greatest(p_retailprice / 1000, 0), 1)")} AS score FROM part""",
)
def architecture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers, width = 1 + F.col("p_size") % 8, 16 * (1 + F.col("p_size") % 4)
    return R.table(spark, sf_dir, "part").select(
        "p_partkey", S.rounded(F.log10(layers * width * width + 1e-8)).alias("log_size"), S.rounded(F.log10(F.col("p_retailprice") + 1e-8)).alias("log_price"),
        (F.col("p_brand") == "Brand#1").cast("int").alias("is_brand_1"), S.rounded(S.clipped(F.col("p_retailprice") / 1000, F.lit(0.0), F.lit(1.0))).alias("score"),
    )


#: A space of parameters, by category.
SPACE = {
    "architecture": {
        "num_layers": {"kind": "integer", "lo": 2, "hi": 8}, "base_channels": {"kind": "integer", "lo": 16, "hi": 64}, "kernel_size": {"kind": "choice", "choices": [3, 5, 7]},
        "activation": {"kind": "choice", "choices": ["relu", "gelu", "silu"]}, "dropout": {"kind": "continuous", "lo": 0.0, "hi": 0.5},
    },
    "stochastic": {
        "noise_scale": {"kind": "continuous", "lo": 1e-4, "hi": 1.0, "log": True}, "schedule": {"kind": "choice", "choices": ["constant", "annealing"], "weights": [0.75, 0.25]},
        "correlation": {"kind": "continuous", "lo": 0.0, "hi": 0.2}, "noise": {"kind": "choice", "choices": ["gaussian", "laplace"]},
    },
    "operator": {"normalization": {"kind": "choice", "choices": ["none", "batch", "layer"]}, "grid_size": {"kind": "choice", "choices": [64, 128, 256]}},
    "evolution": {
        "policy": {"kind": "choice", "choices": ["autoregressive", "residual", "convex"], "weights": [0.2, 0.5, 0.3]}, "dt": {"kind": "continuous", "lo": 1e-3, "hi": 0.1, "log": True},
        "alpha": {"kind": "continuous", "lo": 0.1, "hi": 0.9},
    },
}


def _space_sql() -> str:
    columns = []
    for k, (category, name, own) in enumerate((c, n, o) for c, ps in SPACE.items() for n, o in ps.items()):
        at, u = f"{category}_{name}", f"((CAST(embedding[{k + 1}] AS DOUBLE) + 1) / 2)"
        if own["kind"] == "choice":
            n = len(own["choices"])
            edges = [sum(own["weights"][: i + 1]) for i in range(n - 1)] if "weights" in own else [i / n for i in range(1, n)]
            index = f"(0{''.join(f' + CAST({u} >= {e!r} AS INT)' for e in edges)})" if "weights" in own else f"least(CAST(floor({u} * {n}) AS INT), {n - 1})"
            if not isinstance(own["choices"][0], str):
                columns.append(f"{r(f'CAST({own['choices']}[{index} + 1] AS DOUBLE)')} AS {at}")
            columns += [f"{r(f'CAST({index} = {i} AS DOUBLE)')} AS {at}_{c}" for i, c in enumerate(own["choices"])]
            continue
        value = f"({own['lo']} + {u} * ({own['hi']} - {own['lo']}))"
        if own["kind"] == "integer":
            value = f"round_even({value}, 0)"
        if own.get("log"):
            lo, hi = f"log10({own['lo']})", f"log10({own['hi']})"
            value = f"pow(10, {lo} + {u} * ({hi} - {lo}))"
            columns += [f"{r(f'log10({value} + 1e-10)')} AS {at}_log", f"{r(f'least(greatest((log10({value} + 1e-10) - {lo}) / ({hi} - {lo}), 0), 1)')} AS {at}_score"]
        columns.append(f"{r(value)} AS {at}")
    return f"SELECT vec_id, {', '.join(columns)} FROM embeddings"


@query("parameter_features", _space_sql())
def parameter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every sample's decoded parameters: numbers, logs, scores and choices of all categories."""
    names = [n for ps in SPACE.values() for n in ps]
    u = {n: (F.col("embedding")[k].cast("double") + 1) / 2 for k, n in enumerate(names)}
    return R.table(spark, sf_dir, "embeddings").select("vec_id", *[S.rounded(c).alias(n) for n, c in P.feature_columns(u, SPACE).items()])


@query(
    "stratification",
    f"""WITH p AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS a, (CAST(embedding[2] AS DOUBLE) + 1) / 2 AS b, (CAST(embedding[3] AS DOUBLE) + 1) / 2 AS c FROM embeddings)
SELECT vec_id, CAST(least(floor(a * 4), 3) + 4 * least(floor(b * 4), 3) + 16 * least(floor(c * 4), 3) AS INT) AS stratum_hash, {r("least(a, 1 - a, b, 1 - b, c, 1 - c)")} AS boundary_distance,
  {r("sqrt(pow(a - 0.5, 2) + pow(b - 0.5, 2) + pow(c - 0.5, 2))")} AS centre_distance FROM p""",
)
def stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    s = P.stratification([(F.col("embedding")[i].cast("double") + 1) / 2 for i in range(3)], 4)
    return e.select("vec_id", s["stratum_hash"].alias("stratum_hash"), *[S.rounded(s[c]).alias(c) for c in ("boundary_distance", "centre_distance")])


@query("unit_cube_check", f"WITH {_U} SELECT count(*) AS n, count(*) FILTER (WHERE u < 0 OR u > 1) AS n_outside FROM u")
def unit_cube_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(~F.col("u").between(0, 1)).alias("n_outside"))


@query("sobol_points")
def sobol_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sobol(spark, 1024, 6)


@query("uniform_points")
def uniform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded uniform points, from the row's own number: the same for any partitioning."""
    u = lambda d: (F.pmod(F.xxhash64("id", F.lit(d)), F.lit(1 << 53)) / float(1 << 53)).alias(f"u{d}")
    return spark.range(1024).select("id", *[u(d) for d in range(4)])


@query("top_by_total", f"SELECT user_id, {r('sum(value)', 3)} AS total, count(*) AS n FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10")
def top_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_by_total(R.table(spark, sf_dir, "events"), "user_id", "value", 10).withColumn("total", S.rounded("total", 3))


@query(
    "bottlenecks",
    f"WITH t AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) SELECT event_type, {r('total', 3)} AS total, {r('total / (SELECT sum(total) FROM t)')} AS share FROM t WHERE total / (SELECT sum(total) FROM t) >= 0.05",
)
def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.bottlenecks(R.table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", S.rounded("total", 3).alias("total"), S.rounded("share").alias("share"))


_SCORE = "s AS (SELECT vec_id AS sample_id, CAST(embedding[1] AS DOUBLE) * 0.3 + CAST(embedding[2] AS DOUBLE) * 0.4 + CAST(embedding[3] AS DOUBLE) * 0.3 AS score FROM embeddings)"


@query(
    "tiered_sample",
    f"""WITH {_SCORE}, b AS (SELECT quantile_cont(score, 0.8) AS a, quantile_cont(score, 0.6) AS b, quantile_cont(score, 0.4) AS c, quantile_cont(score, 0.2) AS d FROM s),
t AS (SELECT sample_id, score, CAST(1 + (score < a)::INT + (score < b)::INT + (score < c)::INT + (score < d)::INT AS INT) AS tier FROM s, b), k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, sample_id) AS rank FROM t)
SELECT sample_id, tier, CAST(rank AS INT) AS rank FROM k WHERE rank <= 4""",
)
def tiered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    s = e.select(F.col("vec_id").alias("sample_id"), (v[0] * 0.3 + v[1] * 0.4 + v[2] * 0.3).alias("score"))
    return L.tiered_sample(s, "score", 5, 4).select("sample_id", "tier", "rank")


_PARTS = 16


def _diverse_sql(k: int) -> str:
    """The choice step by step: each one's distances are the smaller of the last one's and those to what it chose."""
    z = "(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)"
    out = [
        f"""WITH x AS (SELECT vec_id AS id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range({_PARTS}) t(i)),
p AS (SELECT id, i, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM x WINDOW w AS (PARTITION BY i)),
y AS (SELECT vec_id AS id, i, (CAST(embedding[{_PARTS} + i + 1] AS DOUBLE) + CAST(embedding[{2 * _PARTS} + i + 1] AS DOUBLE) + CAST(embedding[{3 * _PARTS} + i + 1] AS DOUBLE)) / 3 AS v FROM embeddings, range({_PARTS}) t(i)),
f AS (SELECT id, i, coalesce({z}, 0) AS v FROM y WINDOW w AS (PARTITION BY i)),
c0 AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS distance)"""
    ]
    for n in range(1, k):
        before = f"(SELECT id, near FROM n{n - 1})" if n > 1 else "(SELECT DISTINCT id, CAST('inf' AS DOUBLE) AS near FROM p)"
        d = lambda t, n=n: f"(SELECT a.id, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM {t} a JOIN {t} b USING (i) JOIN c{n - 1} c ON b.id = c.id GROUP BY a.id)"
        out.append(
            f"""n{n} AS (SELECT o.id, CASE WHEN o.id = (SELECT id FROM c{n - 1}) THEN -1 ELSE least(near, 0.5 * dp.d + 0.5 * df.d) END AS near FROM {before} o JOIN {d("p")} dp USING (id) JOIN {d("f")} df USING (id)),
c{n} AS (SELECT id, near AS distance FROM n{n} WHERE near >= 0 ORDER BY near DESC, id LIMIT 1)"""
        )
    return ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {n} AS step, id, {r('distance')} AS distance FROM c{n}" for n in range(k))


@query("diverse_selection", _diverse_sql(5))
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors that are far apart by their first part (parameters) and by the mean of three further parts (features by time)."""
    v = F.col("embedding").cast("array<double>")
    part = lambda i: F.slice(v, i * _PARTS + 1, _PARTS)
    mean = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda e: (e["a"] + e["b"] + e["c"]) / 3)
    s = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), part(0).alias("parameters"), mean.alias("features"))
    return L.diverse(s, 5, 0, "id", "parameters", "features").withColumn("distance", S.rounded("distance"))


def _farthest_sql(k: int) -> str:
    """The choice step by step from vector 0, each row with its smallest distance so far."""
    out = ["WITH x AS (SELECT vec_id AS id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)), c0 AS (SELECT CAST(0 AS BIGINT) AS id)"]
    for n in range(1, k):
        before = f"n{n - 1}" if n > 1 else "(SELECT DISTINCT id, CAST('inf' AS DOUBLE) AS near FROM x)"
        d = f"(SELECT a.id, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM x a JOIN x b USING (i) JOIN c{n - 1} c ON b.id = c.id GROUP BY a.id)"
        out.append(f"n{n} AS (SELECT o.id, CASE WHEN o.id = (SELECT id FROM c{n - 1}) THEN -1 ELSE least(near, d.d) END AS near FROM {before} o JOIN {d} d USING (id)), c{n} AS (SELECT id FROM n{n} WHERE near >= 0 ORDER BY near DESC, id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {n} AS step, id AS sample_id FROM c{n}" for n in range(k))


@query("farthest_points", _farthest_sql(5))
def farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return L.farthest_points(v, 5, 0)


@query(
    "weighted_choice",
    "SELECT CASE WHEN h < 0.25 THEN 'grf' WHEN h < 0.75 THEN 'blobs' ELSE 'waves' END AS ic_type, count(*) AS n FROM (SELECT (p_partkey * 37 % 101) / 101.0 AS h FROM part) GROUP BY 1",
)
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = (F.col("p_partkey") * 37 % 101) / 101
    return R.table(spark, sf_dir, "part").groupBy(L.weighted_choice(u, {"grf": 0.25, "blobs": 0.5, "waves": 0.25}).alias("ic_type")).agg(F.count("*").alias("n"))


@query(
    "adaptive_detectors",
    f"""WITH u AS (SELECT user_id, avg(value) AS mse FROM events GROUP BY 1), m AS (SELECT avg(mse) AS mean FROM u)
SELECT user_id, {r("mse")} AS mse, concat_ws('; ', CASE WHEN mse > 60 THEN 'absolute' END, CASE WHEN mse > 1.1 * mean THEN 'relative' END) AS reasons, {r("mse / mean")} AS priority FROM u, m WHERE mse > 60 OR mse > 1.1 * mean""",
)
def adaptive_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mse"))
    return L.drift_detectors(u, "mse", 60, 1.1).select("user_id", S.rounded("mse").alias("mse"), "reasons", S.rounded("priority").alias("priority"))


@query(
    "feature_registry",
    "WITH f AS (SELECT p_brand AS name, min(p_partkey) AS seen FROM part GROUP BY 1) SELECT name, CAST(row_number() OVER (ORDER BY seen, name) - 1 AS INT) AS idx FROM f",
)
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.register(R.table(spark, sf_dir, "part"), "p_brand", "p_partkey").select(F.col("p_brand").alias("name"), "idx")


@query(
    "registry_round_trip",
    "WITH f AS (SELECT p_type AS category, p_brand AS name, CAST(min(p_partkey) AS INT) AS idx FROM part GROUP BY ALL) SELECT category, name, idx FROM f",
)
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = R.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("name")).agg(F.min("p_partkey").cast("int").alias("idx"))
    return L.registry_rows(L.registry_json(reg))


@query("registry_by_category", "SELECT p_brand AS name, min(p_partkey) AS idx FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY 1")
def registry_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "SMALL"))
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("idx")).orderBy("idx")


@query("category_share_rule", f"WITH n AS (SELECT lang AS family, count(*) AS n FROM documents GROUP BY 1) SELECT family, n, {r('n / sum(n) OVER ()')} AS share, abs(n / sum(n) OVER () - 0.25) <= 0.02 AS ok FROM n")
def category_share_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.share_rule(R.table(spark, sf_dir, "documents"), F.col("lang"), 0.25, 0.02), ["family", "n", "ok"])


@query(
    "bin_share_rule",
    f"WITH n AS (SELECT CAST(least(floor(l_discount * 10 * 5), 4) AS INT) AS family, count(*) AS n FROM lineitem GROUP BY 1) SELECT family, n, {r('n / sum(n) OVER ()')} AS share, abs(n / sum(n) OVER () - 0.2) <= 0.05 AS ok FROM n",
)
def bin_share_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.least(F.floor(F.col("l_discount") * 10 * 5), F.lit(4)).cast("int")
    return rounded(L.share_rule(R.table(spark, sf_dir, "lineitem"), bins, 0.2, 0.05), ["family", "n", "ok"])


@query(
    "quality_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE))) AS n_nan, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_outside, count(*) FILTER (WHERE {c} IS NULL OR {c} < {lo} OR {c} > {hi}) = 0 AS ok FROM lineitem"
        for c, lo, hi in (("l_quantity", 1, 50), ("l_discount", 0, 0.05), ("l_tax", 0, 1))
    ),
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quality_report(R.table(spark, sf_dir, "lineitem"), {"l_quantity": (1, 50), "l_discount": (0, 0.05), "l_tax": (0, 1)})


@query("parse_ratios", "SELECT DISTINCT p_size % 4 AS k, [CAST(p_size % 4 AS DOUBLE), 0.5, 2.0] AS ratios FROM part")
def parse_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("k")).distinct()
    return p.select("k", L.parse_ratios(F.concat_ws(":", F.col("k").cast("string"), F.lit("0.5"), F.lit("2.0"))).alias("ratios"))


@query("base_type", "SELECT regexp_replace(replace(lower(p_name), ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '_v2' WHEN p_partkey % 3 = 0 THEN '_low' WHEN p_partkey % 5 = 0 THEN '_mid' ELSE '_high' END, '_(v[0-9]+|low|mid|high)$', '') AS base, count(*) AS n FROM part GROUP BY 1")
def base_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, F.lit("_v2")).when(F.col("p_partkey") % 3 == 0, F.lit("_low")).when(F.col("p_partkey") % 5 == 0, F.lit("_mid")).otherwise(F.lit("_high")))
    return R.table(spark, sf_dir, "part").groupBy(L.base_type(name).alias("base")).agg(F.count("*").alias("n"))


@query(
    "aligned_join",
    f"""SELECT o_orderkey, {r("o_totalprice", 2)} AS total, c_mktsegment AS segment, count(l_linenumber) AS lines FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables aligned by key: pre-aggregated lines meet orders, orders meet customers."""
    o, c = R.table(spark, sf_dir, "orders"), R.table(spark, sf_dir, "customer")
    lines = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"))
    both = o.select("o_orderkey", "o_custkey", "o_totalprice").join(lines, "o_orderkey", "left").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return both.select("o_orderkey", S.rounded("o_totalprice", 2).alias("total"), F.col("c_mktsegment").alias("segment"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("kept_features", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = R.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.table(spark, sf_dir, "part").select("p_partkey").join(wanted, "p_partkey", "left_semi")


@query("orphan_features", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("batch_concat", "SELECT c_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def batch_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.unionByName(R.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).groupBy("nation").agg(F.count("*").alias("n"))


@query(
    "fill_missing_dims",
    "SELECT n_name AS category, CAST(coalesce(CASE WHEN n_regionkey = 1 THEN 12 END, 4 + n_nationkey % 5) AS INT) AS latent_dim FROM nation",
)
def fill_missing_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit settings before computed defaults."""
    explicit = F.when(F.col("n_regionkey") == 1, F.lit(12))
    return R.table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.coalesce(explicit, 4 + F.col("n_nationkey") % 5).cast("int").alias("latent_dim"))


@query(
    "spectral_rolling_share",
    f"""{with_relations("series")}, k AS (SELECT c, y, sum(y) OVER (PARTITION BY c ORDER BY y DESC, sample_id, t) / sum(y) OVER (PARTITION BY c) AS share FROM series) SELECT c, {r("(count(*) FILTER (WHERE share < 0.85) + 1) / count(*)")} AS rolloff FROM k GROUP BY c""",
)
def spectral_rolling_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows, largest first, that hold 85 % of a type's total."""
    w = Window.partitionBy("c").orderBy(F.desc("y"), "sample_id", "t")
    s = R.series(spark, sf_dir)
    total = s.groupBy("c").agg(F.sum("y").alias("total"))
    d = s.join(total, "c").withColumn("share", F.sum("y").over(w) / F.col("total"))
    return d.groupBy("c").agg(S.rounded((F.count_if(F.col("share") < 0.85) + 1) / F.count("*")).alias("rolloff"))


@query("dataset_shape", "SELECT count(*) AS num_samples, max(vec_id) + 1 AS next_id, count(DISTINCT label) AS labels, min(len(embedding)) AS cells FROM embeddings")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("num_samples"), (F.max("vec_id") + 1).alias("next_id"), F.count_distinct("label").alias("labels"), F.min(F.size("embedding")).cast("long").alias("cells"))


@query(
    "dataset_round_trip",
    f"""SELECT vec_id AS sample_id, label, {r("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))")} AS total, (SELECT count(*) FROM embeddings) AS num_samples
FROM embeddings, (SELECT max(vec_id) // 4 AS lo, 3 * max(vec_id) // 4 AS hi FROM embeddings) WHERE vec_id BETWEEN lo AND hi - 1""",
)
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields written as a dataset in two batches, beside files of a batch that was never committed; a slice over both batches read again."""
    f = R.fields(spark, sf_dir)
    top = f.agg(F.max("sample_id")).first()[0] or 0
    folder = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    w = DatasetWriter(spark, folder, top + 1)
    for low, high in ((0, top // 2), (top // 2, top + 1)):
        some = f.where(F.col("sample_id").between(low, high - 1))
        w.write_batch(inputs=some, samples=some.select("sample_id", "label"))
    f.select("sample_id", "h", "w", "data").write.parquet(f"{folder}/inputs/batch=lost")
    reader = DatasetReader(spark, folder)
    ids = (top // 4, 3 * top // 4)
    both = reader.get_inputs(ids).join(reader.get_sample_columns("label", ids=ids).withColumnRenamed("label", "kind"), "sample_id")
    total = S.rounded(F.aggregate("data", F.lit(0.0), lambda s, x: s + x))
    return both.select("sample_id", F.col("kind").alias("label"), total.alias("total")).withColumn("num_samples", F.lit(reader.num_samples()))


@query("range_slice", f"SELECT vec_id, label, {r('CAST(embedding[1] AS DOUBLE)')} AS first FROM embeddings WHERE vec_id BETWEEN 100 AND 199")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of samples: the range reaches the scan, and so does the choice of columns."""
    e = R.table(spark, sf_dir, "embeddings").where(F.col("vec_id").between(100, 199))
    return e.select("vec_id", "label", S.rounded(F.col("embedding")[0].cast("double")).alias("first"))
