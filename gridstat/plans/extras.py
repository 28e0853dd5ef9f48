"""Queries of scales over time, histories and tables of colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import grid as G
from gridstat.operators import sequence as Q
from gridstat.plans.descriptive import rounded
from gridstat.plans.grid import LOW_SQL
from gridstat.plans.registry import query, r, with_relations
from gridstat.sources import relations as R


_FIELDS = f"p AS (SELECT vec_id AS sample_id, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)), {LOW_SQL}"
_ENERGIES = f"""WITH {_FIELDS}, n AS (SELECT sample_id, sum(p.v * p.v) AS raw, sum(low.v * low.v) AS low, sum(h.v * h.v) AS high FROM p JOIN low USING (sample_id, y, x) JOIN h USING (sample_id, y, x) GROUP BY sample_id),
t AS (SELECT label, n.*, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t FROM n JOIN embeddings ON n.sample_id = vec_id)"""


@query(
    "drift_scales",
    f"""{_ENERGIES}, u AS (SELECT label AS sample_id, t, 'raw' AS scale, sqrt(raw + 1e-8) AS y FROM t UNION ALL SELECT label, t, 'low', sqrt(low + 1e-8) FROM t UNION ALL SELECT label, t, 'high', sqrt(high + 1e-8) FROM t),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY sample_id, scale ORDER BY t) AS d FROM u)
SELECT sample_id, scale, {r("avg(d)", 5)} AS mean_drift, {r("var_samp(d)", 5)} AS drift_variance, {r("arg_max(y, t) / (arg_min(y, t) + 1e-8)", 5)} AS final_initial_ratio, {r("avg(sign(d))", 5)} AS monotonicity FROM d GROUP BY ALL""",
)
def drift_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of norms of the raw, the low-passed and the remaining field, by scale."""
    made = G.measure(R.ensemble_fields(spark, sf_dir), ["sample_id", "realization"], G.NORMS_BY_SCALE)
    long = made.unpivot(["sample_id", "realization"], ["raw", "low", "high"], "scale", "y").withColumnRenamed("realization", "t")
    return rounded(Q.drift(long, ["sample_id", "scale"]), ["sample_id", "scale"], 5)


@query(
    "scale_dissipation",
    f"""{_ENERGIES}, d AS (SELECT label, ln(low + 1e-8) - lag(ln(low + 1e-8)) OVER w AS low, ln(high + 1e-8) - lag(ln(high + 1e-8)) OVER w AS high FROM t WINDOW w AS (PARTITION BY label ORDER BY t)),
a AS (SELECT label AS sample_id, -avg(low) AS low, -avg(high) AS high FROM d GROUP BY label)
SELECT sample_id, {r("low", 4)} AS low, {r("high", 4)} AS high, {r("high / (abs(low) + 1e-8)", 4)} AS ratio, {r("sign(high - low)", 4)} AS direction FROM a""",
)
def scale_dissipation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fall of the log energy of the low-passed and the remaining field from step to step, and their ratio."""
    made = G.measure(R.ensemble_fields(spark, sf_dir), ["sample_id", "realization"], G.scales(1))
    w = Window.partitionBy("sample_id").orderBy("realization")
    fall = lambda c: -F.avg(F.log(F.col(c) + S.EPS) - F.col(f"{c}_before"))
    d = made.withColumns({f"{c}_before": F.lag(F.log(F.col(c) + S.EPS)).over(w) for c in ("low_energy", "high_energy")})
    out = d.groupBy("sample_id").agg(fall("low_energy").alias("low"), fall("high_energy").alias("high"))
    return rounded(out.withColumns({"ratio": F.col("high") / (F.abs("low") + S.EPS), "direction": F.signum(F.col("high") - F.col("low"))}), ["sample_id"], 4)


@query(
    "history_convergence",
    f"{with_relations('user_series')} SELECT sample_id, {r('(arg_min(y, t) - arg_max(y, t)) / count(*)')} AS convergence, {r('min(y)')} AS best, arg_min(t, (y, t)) AS best_at FROM user_series GROUP BY sample_id",
)
def history_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fall of a history by row, its best value and where that is first."""
    s = R.user_series(spark, sf_dir)
    return s.groupBy("sample_id").agg(
        S.rounded((F.min_by("y", "t") - F.max_by("y", "t")) / F.count("*")).alias("convergence"), S.rounded(F.min("y")).alias("best"), F.min(F.struct("y", "t"))["t"].alias("best_at")
    )


@query(
    "sweep_best",
    f"WITH c AS (SELECT p_brand AS category, p_size % 5 AS candidate, avg(p_retailprice) AS loss FROM part GROUP BY ALL) SELECT category, arg_min(candidate, (loss, candidate)) AS candidate, {r('min(loss)')} AS loss FROM c GROUP BY category",
)
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the least loss of each category, the lowest among ties."""
    c = R.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category"), (F.col("p_size") % 5).alias("candidate")).agg(F.avg("p_retailprice").alias("loss"))
    best = c.groupBy("category").agg(F.min(F.struct("loss", "candidate")).alias("b"))
    return best.select("category", "b.candidate", S.rounded("b.loss").alias("loss"))


@query(
    "colour_lookup",
    f"""{with_relations("cells")}, b AS (SELECT sample_id, least(floor(greatest(least((v + 0.5), 1), 0) * 255), 255) AS k FROM cells)
SELECT sample_id, {r("avg(k / 255)")} AS red, {r("avg(1 - k / 255)")} AS blue FROM b GROUP BY sample_id""",
)
def colour_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean colour of a field by a table of 256 colours between blue and red."""
    k = F.least(F.floor(S.clipped(F.col("v") + 0.5, F.lit(0.0), F.lit(1.0)) * 255), F.lit(255))
    table = spark.range(256).select(F.col("id").alias("k"), (F.col("id") / 255).alias("red"), (1 - F.col("id") / 255).alias("blue"))
    both = R.cells(spark, sf_dir).select("sample_id", k.alias("k")).join(F.broadcast(table), "k")  # 256 rows
    return both.groupBy("sample_id").agg(S.rounded(F.avg("red")).alias("red"), S.rounded(F.avg("blue")).alias("blue"))


@query(
    "category_codes",
    f"""WITH f AS (SELECT vec_id, label, p // 16 AS category, p, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) q(p)),
e AS (SELECT label AS code, category, p, avg(v) AS e FROM f GROUP BY ALL), d AS (SELECT vec_id, f.category, code, sum(pow(v - e, 2)) AS d FROM f JOIN e ON f.p = e.p GROUP BY ALL)
SELECT vec_id, category, arg_min(code, (d, code)) AS code FROM d GROUP BY vec_id, category""",
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest code of each vector in each category of features, each with its own codebook."""
    from gridstat.operators import matrix as M

    parts = R.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("category"), F.col("embedding").cast("array<double>").alias("v")
    ).select("vec_id", "label", "category", F.slice("v", F.col("category") * 16 + 1, F.lit(16)).alias("vec"))
    flat = parts.select("label", "category", F.posexplode("vec").alias("p", "x")).groupBy(F.col("label").alias("code"), "category", "p").agg(F.avg("x").alias("e"))
    books = flat.groupBy("code", "category").agg(F.array_sort(F.collect_list(F.struct("p", "e"))).alias("s")).select("code", "category", F.transform("s", lambda e: e["e"]).alias("vec"))
    out = M.assign_codes(parts.drop("label"), books, by=["category"])
    return out.select("vec_id", "category", "code")
