"""Queries of codebook training and of the rules that reset codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import codebook as C
from gridstat.operators import resets as L
from gridstat.plans.registry import query, r, with_relations
from gridstat.sources import relations as R

DECAY, EPSILON = 0.9, 1e-5


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _step_sql(before: str, after: str) -> str:
    """Common table expressions of one step, from (code, feature, e, size, weight)."""
    return f"""
{after}_d AS (SELECT vec_id, code, sqrt(sum(pow(CAST(embedding[feature + 1] AS DOUBLE) - e, 2))) AS d FROM embeddings, {before} GROUP BY ALL),
{after}_t AS (SELECT vec_id, arg_min(code, (d, code)) AS code FROM {after}_d GROUP BY vec_id),
{after}_u AS (SELECT code, count(*) AS n FROM {after}_t GROUP BY code),
{after}_s AS (SELECT code, p AS feature, sum(CAST(embedding[p + 1] AS DOUBLE)) AS s FROM {after}_t JOIN embeddings USING (vec_id), range(64) r(p) GROUP BY ALL),
{after}_c AS (SELECT code, any_value(size) * {DECAY} + (1 - {DECAY}) * coalesce(any_value({after}_u.n), 0) AS raw, coalesce(any_value({after}_u.n), 0) AS n FROM {before} LEFT JOIN {after}_u USING (code) GROUP BY code),
{after}_z AS (SELECT code, n, (raw + {EPSILON}) / (sum(raw) OVER () + count(*) OVER () * {EPSILON}) * sum(raw) OVER () AS size FROM {after}_c),
{after} AS (SELECT code, feature, z.n, z.size, {DECAY} * weight + (1 - {DECAY}) * coalesce(s, 0) AS weight, ({DECAY} * weight + (1 - {DECAY}) * coalesce(s, 0)) / z.size AS e
  FROM {before} b JOIN {after}_z z USING (code) LEFT JOIN {after}_s USING (code, feature))"""


_START = f"""{with_relations("codebook")}, s0 AS (SELECT code, feature, e, CAST(0 AS DOUBLE) AS size, e AS weight FROM codebook)"""


@query(
    "codebook_training",
    f"{_START}, {_step_sql('s0', 's1')}, {_step_sql('s1', 's2')} SELECT step, code, n, {r('size')} AS size, feature, {r('e', 5)} AS e FROM (SELECT 1 AS step, * FROM s1 UNION ALL SELECT 2, * FROM s2)",
)
def codebook_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from the labels' means."""
    kept = C.train(_vectors(spark, sf_dir), R.codebook(spark, sf_dir), 2, DECAY, EPSILON)
    both = kept.read(1).withColumn("step", F.lit(1)).unionByName(kept.read(2).withColumn("step", F.lit(2)))
    return both.select("step", "code", "n", S.rounded("size").alias("size"), F.posexplode("vec").alias("feature", "e")).withColumn("e", S.rounded("e", 5))


@query(
    "codebook_reset",
    f"""{_START}, {_step_sql("s0", "s1")}, sizes AS (SELECT code, any_value(size) AS size FROM s1 GROUP BY code),
b AS (SELECT quantile_cont(size, 0.3) AS bound, quantile_disc(size, 0.5) AS middle, count(*) AS k FROM sizes),
dead AS (SELECT code, row_number() OVER (ORDER BY size, code) AS place FROM sizes, b WHERE size <= bound QUALIFY place <= floor(any_value(k) OVER () * 0.25)),
new AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('7|' || vec_id)) AS place FROM embeddings),
moved AS (SELECT code, p AS feature, CAST(embedding[p + 1] AS DOUBLE) AS e FROM dead JOIN new USING (place), range(64) r(p))
SELECT s1.code, m.e IS NOT NULL AS moved, {r("CASE WHEN m.e IS NULL THEN size ELSE middle END")} AS size, s1.feature, {r("coalesce(m.e, s1.e)", 5)} AS e FROM s1 LEFT JOIN moved m USING (code, feature), b""",
)
def codebook_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step, then the smallest codes move to drawn vectors."""
    v = _vectors(spark, sf_dir)
    kept = C.train(v, R.codebook(spark, sf_dir), 1, DECAY, EPSILON)
    out = C.reset_dead(kept.read(1), v, "vec_id", percent=30.0, seed=7)
    return out.select("code", "moved", S.rounded("size").alias("size"), F.posexplode("vec").alias("feature", "e")).withColumn("e", S.rounded("e", 5))


# --- the ladder: a history of training made of the events, an epoch an hour, a run an event type


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "events")
    epoch = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).cast("long")
    group = F.pmod("user_id", F.lit(3)).cast("int")
    by = e.select(F.col("event_type").alias("run"), epoch.alias("epoch"), group.alias("g"), "value").groupBy("run", "epoch")
    share = lambda i: F.avg(F.when(F.col("g") == i, F.col("value"))) / 400
    kinds = [F.struct(share(i).alias("utilization"), F.lit(n).alias("features")) for i, n in enumerate((4, 12, 60))]
    return by.agg((F.avg("value") / 200).alias("utilization"), (F.min("value") / 1000).alias("loss"), (F.count("*") % 40).cast("int").alias("stale"), F.array(*kinds).alias("categories"))


_HISTORY = """h AS (SELECT event_type AS run, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS epoch, avg(value) / 200 AS u, min(value) / 1000 AS loss, count(*) % 40 AS stale,
  avg(value) FILTER (WHERE user_id % 3 = 0) / 400 AS c0, avg(value) FILTER (WHERE user_id % 3 = 1) / 400 AS c1, avg(value) FILTER (WHERE user_id % 3 = 2) / 400 AS c2 FROM events GROUP BY ALL)"""


@query(
    "reset_ladder",
    f"""WITH RECURSIVE {_HISTORY},
f AS (SELECT run, epoch, u, stale, count(*) OVER w AS seen,
    avg(u) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) - avg(u) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS fell,
    avg(u) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent, avg(u) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS before,
    avg(loss) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) - avg(loss) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS gained,
    coalesce(c0 < 0.05, false) OR coalesce(c1 < 0.05 + 7 * 0.005, false) OR coalesce(c2 < 0.15, false) AS category,
    CASE WHEN epoch < 100 THEN 50 WHEN epoch < 200 THEN 100 ELSE 200 END AS wait FROM h WHERE epoch > 0 WINDOW w AS (PARTITION BY run ORDER BY epoch)),
g AS (SELECT run, epoch, wait, category, seen >= 20 AND epoch > 20 AND fell > 0.05 AS collapse, u < 0.15 AS emergency,
    u <= 0.25 AND stale <= 30 AND (seen < 20 OR ((recent < before - 0.01 OR (recent < 0.25 AND abs(recent - before) < 0.01)) AND gained <= 0.005)) AS low FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM g WHERE category OR collapse OR emergency OR low),
walk AS (
  SELECT run, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT run FROM h)
  UNION ALL
  SELECT run, n, epoch, CASE WHEN reason IS NULL THEN last ELSE epoch END, reason FROM (
    SELECT n.run, n.n, n.epoch, w.last, CASE
      WHEN category AND n.epoch - w.last >= greatest(wait // 2, 25) THEN 'category'
      WHEN collapse AND n.epoch - w.last >= 10 THEN 'collapse'
      WHEN n.epoch - w.last < wait THEN NULL
      WHEN emergency THEN 'emergency' WHEN low THEN 'low' END AS reason
    FROM walk w JOIN n ON n.run = w.run AND n.n = w.n + 1))
SELECT run, epoch, reason, CASE WHEN epoch < 100 THEN 10.0 WHEN epoch < 200 THEN 7.0 ELSE 5.0 END AS percent FROM walk WHERE reason IS NOT NULL""",
)
def reset_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resets(history(spark, sf_dir)).withColumn("percent", S.rounded("percent"))
