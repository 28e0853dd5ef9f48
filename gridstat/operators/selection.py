"""Sorts, limits and samples; registries of features; rules of data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.functions import stats as S
from gridstat.operators import ranks as K
from gridstat.sources.steps import Steps


def top_by_total(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n names with the largest totals (ties by name)."""
    return df.groupBy(name).agg(F.sum(value).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), name).limit(n)


def bottlenecks(df: DataFrame, name: str, value: str, least: float = 0.05) -> DataFrame:
    """Names with at least a share of the total."""
    totals = df.groupBy(name).agg(F.sum(value).alias("total"))
    whole = totals.agg(F.sum("total").alias("whole"))
    return totals.join(F.broadcast(whole)).withColumn("share", F.col("total") / F.col("whole")).where(F.col("share") >= least).drop("whole")  # one row


def tiered_sample(df: DataFrame, score: str, tiers: int, per_tier: int, id_: str = "sample_id") -> DataFrame:
    """`per_tier` rows of each tier of a score, highest first (ties by id).

    Tiers have equal sizes: their bounds are exact percentiles of the score, so
    no row number over the whole table is needed; rows are ranked inside tiers
    with a rank limit that Spark applies before it deals them out.
    """
    cuts = [1 - (i + 1) / tiers for i in range(tiers - 1)]
    bounds = K.quantiles(df, [], score, cuts).withColumnRenamed("q", "cuts")
    tier = F.aggregate("cuts", F.lit(1), lambda s, c: s + F.when(F.col(score) < c, 1).otherwise(0))
    d = df.join(F.broadcast(bounds)).withColumn("tier", tier).drop("cuts")  # one row
    w = Window.partitionBy("tier").orderBy(F.desc(score), id_)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_tier)


def farthest_points(df: DataFrame, k: int, first, id_: str = "sample_id", vector: str = "vec") -> DataFrame:
    """(step, id): greedy choice of k rows, each the farthest from those chosen (ties by lowest id).

    Each step is one pass that keeps only the chosen vectors on the driver: k of them.
    """
    row = df.where(F.col(id_) == first).select(vector).first()
    chosen, vectors = [(0, first)], [row[vector]]
    for step in range(1, k):
        near = F.least(*[S.euclidean(F.col(vector), F.array(*map(F.lit, v))) for v in vectors]) if len(vectors) > 1 else S.euclidean(F.col(vector), F.array(*map(F.lit, vectors[0])))
        best = df.where(~F.col(id_).isin([i for _, i in chosen])).select(id_, vector, near.alias("d")).orderBy(F.desc("d"), id_).limit(1).first()
        if best is None:
            break
        chosen.append((step, best[id_]))
        vectors.append(best[vector])
    kind = df.schema[id_].dataType.simpleString()
    return df.sparkSession.createDataFrame(chosen, f"step int, {id_} {kind}")


def weighted_choice(u: Column, weights: dict) -> Column:
    """The value whose cumulated weight range holds u."""
    out, at, items = None, 0.0, list(weights.items())
    for value, w in items[:-1]:
        at += w
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return F.lit(items[-1][0]) if out is None else out.otherwise(F.lit(items[-1][0]))


def drift_detectors(df: DataFrame, value: str, absolute: float, relative: float) -> DataFrame:
    """Rows that are above an absolute bound or above a multiple of the mean, with joined reasons and a priority."""
    mean = df.agg(F.avg(value).alias("mean"))
    d = df.join(F.broadcast(mean))  # one row
    a, r = F.col(value) > absolute, F.col(value) > relative * F.col("mean")
    reasons = F.concat_ws("; ", F.when(a, F.lit("absolute")), F.when(r, F.lit("relative")))
    return d.where(a | r).withColumns({"reasons": reasons, "priority": F.col(value) / F.col("mean")}).drop("mean").orderBy(F.desc("priority"))


# --- registries


def joint_space(df: DataFrame, id_: str, parameters: str, features: str) -> DataFrame:
    """(id, p, f): parameters between 0 and 1 by their ranges, features as z-scores (population); what doesn't vary is 0."""
    sizes = df.select(F.size(parameters).alias("p"), F.size(features).alias("f")).first()
    ends = lambda c, n, fn: F.array(*[fn(F.get(c, F.lit(i))) for i in range(n)])
    if sizes is None:
        return df.select(F.col(id_).alias("id"), F.col(parameters).alias("p"), F.col(features).alias("f"))
    bounds = df.agg(
        ends(parameters, sizes["p"], F.min).alias("lo"), ends(parameters, sizes["p"], F.max).alias("hi"), ends(features, sizes["f"], F.avg).alias("mean"), ends(features, sizes["f"], F.stddev_pop).alias("std")
    )
    inside = lambda x, i: F.when(F.get("hi", i) > F.get("lo", i), (x - F.get("lo", i)) / (F.get("hi", i) - F.get("lo", i))).otherwise(F.lit(0.0))
    score = lambda x, i: F.when(F.get("std", i) > 0, (x - F.get("mean", i)) / F.get("std", i)).otherwise(F.lit(0.0))
    return df.join(F.broadcast(bounds)).select(F.col(id_).alias("id"), F.transform(parameters, inside).alias("p"), F.transform(features, score).alias("f"))  # one row


def diverse(df: DataFrame, k: int, first, id_: str, parameters: str, features: str, alpha: float = 0.5) -> DataFrame:
    """(step, id, distance): greedy choice of k rows, each the farthest from those chosen before in the joint space.

    A distance is alpha times that of parameters plus the rest times that of features. Each row keeps its smallest
    distance so far in a table, so a step costs one distance a row however many were chosen; the driver holds the
    vector chosen last. Ties go to the lowest id; with fewer rows than k all are chosen. 
    """
    spark = df.sparkSession
    steps = Steps(spark)
    space = joint_space(df, id_, parameters, features)
    chosen: list[tuple] = []
    near = None
    for n in range(k):
        if n == 0:
            best = space.where(F.col("id") == first).select("id", "p", "f", F.lit(0.0).alias("near")).first()
        else:
            best = near.where("near >= 0").orderBy(F.desc("near"), "id").select("id", "p", "f", "near").first()
        if best is None:
            break
        chosen.append((n, best["id"], best["near"]))
        if n == k - 1:
            break
        p, f = (F.array(*map(F.lit, best[c])) for c in ("p", "f"))
        apart = alpha * S.euclidean(F.col("p"), p, len(best["p"])) + (1 - alpha) * S.euclidean(F.col("f"), f, len(best["f"]))
        least = apart if near is None else F.least("near", apart)
        source = space if near is None else near
        # What was chosen is marked by a distance below all others.
        near = steps.write(n, source.select("id", "p", "f", F.when(F.col("id") == best["id"], F.lit(-1.0)).otherwise(least).alias("near")))
        if n:
            steps.files.delete(f"step-{n - 1:06d}")
    kind = df.schema[id_].dataType.simpleString()
    return spark.createDataFrame(chosen, f"step int, id {kind}, distance double")


def register(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, idx): names in first-seen order with dense numbers from 0. Their number is checked: they are numbered as one array."""
    first = df.groupBy(name).agg(F.min(order).alias("seen"))
    n = first.limit(MAX_NAMES + 1).count()
    if n > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    every = first.agg(F.array_sort(F.collect_list(F.struct("seen", name))).alias("s"))
    return every.select(F.posexplode("s").alias("idx", "e")).select(F.col(f"e.{name}").alias(name), "idx")


#: Names of a registry at most.
MAX_NAMES = 1_000_000


def registry_json(registry: DataFrame) -> DataFrame:
    """One JSON object {category: {name: idx}} of (category, name, idx)."""
    by = registry.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "idx")))).alias("names"))
    return by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "names")))).alias("json"))


def registry_rows(json: DataFrame) -> DataFrame:
    """(category, name, idx) of such an object."""
    parsed = json.select(F.explode(F.from_json("json", "map<string, map<string, int>>")).alias("category", "names"))
    return parsed.select("category", F.explode("names").alias("name", "idx"))


# --- rules


def share_rule(df: DataFrame, family: Column, target: float, tolerance: float) -> DataFrame:
    """(family, n, share, ok): whether each family's share is as wanted."""
    n = df.groupBy(family.alias("family")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return n.join(F.broadcast(total)).select("family", "n", share.alias("share"), (F.abs(share - target) <= tolerance).alias("ok"))  # one row


def quality_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n, n_null, n_nan, n_outside, ok) of numeric columns, in one pass."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"),
                F.count_if((x < lo) | (x > hi)).alias("n_outside"),
            )
        )
    rows = df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("ok", (F.col("n_null") + F.col("n_nan") + F.col("n_outside")) == 0)


def parse_ratios(text: Column) -> Column:
    """'a:b:c' as numbers; null if a part is none."""
    return F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))


def base_type(name: Column) -> Column:
    """A type's name without a version or 'low', 'mid' or 'high' at its end."""
    return F.regexp_replace(name, r"_(v\d+|low|mid|high)$", "")
