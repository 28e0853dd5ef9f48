"""Descriptive statistics of groups of cells, and reductions over time and realizations."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.functions import grids as A
from gridstat.functions import stats as S
from gridstat.functions.grids import EPS, bind
from gridstat.operators import pairs as W
from gridstat.operators import ranks as K


def moments(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"), S.sample_skewness(v).alias("skewness"), S.sample_kurtosis(v).alias("kurtosis"),
    )


def percentiles(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    out = K.quantiles(df, keys, v, [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], (F.col("q")[3] - F.col("q")[1]).alias("iqr"))


def median_absolute_deviation(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Lower median of distances from the lower median, for groups of any size."""
    middle = K.lower_medians(df, keys, v).select(*keys, F.col("q")[0].alias("_middle"))
    apart = df.join(middle, keys).select(*keys, F.abs(F.col(v) - F.col("_middle")).alias("_apart"))
    return K.lower_medians(apart, keys, "_apart").select(*keys, F.col("q")[0].alias("mad"))


def histogram(df: DataFrame, keys: list[str], v: str = "v", bins: int = 16) -> DataFrame:
    """Entropy, largest share and number of bins above one percent of each group's own histogram."""
    binned = S.with_group_range(df, keys, v).withColumn("bin", S.equal_bins(F.col(v), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(total, keys).groupBy(*keys).agg(
        S.entropy_of_counts("n", "total").alias("entropy"), F.max(p).alias("peak"), F.sum((p > 0.01).cast("long")).alias("filled_bins")
    )


def floor_entropy(df: DataFrame, keys: list[str], v: str = "v", bins: int = 32) -> DataFrame:
    """Entropy by bins that hold the maximum alone in the last one."""
    counts = S.with_group_range(df, keys, v).groupBy(*keys, S.floor_bins(F.col(v), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(total, keys).groupBy(*keys).agg(S.entropy_of_counts("n", "total").alias("entropy"))


def outlier_clip(df: DataFrame, v: str, multiplier: float = 10.0, keys: list[str] | None = None) -> DataFrame:
    """Values held within the quartiles plus or minus a multiple of their distance, over the table or groups of it."""
    bounds, n = K.quantiles(df, keys or [], v, [0.25, 0.75]), df.groupBy(*(keys or [])).agg(F.count(v).alias("n"))
    bounds = bounds.join(n, keys) if keys else bounds.join(F.broadcast(n))
    span = (F.col("q")[1] - F.col("q")[0]) * multiplier
    bounds = bounds.select(*(keys or []), (F.col("q")[0] - span).alias("lo"), (F.col("q")[1] + span).alias("hi"), "n")
    joined = df.join(bounds, keys) if keys else df.join(F.broadcast(bounds))  # without keys: one row
    held = F.when(F.col("n") < 4, F.col(v)).otherwise(S.clipped(v, F.col("lo"), F.col("hi")))
    return joined.withColumn(v, held).drop("lo", "hi", "n")


REDUCTIONS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "cv": S.cv,
}


def reduce_over(df: DataFrame, keys: list[str], v: str, methods: list[str], order: str | None = None) -> DataFrame:
    """Reduce groups by named methods; `final` is the value at the largest `order`. Unknown methods are an error."""
    unknown = set(methods) - set(REDUCTIONS) - {"final"}
    if unknown:
        raise ValueError(f"no method {sorted(unknown)}; there are {sorted(REDUCTIONS)} and 'final'")
    return df.groupBy(*keys).agg(*[(F.max_by(v, order) if m == "final" else REDUCTIONS[m](v)).alias(m) for m in methods])


def density_fluctuations(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    var, mean = F.var_samp(v), F.avg(v)
    held = lambda x: S.clipped(x, F.lit(0.0), F.lit(100.0))
    return df.groupBy(*keys).agg(held(var / (mean * mean + S.EPS)).alias("relative_variance"), held(var / (F.abs(mean) + S.EPS)).alias("fano"))


def norms(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    c = F.col(v)
    return df.groupBy(*keys).agg(F.sum(F.abs(c)).alias("l1"), F.sqrt(F.sum(c * c) + S.EPS).alias("l2"), F.max(F.abs(c)).alias("linf"))


def rollout_metrics(df: DataFrame, keys: list[str], t: str = "t", cell: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Energy, variance, mean magnitude and correlation with the step before, by step."""
    before = df.select(*keys, (F.col(t) + 1).alias(t), *cell, F.col("v").alias("before"))
    both = df.join(before, [*keys, t, *cell], "left")
    return both.groupBy(*keys, t).agg(
        F.sum(F.col("v") * F.col("v")).alias("energy"), F.var_samp("v").alias("variance"), F.avg(F.abs("v")).alias("mean_magnitude"), F.corr("v", "before").alias("autocorrelation")
    )


def channel_norm(per_pixel: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Euclidean norm over channels of a statistic of pixels."""
    return per_pixel.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(name))


def ensemble_maps(df: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:  # noqa: B006
    """Mean, variance, deviation and envelope of realizations at each pixel."""
    return df.groupBy(*keys, "y", "x").agg(
        F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.stddev_samp("v").alias("std"), (F.max("v") - F.min("v")).alias("envelope")
    )


def entropy_map(df: DataFrame, bins: int = 32) -> DataFrame:
    """Entropy (base 2) of realizations at each pixel, bins over the range of the whole table."""
    bounds = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    binned = df.join(F.broadcast(bounds)).withColumn("bin", S.equal_bins(F.col("v"), F.col("lo"), F.col("hi"), bins))  # one row of bounds
    counts = binned.groupBy("sample_id", "y", "x", "bin").agg(F.count("*").alias("n"))
    total = counts.groupBy("sample_id", "y", "x").agg(F.sum("n").alias("total"))
    return counts.join(total, ["sample_id", "y", "x"]).groupBy("sample_id", "y", "x").agg((S.entropy_of_counts("n", "total") / F.log(F.lit(2.0))).alias("entropy"))


SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2


def ssim_neighbours(df: DataFrame) -> DataFrame:
    """Structural similarity of each realization to the next one, over its pixels."""
    a = df.select("sample_id", "realization", "y", "x", F.col("v").alias("a"))
    b = df.select("sample_id", (F.col("realization") - 1).alias("realization"), "y", "x", F.col("v").alias("b"))
    m = a.join(b, ["sample_id", "realization", "y", "x"]).groupBy("sample_id", "realization").agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_pop("a", "b").alias("cab")
    )
    s = ((2 * F.col("ma") * F.col("mb") + SSIM_C1) * (2 * F.col("cab") + SSIM_C2)) / (
        (F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + SSIM_C1) * (F.col("va") + F.col("vb") + SSIM_C2)
    )
    return m.select("sample_id", "realization", s.alias("ssim"))


def ssim_pairs(fields: DataFrame) -> DataFrame:
    """(sample_id, pairs, ssim): mean structural similarity over all pairs of a sample's packed realizations.

    Means and variances are a realization's own; a pair adds one product of its arrays. A sample's pairs are
    dealt over tiles (`operators.pairs`), and only sums leave a task. Grids of a sample have one size.
    """
    own = lambda f: bind(f, F.col("data"))
    known = fields.where(F.col("sample_id").isNotNull())
    d = known.select("sample_id", "realization", F.col("data").cast("array<double>").alias("data"), own(A.mean).alias("m"), own(A.variance).alias("v"))

    def fn(a: W.Block, b: W.Block, same: bool):
        size = len(a["data"]) // len(a["m"])
        x, y = (k["data"].reshape(-1, size) for k in (a, b))
        p, q = x - a["m"][:, None], y - b["m"][:, None]
        am, bm, av, bv = a["m"][:, None], b["m"][None, :], a["v"][:, None] + SSIM_C2, b["v"][None, :]
        aa, bb = am * am + SSIM_C1, bm * bm
        total, n = 0.0, 0
        for rows, columns, diagonal in W.strips(len(x), len(y), same, 4 * W.STRIP):
            s = p[rows] @ q[columns].T
            s *= 2 / size
            s += SSIM_C2
            top = am[rows] * bm[:, columns]
            top *= 2
            top += SSIM_C1
            s *= top
            under = np.add(aa[rows], bb[:, columns], out=top)
            s /= under
            s /= np.add(av[rows], bv[:, columns], out=under)
            if diagonal:
                s = s[W.upper(rows, columns)]
            total += float(s.sum())
            n += s.size
        if n:
            yield [[n], [total]]

    whole = d.where(F.col("m").isNotNull() & F.col("v").isNotNull())  # a pair with an unknown grid has no similarity
    parts = W.mapped(W.tiles(whole, ["realization"], ["data", "m", "v"], ["sample_id"]), "n long, total double", fn, ["sample_id"])
    means = parts.groupBy("sample_id").agg((F.sum("total") / F.sum("n")).alias("ssim"))
    sizes = d.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.expr("n * (n - 1) div 2").alias("pairs"))
    return sizes.join(means, "sample_id", "left").select("sample_id", "pairs", "ssim")


def spatial_flow(fields: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Mean over steps of how a field's gradients correlate with the next field: magnitude and ratio of both directions."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = fields.withColumn("later", F.lead("data").over(w)).where("later is not null")

    def flow(g: A.Grid) -> Column:
        gx = g.cells(lambda y, x: (g.around(y, x + 1) - g.around(y, x - 1)) / 2)
        gy = g.cells(lambda y, x: (g.around(y + 1, x) - g.around(y - 1, x)) / 2)
        return bind(lambda a, b, q: F.struct(_mixed(a, q).alias("x"), _mixed(b, q).alias("y")), gx, gy, F.col("later"))

    d = d.withColumn("flow", A.on(F.col("h"), F.col("w"), F.col("data"), flow))
    fx, fy = F.col("flow.x"), F.col("flow.y")
    return d.groupBy(*keys).agg(F.avg(F.sqrt(fx * fx + fy * fy + EPS)).alias("flow_magnitude"), F.avg(F.abs(fx) / (F.abs(fy) + EPS)).alias("flow_anisotropy"))


def _mixed(a: Column, b: Column) -> Column:
    """Population covariance of two arrays over their sample deviations."""
    return bind(lambda p, q: (A.dot(p, q) / F.size(p)) / (A.deviation(p) * A.deviation(q) + EPS), A.centred(a), A.centred(b))


def bucket_floor(x: Column, size: int) -> Column:
    """Down to a multiple of `size`, at least one."""
    return F.greatest(F.floor(x / size) * size, F.lit(size)).cast("int")


def partition_by_signature(df: DataFrame, signature: dict[str, Column], member: str) -> DataFrame:
    """Sizes and bounds of groups that share a signature."""
    return df.groupBy(*[c.alias(n) for n, c in signature.items()]).agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
