"""Statistics of sequences (keys, t, y): built-in aggregates and windows over a sequence's own rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.functions.stats import EPS, entropy_of_counts


def ordered(keys: list[str], t: str = "t"):
    return Window.partitionBy(*keys).orderBy(t)


def trends(df: DataFrame, keys: list[str]) -> DataFrame:
    """Growth rate, trend strength, detrended variance and amplitude: one aggregate, no window."""
    n, ss = F.count("y"), F.regr_syy("y", "t")
    residual = ss - F.regr_sxy("y", "t") * F.regr_sxy("y", "t") / F.nullif(F.regr_sxx("y", "t"), F.lit(0.0))
    r2 = F.least(F.greatest(1 - residual / (ss + EPS), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(F.log(F.abs("y") + EPS), F.col("t")).alias("growth_rate"), r2.alias("trend_strength"),
        F.when(n > 1, residual / (n - 1)).alias("detrended_variance"), (F.max("y") - F.min("y")).alias("amplitude"),
        ((F.abs(F.max_by("y", "t")) + EPS) / (F.abs(F.min_by("y", "t")) + EPS)).alias("final_to_initial"),
    )


def differences(df: DataFrame, keys: list[str]) -> DataFrame:
    """Roughness, divergence, regime switches and irreversibility from first and second differences."""
    w = ordered(keys)
    d = df.withColumns({"l1": F.lag("y", 1).over(w), "l2": F.lag("y", 2).over(w)})
    d1, d2 = F.col("y") - F.col("l1"), F.col("y") - 2 * F.col("l1") + F.col("l2")
    d = d.withColumns({"d1": d1, "d2": d2, "turn": (F.signum(d1) != F.signum(F.col("l1") - F.col("l2"))).cast("int")})
    span = F.greatest(F.lit(1), F.count("*") - 2)
    return d.groupBy(*keys).agg(
        F.avg(F.abs("d2")).alias("growth_acceleration"), F.avg(F.log(F.abs("d1") + EPS)).alias("divergence"), (F.sum(F.abs("d2")) / span).alias("smoothness"),
        (F.sum("turn") / span).alias("regime_switches"), (2 * F.avg(F.pow("d1", F.lit(3.0)))).alias("irreversibility"),
        (2 * F.avg(F.pow("d1", F.lit(3.0))) / (F.var_samp("y") + EPS)).alias("relative_irreversibility"),
    )


def events(df: DataFrame, keys: list[str], sigmas: float = 2.0) -> DataFrame:
    """Rising edges above mean plus deviations (spikes), runs of three above one deviation (bursts), sign changes about the mean.

    A value may equal the mean but for the rounding of its sum, so the sum follows the
    sequence, not the layout of the input: a window, since an aggregate is free to add parts.
    """
    w = ordered(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).withColumns({"mu": F.avg("y").over(whole), "sd": F.stddev_samp("y").over(whole)})
    d = d.withColumns({
        "spike": (F.col("y") > F.col("mu") + sigmas * F.col("sd")).cast("int"), "above": (F.col("y") > F.col("mu") + F.col("sd")).cast("int"),
        "sign": F.signum(F.col("y") - F.col("mu")),
    })
    d = d.withColumn("burst", (F.sum("above").over(w.rowsBetween(-2, 0)) == 3).cast("int"))
    rise = lambda c: ((F.col(c) == 1) & (F.coalesce(F.lag(c).over(w), F.lit(0)) == 0)).cast("long")
    d = d.withColumns({"spikes": rise("spike"), "bursts": rise("burst"), "crossings": (F.abs(F.col("sign") - F.lag("sign").over(w)) > 1).cast("long")})
    return d.groupBy(*keys).agg(F.sum("spikes").alias("spikes"), F.sum("bursts").alias("bursts"), F.coalesce(F.sum("crossings"), F.lit(0)).alias("crossings"))


def time_to_event(df: DataFrame, keys: list[str], factors: list[float]) -> DataFrame:
    """First time at which a sequence is beyond a factor of its first value, as a share of its length; 1 if never."""
    first = df.groupBy(*keys).agg(F.min_by("y", "t").alias("y0"), F.count("*").alias("n"))
    d = df.join(first, keys)
    reached = lambda f: (F.col("y") > f * F.col("y0")) if f > 1 else (F.col("y") < f * F.col("y0"))
    named = [(F.coalesce(F.min(F.when(reached(f), F.col("t"))), F.max("n")) / F.max("n")).alias(f"time_to_x{f:g}".replace(".", "_")) for f in factors if f != 1.0]
    return d.groupBy(*keys).agg(*named)


def rolling(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Mean, deviation and extremes of full windows of a share of each sequence (two rows at least).

    Rows are cut into blocks of a window's length; a window is the end of one block
    and the beginning of the next, so running sums and extremes within blocks give
    every window, and a long sequence is dealt out block by block.
    """
    whole = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("mu")).withColumn("w", F.greatest(F.lit(2), F.floor(F.col("n") * share)).cast("int"))
    d = df.withColumn("i", F.row_number().over(ordered(keys)) - 1).join(whole, keys).where("n >= w")
    d = d.select(*keys, "i", "n", "w", "mu", "y", (F.col("y") - F.col("mu")).alias("z"), F.floor(F.col("i") / F.col("w")).alias("block"))
    block = Window.partitionBy(*keys, "block").orderBy("i")
    stats = {"s": (F.sum, F.col("z")), "q": (F.sum, F.col("z") * F.col("z")), "hi": (F.max, F.col("y")), "lo": (F.min, F.col("y"))}
    frames = {"to": block.rowsBetween(Window.unboundedPreceding, 0), "from": block.rowsBetween(0, Window.unboundedFollowing)}
    d = d.withColumns({f"{side}_{c}": f(x).over(w) for side, w in frames.items() for c, (f, x) in stats.items()})
    last = d.select(*keys, (F.col("i") - F.col("w") + 1).alias("i"), *[f"to_{c}" for c in stats])
    both = d.where("i <= n - w").drop(*[f"to_{c}" for c in stats]).join(last, [*keys, "i"])
    alone = F.col("i") % F.col("w") == 0  # a window that is a block
    joined = {"s": lambda a, b: a + b, "q": lambda a, b: a + b, "hi": F.greatest, "lo": F.least}
    one = {c: F.when(alone, F.col(f"to_{c}")).otherwise(f(F.col(f"from_{c}"), F.col(f"to_{c}"))) for c, f in joined.items()}
    flat = both.select(*keys, "w", "mu", *[x.alias(c) for c, x in one.items()])
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("w"), F.lit(0.0)) / (F.col("w") - 1))
    flat = flat.select(*keys, (F.col("mu") + F.col("s") / F.col("w")).alias("m"), spread.alias("sd"), "hi", "lo")
    return flat.groupBy(*keys).agg(
        F.avg("m").alias("mean"), F.avg("sd").alias("std"), F.avg("hi").alias("max"), F.avg("lo").alias("min"),
        F.stddev_samp("m").alias("std_of_means"), F.stddev_samp("sd").alias("std_of_stds"),
    )


def autocorrelation(df: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """Biased autocorrelation (sums over the overlap, divided by the sum of squares) for lags 0 to `lags`, a row a lag."""
    w = ordered(keys)
    mean = df.groupBy(*keys).agg(F.avg("y").alias("mu"))
    d = df.join(mean, keys).withColumn("z", F.col("y") - F.col("mu"))
    d = d.withColumns({f"l{k}": F.lag("z", k).over(w) for k in range(1, lags + 1)})
    products = [F.sum(F.col("z") * F.col("z")), *[F.sum(F.col("z") * F.col(f"l{k}")) for k in range(1, lags + 1)]]
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*products).alias("c"))
    flat = sums.select(*keys, "n", F.get("c", F.lit(0)).alias("c0"), F.posexplode("c").alias("lag", "s")).where("lag < n")
    return flat.select(*keys, "lag", (F.col("s") / (F.col("c0") + EPS)).alias("acf"))


def decay_time(acf: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """First lag at which the autocorrelation is below 1/e, else the largest lag."""
    below = F.min(F.when(F.col("acf") < F.exp(F.lit(-1.0)), F.col("lag")))
    return acf.groupBy(*keys).agg(F.coalesce(below, F.lit(lags)).alias("decay_time"))


def approximate_pacf(acf: DataFrame, keys: list[str]) -> DataFrame:
    """acf(k) / sqrt(1 - acf(k-1)^2 + 1e-4): an approximation of partial autocorrelation."""
    before = F.lag("acf").over(ordered(keys, "lag"))
    held = F.least(F.greatest(before, F.lit(-1.0)), F.lit(1.0))
    return acf.withColumn("pacf", F.col("acf") / F.sqrt(1 - held * held + 1e-4)).where("lag > 0").select(*keys, "lag", "pacf")


def permutation_entropy(df: DataFrame, keys: list[str], order: int = 3) -> DataFrame:
    """Entropy of ordinal patterns of `order` neighbours, relative to ln(order!)."""
    w = ordered(keys)
    near = F.array(*[F.struct(F.lag("y", order - 1 - i).over(w).alias("v"), F.lit(i).alias("i")) for i in range(order)])
    d = df.withColumns({"near": near, "k": F.row_number().over(w)}).where(F.col("k") >= order)
    pattern = F.array_join(F.transform(F.array_sort("near"), lambda e: e["i"].cast("string")), "")
    counts = d.groupBy(*keys, pattern.alias("pattern")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    top = reduce(lambda a, b: a * b, range(1, order + 1))
    return counts.join(total, keys).groupBy(*keys).agg((entropy_of_counts("n", "total") / F.log(F.lit(float(top)))).alias("permutation_entropy"))


def drift(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of steps, last over first, and mean sign of steps."""
    d = df.withColumn("d", F.col("y") - F.lag("y").over(ordered(keys)))
    return d.groupBy(*keys).agg(
        F.avg("d").alias("mean_drift"), F.var_samp("d").alias("drift_variance"), (F.max_by("y", "t") / (F.min_by("y", "t") + EPS)).alias("final_initial_ratio"),
        F.avg(F.signum("d")).alias("monotonicity"),
    )


def prediction_error(df: DataFrame, keys: list[str], lag: int = 1) -> DataFrame:
    """Mean error of predicting a value by the one `lag` steps before it, and after it."""
    w = ordered(keys)
    d = df.withColumns({"before": F.abs(F.col("y") - F.lag("y", lag).over(w)), "after": F.abs(F.lead("y", lag).over(w) - F.col("y"))})
    f, b = F.avg("before"), F.avg("after")
    return d.groupBy(*keys).agg(f.alias("forward_error"), (f / (b + EPS)).alias("error_ratio"), (f - b).alias("error_difference"))


def channel_pairs(df: DataFrame, lag: int) -> DataFrame:
    """Rows (i, j, t, xi, xj, xi_later, xj_later) of ordered pairs of different channels."""
    w = Window.partitionBy("c").orderBy("t")
    d = df.withColumn("later", F.lead("y", lag).over(w))
    a = d.select(F.col("c").alias("i"), "t", F.col("y").alias("xi"), F.col("later").alias("xi_later"))
    b = d.select(F.col("c").alias("j"), "t", F.col("y").alias("xj"), F.col("later").alias("xj_later"))
    return a.join(b, "t").where("i <> j")


def mixed_corr(x: str, y: str) -> Column:
    """Population covariance over sample deviations."""
    return F.covar_pop(x, y) / (F.stddev_samp(x) * F.stddev_samp(y) + EPS)


def lagged_asymmetry(df: DataFrame, lag: int = 1) -> DataFrame:
    """corr(x_i(t), x_j(t+k)) - corr(x_i(t+k), x_j(t)) of each ordered pair of channels."""
    pairs = channel_pairs(df, lag).where("xi_later is not null and xj_later is not null")
    return pairs.groupBy("i", "j").agg((mixed_corr("xi", "xj_later") - mixed_corr("xi_later", "xj")).alias("asymmetry"))


def transfer_entropy(df: DataFrame, bins: int = 4, lag: int = 1) -> DataFrame:
    """H(Y | Y before) - H(Y | Y before, X before) of each ordered pair of channels, over binned values."""
    bounds = df.groupBy("c").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    d = df.join(bounds, "c").withColumn("b", F.floor((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo") + EPS) * (bins - 1)).cast("int"))
    w = Window.partitionBy("c").orderBy("t")
    d = d.withColumn("prev", F.lag("b", lag).over(w)).where("prev is not null")
    y = d.select(F.col("c").alias("target"), "t", F.col("b").alias("y"), F.col("prev").alias("yp"))
    x = d.select(F.col("c").alias("source"), "t", F.col("prev").alias("xp"))
    joint = y.join(x, "t").where("source <> target").groupBy("source", "target", "y", "yp", "xp").agg(F.count("*").alias("n"))
    pair = ["source", "target"]

    def entropy(keys: list[str], name: str) -> DataFrame:
        n = joint.groupBy(*pair, *keys).agg(F.sum("n").alias("n"))
        total = n.groupBy(*pair).agg(F.sum("n").alias("total"))
        return n.join(total, pair).groupBy(*pair).agg(entropy_of_counts("n", "total").alias(name))

    parts = [entropy(k, name) for k, name in ((["y", "yp"], "hyy"), (["yp"], "hp"), (["y", "yp", "xp"], "hyyx"), (["yp", "xp"], "hpx"))]
    all_four = reduce(lambda a, b: a.join(b, pair), parts)
    te = (F.col("hyy") - F.col("hp")) - (F.col("hyyx") - F.col("hpx"))
    return all_four.select(*pair, te.alias("transfer_entropy"))


def granger_improvement(df: DataFrame, lag: int = 1) -> DataFrame:
    """Relative fall of the squared residual when half of another channel's past joins half of the own past."""
    w = Window.partitionBy("c").orderBy("t")
    d = df.withColumn("past", F.lag("y", lag).over(w)).where("past is not null")
    y = d.select(F.col("c").alias("target"), "t", "y", F.col("past").alias("own"))
    x = d.select(F.col("c").alias("source"), "t", F.col("past").alias("other"))
    e0, e1 = F.col("y") - F.col("own"), F.col("y") - 0.5 * F.col("own") - 0.5 * F.col("other")
    own, both = F.avg(e0 * e0), F.avg(e1 * e1)
    return y.join(x, "t").where("source <> target").groupBy("source", "target").agg(((own - both) / (own + EPS)).alias("improvement"))


def derived_curves(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Energy (Euclidean norm), variance and mean of all cells by step."""
    return df.groupBy(*keys, t).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("energy"), F.var_samp("v").alias("variance"), F.avg("v").alias("mean"))


def channel_covariance(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over pairs of different channels of the sum of products of their deviations."""
    means = df.groupBy(*keys, "c").agg(F.avg("v").alias("m"))
    z = df.join(means, [*keys, "c"]).withColumn("z", F.col("v") - F.col("m"))
    a = z.select(*keys, F.col("c").alias("c1"), "y", "x", F.col("z").alias("z1"))
    b = z.select(*keys, F.col("c").alias("c2"), "y", "x", F.col("z").alias("z2"))
    sums = a.join(b, [*keys, "y", "x"]).where("c1 <> c2").groupBy(*keys, "c1", "c2").agg(F.sum(F.col("z1") * F.col("z2")).alias("s"))
    return sums.groupBy(*keys).agg(F.avg("s").alias("channel_covariance"))


def plateaus(df: DataFrame, keys: list[str], window: int = 10, least: float = 1e-3) -> DataFrame:
    """Whether each row's last `window` rows fell by less than `least` (a full window is needed)."""
    w = ordered(keys).rowsBetween(-(window - 1), 0)
    fall = F.first("y").over(w) - F.last("y").over(w)
    return df.withColumn("adapt", (F.count("*").over(w) == window) & (fall < least))


def early_stopping(df: DataFrame, keys: list[str], patience: int) -> DataFrame:
    """First row at which the running minimum has not improved for `patience` rows; null if never."""
    w = ordered(keys)
    best = F.min("y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("better", F.when(best.isNull() | (F.col("y") < best), F.col("t")))
    d = d.withColumn("since", F.col("t") - F.last("better", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys).agg(F.min(F.when(F.col("since") >= patience, F.col("t"))).alias("stop_at"), F.min("y").alias("best"))


def blend(df: DataFrame, keys: list[str], policy: str, dt: float | None = None, alpha: float | None = None) -> DataFrame:
    """Fold a sequence into a state by an update policy: autoregressive, residual (x + dt*o) or convex (a*x + (1-a)*o).

    A missing dt is 0.01 and a missing alpha 0.5; a given zero stays zero.
    """
    dt, alpha = 0.01 if dt is None else dt, 0.5 if alpha is None else alpha
    whole = df.groupBy(*keys).agg(F.count("*").alias("n"))
    d = df.withColumn("i", F.row_number().over(ordered(keys)) - 1).join(whole, keys)
    first, after = F.col("i") == 0, F.col("n") - 1 - F.col("i")
    # What each row adds to the last state: the fold, written out.
    weight = {
        "autoregressive": F.when(after == 0, F.lit(1.0)).otherwise(F.lit(0.0)), "residual": F.when(first, F.lit(1.0)).otherwise(F.lit(dt)),
        "convex": F.pow(F.lit(float(alpha)), after) * F.when(first, F.lit(1.0)).otherwise(F.lit(1 - alpha)),
    }
    if policy not in weight:
        raise ValueError(f"no policy {policy!r}; there are {sorted(weight)}")
    return d.groupBy(*keys).agg(F.sum(F.col("y") * weight[policy]).alias("state"))
