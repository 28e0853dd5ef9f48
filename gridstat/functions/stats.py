"""Column functions: statistics that Spark lacks or names otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(_c(x), digits) + F.lit(0.0)


def sample_skewness(x: Column | str) -> Column:
    """Mean cubed z-score by the sample deviation; 0 for an almost constant group."""
    n = F.count(x)
    return F.when(F.stddev_samp(x) < 1e-4, F.lit(0.0)).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def sample_kurtosis(x: Column | str) -> Column:
    """Mean z-score to the fourth by the sample deviation, less 3; 0 for an almost constant group."""
    n = F.count(x)
    return F.when(F.stddev_samp(x) < 1e-4, F.lit(0.0)).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def lower_median(x: Column | str) -> Column:
    """The lower of the two middle values."""
    c = _c(x)
    return F.get(F.array_sort(F.collect_list(c)), F.floor((F.count(c) - 1) / 2).cast("int"))


def clipped(x: Column | str, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(_c(x), lo), hi)


def cv(x: Column | str) -> Column:
    """Sample deviation relative to the absolute mean."""
    return F.stddev_samp(x) / (F.abs(F.avg(x)) + EPS)


def equal_bins(x: Column, lo: Column, hi: Column, bins: int | Column) -> Column:
    """Bin of equal width between lo and hi, the last one closed on the right; 0 for a constant group."""
    width, bins = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)), F.lit(bins)
    return F.least(F.floor((x - lo) / width * bins), bins - 1).cast("int")


def floor_bins(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin as floor of the 0-1 value times bins - 1: the last bin holds the maximum only."""
    return F.floor((x - lo) / (hi - lo + EPS) * (bins - 1)).cast("int")


def entropy_of_counts(n: Column | str, total: Column | str) -> Column:
    """Aggregate: Shannon entropy (natural) of rows that hold a count and its group's total."""
    p = _c(n) / _c(total)
    return -F.sum(p * F.log(p))


def with_group_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with `lo` and `hi` of their group: a partial aggregate joined back, not a window over unbounded groups."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(bounds, keys)


def euclidean(a: Column, b: Column, dims: int | None = None) -> Column:
    """Distance of two vectors; with a known number of dimensions (256 at most) the sum is written out, which Spark compiles."""
    if dims and dims <= 256:
        terms = [(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(dims)]
        while len(terms) > 1:  # a shallow tree of sums
            terms = [x + y for x, y in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
        return F.sqrt(terms[0])
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
