"""Exact order statistics of groups of any size.

Spark's percentiles keep every distinct value of a key in one buffer. Here that is done
for keys of a bounded number of rows alone. For larger ones, all keys and all ranks at
once, ranges are narrowed: rows within a rank's range are counted by part of the range
(combined in each task), the part that holds the rank becomes the range, from its least to
its largest value, until both are one or few enough values lie within. What a task holds
are counts of parts and at most that many values of a range. A range shrinks by the number
of parts in a round, so rounds are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.sources.steps import Steps

#: Rows of a key whose values may lie in one aggregation buffer.
SMALL = 100_000
#: Parts of a range.
PARTS = 1_024


def ordered(v: Column) -> Column:
    """A number for ordering: NaN ranks with infinity."""
    x = v.cast("double")
    return F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)


def _joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join by keys, null ones too; without keys the other side is one group."""
    if not keys:
        return df.join(F.broadcast(other))
    o = other.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(o, same).drop(*[f"_{k}" for k in keys])


def _part(v: Column, lo: Column, hi: Column, parts: int) -> Column:
    """0 for the least value, parts + 1 for the largest, between them by distance from the least. Infinite ends leave the rest together."""
    share = (v - lo) / (hi - lo)
    inner = F.when(F.isnan(share), F.lit(0)).otherwise(F.floor(share * parts).cast("int"))
    return F.when(v <= lo, F.lit(0)).when(v >= hi, F.lit(parts + 1)).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(parts - 1)) + 1)


def narrow(counted: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The next state, of ranges that hold each rank: state has (keys, place, rank, lo, hi, n), rank counted from lo and n values
    in the range; counted has (keys, place, part, n, least, most) of every part of the ranges that are narrowed."""
    by = Window.partitionBy(*keys, "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    at = _joined(before, state.select(*keys, F.col("place").alias("at"), "rank"), keys).where("at = place")
    found = at.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    moved = found.select(*keys, "place", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), "n")
    return moved


def select_ranks(df: DataFrame, keys: list[str], v: str, ranks: DataFrame, few: int = SMALL, parts: int = PARTS) -> DataFrame:
    """(keys, place, value): the values of ranks (keys, place, rank from 0, lo, hi, n), where lo and hi are a key's least and
    largest value and n is its number of values."""
    steps = Steps(df.sparkSession)
    state, step = steps.write(0, ranks.select(*keys, F.col("place").cast("int").alias("place"), "rank", "lo", "hi", "n")), 0
    values = df.select(*keys, ordered(F.col(v)).alias("_v")).where(F.col("_v").isNotNull())
    wide, open_ = (F.col("lo") < F.col("hi")) & (F.col("n") > few), (F.col("lo") < F.col("hi")) & (F.col("n") <= few)

    def within(which: Column) -> DataFrame:
        return _joined(values, state.where(which).drop("n"), keys).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))

    while not state.where(wide).isEmpty():
        part = _part(F.col("_v"), F.col("lo"), F.col("hi"), parts).alias("part")
        counted = within(wide).groupBy(*keys, "place", part).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        step += 1
        state = steps.write(step, state.where(~wide).unionByName(narrow(counted, state.where(wide), keys)))
        steps.files.delete(f"step-{step - 1:06d}")
    held = within(open_).groupBy(*keys, "place").agg(F.get(F.array_sort(F.collect_list("_v")), F.first("rank").cast("int")).alias("value"))
    return state.where("lo >= hi").select(*keys, "place", F.col("lo").alias("value")).unionByName(held)


def _positions(shares: list[float], lower: bool) -> list[tuple[Column, Column, Column]]:
    """For each share: the ranks below and above its position among n rows, and how far it lies between them."""
    out = []
    for q in shares:
        at = F.lit(float(q)) * (F.col("n") - 1)
        k = F.floor(at + 0.0)
        out.append((k, k if lower else F.ceil(at), F.lit(0.0) if lower else at - k))
    return out


def quantiles(df: DataFrame, keys: list[str], v: str, shares: list[float], small: int = SMALL, parts: int = PARTS) -> DataFrame:
    """(keys, q): an array of exact quantiles of v for each group, between two values by distance; null values are left out."""
    return _quantiles(df, keys, v, shares, False, small, parts)


def lower_medians(df: DataFrame, keys: list[str], v: str, small: int = SMALL, parts: int = PARTS) -> DataFrame:
    """(keys, q): one quantile, the lower of the two middle values."""
    return _quantiles(df, keys, v, [0.5], True, small, parts)


def _quantiles(df: DataFrame, keys: list[str], v: str, shares: list[float], lower: bool, small: int, parts: int) -> DataFrame:
    values = df.select(*keys, ordered(F.col(v)).alias("_v"))
    sizes = values.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    held = F.array(F.expr("percentile_disc(0.5) within group (order by _v)")) if lower else F.percentile("_v", F.array(*[F.lit(float(q)) for q in shares]))
    # Kept as a table: its size is known, so that few keys are broadcast and the values stay where they are.
    steps = Steps(df.sparkSession)
    sizes = steps.write(0, sizes)
    is_large = F.col("n") > small
    kinds = {r["large"] for r in sizes.select(is_large.alias("large")).distinct().collect()}
    if True not in kinds:
        return values.groupBy(*keys).agg(held.alias("q"))
    large = sizes.where(is_large)
    few = None
    if keys and False in kinds:
        few = _joined(values, sizes.where(~is_large).select(*keys, F.lit(1).alias("_few")), keys).groupBy(*keys).agg(held.alias("q"))
    places = _positions(shares, lower)
    ranks = large.select(*keys, "lo", "hi", "n", F.posexplode(F.array(*[x for k, up, _ in places for x in (k, up)])).alias("place", "rank"))
    found = select_ranks(values, keys, "_v", ranks, small, parts)
    values_of = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    both = _joined(large.select(*keys, "n"), values_of, keys)

    def between(i: int, share: Column) -> Column:
        a, b = F.col("m")[2 * i], F.col("m")[2 * i + 1]
        return F.when(a == b, a).otherwise((1 - share) * a + share * b)

    many = both.select(*keys, F.array(*[between(i, share) for i, (_, _, share) in enumerate(places)]).alias("q"))
    return steps.write(1, many if few is None else few.unionByName(many))
