"""When to reset dead codes: a ladder of rules over the history of a training run, in order of its epochs.

A history has rows (run, epoch, utilization, loss, stale, categories): mean utilisation of
the codebooks, validation loss, epochs without improvement, and for each category its
utilisation and its number of features (null: unknown). The rules, first one that holds:

1. a category is critically low for its size, and half an interval (25 epochs at least) has passed since the last reset;
2. utilisation collapses: its mean over ten epochs fell by more than 0.05, and ten epochs have passed;
3. within the interval (it doubles at epoch 100 and again at 200) nothing else resets;
4. utilisation is below 0.15;
5. it is low, falling or stable, the loss doesn't improve, and the run isn't about to end.

Whether a rule holds is a matter of the history alone but for the epochs since the last
reset. So windows say it for all epochs in parallel, epochs without a rule are left out, and a
fold with one number a run decides among the rest. A stream keeps the last epochs instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ladder:
    """Settings of the rules. The fixed values of the rules themselves are below."""

    low: float = 0.25
    interval: int = 50
    lookback: int = 10
    percent: float = 10.0


#: Utilisation of an emergency; of a category without a known number of features; a collapse's epochs, fall and
#: pause; a trend's size; a loss's gain; epochs without improvement; the pause of categories; the stages of a run (from epoch,
#: factor of the interval, factor of the percentile).
EMERGENCY, UNKNOWN = 0.15, 0.10
COLLAPSE_EPOCHS, COLLAPSE_FALL, COLLAPSE_PAUSE = 20, 0.05, 10
TREND, GAIN, STALE, CATEGORY_PAUSE = 0.01, 0.005, 30, 25
STAGES = ((0, 1, 1.0), (100, 2, 0.7), (200, 4, 0.5))
#: Utilisation below which a category of up to so many features is critical; between them it is linear, beyond the last constant.
CRITICAL = ((5, 0.05), (15, 0.10), (50, 0.15))


def critical(features: Column) -> Column:
    """Utilisation below which a category of so many features is critically low."""
    out = F.when(features.isNull(), F.lit(UNKNOWN)).when(features <= CRITICAL[0][0], F.lit(CRITICAL[0][1]))
    for (a, low), (b, high) in zip(CRITICAL, CRITICAL[1:], strict=False):
        out = out.when(features <= b, low + (features - a) * round((high - low) / (b - a), 4))
    return out.otherwise(F.lit(CRITICAL[-1][1]))


def _stage(epoch: Column, place: int) -> Column:
    out = F.lit(STAGES[0][place])
    for stage in STAGES[1:]:
        out = F.when(epoch >= stage[0], F.lit(stage[place])).otherwise(out)
    return out


def _signs(fell: Column, recent: Column, before: Column, gained: Column, seen: Column, rules: Ladder) -> list[Column]:
    """What the history says of an epoch, whenever the last reset was."""
    epoch, u, n = F.col("epoch"), F.col("utilization"), 2 * rules.lookback
    trend = (recent < before - TREND) | ((recent < rules.low) & (F.abs(recent - before) < TREND))
    low = (u <= rules.low) & (F.col("stale") <= STALE) & ((seen < n) | (trend & (gained <= GAIN)))
    category = F.exists("categories", lambda c: F.coalesce(c["utilization"] < critical(c["features"]), F.lit(False)))
    return [
        (rules.interval * _stage(epoch, 1)).alias("wait"), F.coalesce(category, F.lit(False)).alias("category"),
        F.coalesce((seen >= COLLAPSE_EPOCHS) & (epoch > COLLAPSE_EPOCHS) & (fell > COLLAPSE_FALL), F.lit(False)).alias("collapse"),
        F.coalesce(u < EMERGENCY, F.lit(False)).alias("emergency"), F.coalesce(low, F.lit(False)).alias("low"),
    ]


def signs(history: DataFrame, rules: Ladder = Ladder()) -> DataFrame:  # noqa: B008
    """(run, epoch, wait, category, collapse, emergency, low) of the epochs at which some rule may reset. Epoch 0 never does."""
    w = Window.partitionBy("run").orderBy("epoch")
    last = lambda n, skip=0: w.rowsBetween(-(n + skip) + 1, -skip)
    half, back = COLLAPSE_EPOCHS // 2, rules.lookback
    parts = history.where("epoch > 0").select(
        "*", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"),
        (F.avg("utilization").over(last(half, half)) - F.avg("utilization").over(last(half))).alias("fell"),
        F.avg("utilization").over(last(back)).alias("recent"), F.avg("utilization").over(last(back, back)).alias("before"),
        (F.avg("loss").over(last(back, back)) - F.avg("loss").over(last(back))).alias("gained"),
    )
    said = parts.select("run", "epoch", *_signs(*(F.col(c) for c in ("fell", "recent", "before", "gained", "seen")), rules))
    return said.where("category or collapse or emergency or low")


def decide(epoch: int, last: int, wait: int, category: bool, collapse: bool, emergency: bool, low: bool) -> str | None:
    """The rule that resets at an epoch, if any does."""
    since = epoch - last
    if category and since >= max(wait // 2, CATEGORY_PAUSE):
        return "category"
    if collapse and since >= COLLAPSE_PAUSE:
        return "collapse"
    if since < wait:
        return None
    return "emergency" if emergency else "low" if low else None


_SIGNS = ["wait", "category", "collapse", "emergency", "low"]


def resets(history: DataFrame, rules: Ladder = Ladder()) -> DataFrame:  # noqa: B008
    """(run, epoch, reason, percent): the resets of every run, and the percentile of sizes below which codes are dead then.

    A run's candidates are folded in order by one task that holds one number of it.
    """
    spark = history.sparkSession
    found = signs(history, rules)
    kind = found.schema["run"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(n, "run").sortWithinPartitions("run", "epoch").select("run", "epoch", *_SIGNS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = object(), 0
        for batch in batches:
            took = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row[0] != run:
                    run, last = row[0], 0
                reason = decide(row[1], last, *row[2:])
                if reason:
                    last = row[1]
                    took.append((i, reason))
            some = batch.take(pa.array([i for i, _ in took], pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([reason for _, reason in took], pa.string())], names=["run", "epoch", "reason"])

    made = ordered.mapInArrow(fold, f"run {kind}, epoch {found.schema['epoch'].dataType.simpleString()}, reason string")
    return made.withColumn("percent", rules.percent * _stage(F.col("epoch"), 2))


