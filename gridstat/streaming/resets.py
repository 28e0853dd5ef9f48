"""The ladder of reset rules over a stream of histories: what windows say in batch is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridstat.operators import resets as L

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean(values: list[float]) -> float | None:
    return sum(values) / len(values) if values else None


def critical(features: int | None) -> float:
    """Utilisation below which a category of so many features is critically low; operators.resets.critical has it as a column."""
    if features is None:
        return L.UNKNOWN
    if features <= L.CRITICAL[0][0]:
        return L.CRITICAL[0][1]
    for (a, low), (b, high) in zip(L.CRITICAL, L.CRITICAL[1:], strict=False):
        if features <= b:
            return low + (features - a) * round((high - low) / (b - a), 4)
    return L.CRITICAL[-1][1]


class Run:
    """A run's state: the last reset, how many epochs were seen, the last one, and the last utilisations and losses."""

    def __init__(self, rules: L.Ladder, last: int = 0, seen: int = 0, epoch: int = 0, utilizations=(), losses=()):
        self.rules, self.last, self.seen, self.epoch = rules, last, seen, epoch
        self.utilizations, self.losses = list(utilizations), list(losses)

    @property
    def state(self) -> tuple:
        return self.last, self.seen, self.epoch, self.utilizations, self.losses

    def read(self, epoch: int, utilization: float, loss: float, stale: int, categories) -> str | None:
        """The rule that resets at this epoch, if any does; epochs up to the last one are late and not looked at."""
        if epoch <= self.epoch:
            return None
        rules, back, half = self.rules, self.rules.lookback, L.COLLAPSE_EPOCHS // 2
        keep = max(2 * back, L.COLLAPSE_EPOCHS)
        self.epoch, self.seen = epoch, self.seen + 1
        self.utilizations, self.losses = [*self.utilizations, utilization][-keep:], [*self.losses, loss][-keep:]
        u = self.utilizations
        wait = rules.interval * max((s for s in L.STAGES if s[0] <= epoch), key=lambda s: s[0])[1]
        category = any(c["utilization"] is not None and c["utilization"] < critical(c["features"]) for c in categories if c is not None)
        fell = _mean(u[-2 * half : -half]) - _mean(u[-half:]) if self.seen >= L.COLLAPSE_EPOCHS else 0.0
        low = utilization <= rules.low and stale <= L.STALE
        if low and self.seen >= 2 * back:
            recent, before = _mean(u[-back:]), _mean(u[-2 * back : -back])
            trend = recent < before - L.TREND or (recent < rules.low and abs(recent - before) < L.TREND)
            low = trend and _mean(self.losses[-2 * back : -back]) - _mean(self.losses[-back:]) <= L.GAIN
        reason = L.decide(epoch, self.last, wait, category, epoch > L.COLLAPSE_EPOCHS and fell > L.COLLAPSE_FALL, utilization < L.EMERGENCY, low)
        if reason:
            self.last = epoch
        return reason


class _Processor(StatefulProcessor):
    def __init__(self, rules: L.Ladder):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("run", "last long, seen long, epoch long, utilizations array<double>, losses array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = Run(self.rules, *(self.kept.get() if self.kept.exists() else ()))
        came = pd.concat(list(rows)).sort_values("epoch")
        took = []
        for r in came.itertuples(index=False):
            reason = run.read(int(r.epoch), float(r.utilization), float(r.loss), int(r.stale), r.categories)
            if reason:
                took.append((key[0], int(r.epoch), reason))
        self.kept.update(run.state)
        yield pd.DataFrame(took, columns=["run", "epoch", "reason"])

    def close(self) -> None:
        pass


def resets(history: DataFrame, rules: L.Ladder = L.Ladder()) -> DataFrame:  # noqa: B008
    """(run, epoch, reason) of a stream of histories, as operators.resets gives them for a table.

    A run's epochs must come in order from batch to batch; within one they are sorted. The state is a row a
    run, of bounded size. The session's state store must be RocksDB: it is set here unless the session names one.
    """
    spark = history.sparkSession
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)
    kind = history.schema["run"].dataType.simpleString()
    return history.groupBy("run").transformWithStateInPandas(_Processor(rules), f"run {kind}, epoch long, reason string", "Append", "None")
