"""Levels of effort: which of a family's measures are computed, and which a shape rules out.

A family declares its measures with the level from which they belong to it and with what they
need of the data (so many channels, so many steps). A plan follows from a level and a shape
before any row is read: what runs, and the columns that are there but empty because the shape
rules their measure out. So a table's columns depend on the level alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.operators import sequence as Q

LEVELS = ("fast", "medium", "full")


@dataclass(frozen=True)
class Measure:
    """Columns over keys that one function makes of a relation; `least` names what the shape must have."""

    level: str
    columns: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    least: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Family:
    """Measures that share their keys, and the rows that they are about: `rows` makes the keys of a relation."""

    keys: tuple[str, ...]
    measures: tuple[Measure, ...]
    rows: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plan:
    family: Family
    runs: tuple[Measure, ...]
    empty: tuple[Measure, ...]

    @property
    def columns(self) -> list[str]:
        """The table's columns, in order of the family's measures."""
        chosen = {id(m) for m in (*self.runs, *self.empty)}
        return [*self.family.keys, *(c for m in self.family.measures if id(m) in chosen for c in m.columns)]


def plan(family: Family, level: str, shape: Mapping[str, int]) -> Plan:
    """What runs at a level on data of a shape; what the shape rules out stays as empty columns."""
    if level not in LEVELS:
        raise ValueError(f"no level {level!r}; there are {LEVELS}")
    chosen = [m for m in family.measures if LEVELS.index(m.level) <= LEVELS.index(level)]
    fits = [all(shape.get(k, 0) >= n for k, n in m.least.items()) for m in chosen]
    return Plan(family, tuple(m for m, ok in zip(chosen, fits, strict=True) if ok), tuple(m for m, ok in zip(chosen, fits, strict=True) if not ok))


def extract(df: DataFrame, made: Plan) -> DataFrame:
    """The plan's table: its measures side by side by key, NaN where the shape rules one out."""
    keys = list(made.family.keys)
    parts = [m.run(df).select(*keys, *m.columns) for m in made.runs]
    # Measures of one family have the same keys; without any, the rows come from the relation.
    out = reduce(lambda a, b: a.join(b, keys, "full"), parts) if parts else made.family.rows(df)
    out = out.withColumns({c: F.lit(float("nan")) for m in made.empty for c in m.columns}) if made.empty else out
    return out.select(*made.columns)


def series_shape(df: DataFrame) -> dict[str, int]:
    """Channels and steps of a relation (c, t, y)."""
    r = df.agg(F.count_distinct("c").alias("channels"), F.count_distinct("t").alias("steps")).first()
    return r.asDict()


def _lone(df: DataFrame) -> DataFrame:
    """A row a channel, with nothing to pair it with."""
    return df.select(F.col("c").alias("source")).distinct().withColumn("target", F.lit(None).cast(df.schema["c"].dataType))


_PAIR = {"channels": 2, "steps": 3}
#: How a channel's past tells of another one's present, (c, t, y) by source and target.
CAUSALITY = Family(
    ("source", "target"),
    (
        Measure("fast", ("asymmetry",), lambda df: Q.lagged_asymmetry(df).withColumnsRenamed({"i": "source", "j": "target"}), _PAIR),
        Measure("medium", ("improvement",), Q.granger_improvement, _PAIR),
        Measure("full", ("transfer_entropy",), Q.transfer_entropy, _PAIR),
    ),
    _lone,
)
