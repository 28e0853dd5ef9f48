"""Families of features: names, their extractors, and the summary over time and realizations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.operators import descriptive as D
from gridstat.operators import grid as G
from gridstat.sources.config import setting

#: family: its kernels over packed grids.
FAMILIES: dict[str, list[G.Kernel]] = {}


def register_family(name: str, *kernels: G.Kernel) -> None:
    """Add a family; a name can be given once."""
    if name in FAMILIES:
        raise ValueError(f"family {name!r} is registered already")
    FAMILIES[name] = list(kernels)


def get_family(name: str) -> list[G.Kernel]:
    if name not in FAMILIES:
        raise KeyError(f"no family {name!r}; there are {sorted(FAMILIES)}")
    return FAMILIES[name]


register_family("gradients", G.GRADIENTS)
register_family("spectral", G.SPECTRAL)
register_family("structural", G.COMPONENTS, G.EDGES, G.GLCM)
register_family("physics", G.CORRELATION_STRUCTURE, G.CLUSTERING)
register_family("morphological", G.SHAPE_DESCRIPTORS, G.IMAGE_MOMENTS, G.granulometry())
register_family("multiscale", G.haar(), G.scales())
register_family("distributional", G.entropies(), G.RANKS)
register_family("initial", G.MORAN, G.CENTROID_DISTANCE, G.information(), G.SYMMETRY, G.INITIAL_MORPHOLOGY, G.CLUSTERS, G.POWER_LAW)


def extract(fields: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """Wide features of packed grids: all families in one pass over the rows."""
    return G.measure(fields, keys, [(f"{f}__", k) for f in families for k in get_family(f)])


def long_features(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "feature", "value")


def summarize(wide: DataFrame, sample: str, methods: list[str]) -> DataFrame:
    """(sample, feature, and a column a method): features reduced over a sample's rows."""
    return D.reduce_over(long_features(wide, [c for c in wide.columns if "__" not in c]), [sample, "feature"], "value", methods)


@dataclass(frozen=True)
class SummaryConfig:
    """A summary by declaration: families of measures, and how they are reduced over a sample's realizations."""

    families: list[str] = setting(["gradients", "spectral", "structural", "physics", "morphological", "multiscale", "distributional"], items=(1, 100))
    methods: list[str] = setting(["mean", "std", "cv"], among=tuple(D.REDUCTIONS), items=(1, len(D.REDUCTIONS)))


def feature_names(config: SummaryConfig) -> list[str]:
    """Names of a summary's features, in order, before any data is read: family__measure."""
    return [f"{f}__{c}" for f in config.families for k in get_family(f) for c in k.columns]


def feature_count(config: SummaryConfig) -> int:
    """Numbers of a sample in a summary: features times reductions."""
    return len(feature_names(config)) * len(config.methods)


def summary_of(fields: DataFrame, sample: str, realization: str, config: SummaryConfig) -> DataFrame:
    """The summary that a declaration asks for: (sample, feature, a column a method)."""
    return summarize(extract(fields, [sample, realization], config.families), sample, config.methods)


#: Reductions over realizations by name, as column builders.
AGGREGATES: dict[str, Callable[[str], F.Column]] = {
    "mean": F.avg, "variance": F.var_samp, "std": F.stddev_samp, "envelope": lambda c: F.max(c) - F.min(c), "overlay": F.avg,
}


def aggregate_map(cells: DataFrame, name: str) -> DataFrame:
    """One ensemble map by name."""
    if name not in AGGREGATES:
        raise KeyError(f"no aggregate {name!r}; there are {sorted(AGGREGATES)}")
    return cells.groupBy("sample_id", "y", "x").agg(AGGREGATES[name]("v").alias(name))


def align(families: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Families side by side by sample; columns named family__name."""
    named = [df.select(key, *[F.col(c).alias(f"{f}__{c}") for c in df.columns if c != key]) for f, df in families.items()]
    return reduce(lambda a, b: a.join(b, key), named)
