"""Default sizes of a hierarchy of code tables, as columns: tokens a level, lengths of vectors a level, compression ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ratios of the three levels by how high a score is (above the first bound, above the second, else).
BY_VARIANCE = [(0.7, (0.25, 0.75, 2.0)), (0.4, (0.4, 1.0, 1.8)), (None, (0.5, 1.0, 1.5))]
BY_DIMENSIONS = [(0.8, (0.3, 0.8, 1.5)), (0.5, (0.4, 1.0, 1.8)), (None, (0.5, 1.2, 2.0))]
BY_REDUNDANCY = [(0.7, (0.3, 0.7, 1.2)), (0.4, (0.5, 1.0, 1.5)), (None, (0.6, 1.5, 2.5))]


def default_tokens(dim: Column, n_samples: Column, levels: int = 3, uniform: bool = False) -> list[Column]:
    """Tokens of each level: seven for each doubling of the dimensions, a multiple of four at the top, halved from level to level."""
    base = F.floor(F.log2(dim) * 7)
    grown = F.least(F.lit(28), F.greatest(F.lit(5), F.floor(F.sqrt(n_samples / 1000) * 4.8)))
    top = F.floor(base / 4) * 4
    top = F.when(n_samples > 1000, F.greatest(top, grown)).otherwise(top).cast("int")
    return [top] + [top if uniform else F.greatest(F.lit(6), F.floor(base / 2**k)).cast("int") for k in range(1, levels)]


def _multiple_of_four(x: Column) -> Column:
    return (F.ceil(x / 4) * 4).cast("int")


def default_dims(dim: Column, tokens: list[Column], n_samples: Column) -> list[Column]:
    """Lengths of vectors a level: wider than the dimensions, halved from level to level, multiples of four, strictly falling."""
    wide = dim * (1 + F.pow(dim / 100, F.lit(0.7)) * 0.8)
    out: list[Column] = []
    for k, n in enumerate(tokens):
        own = _multiple_of_four(wide / 2**k * F.greatest(F.lit(1.0), F.log2(n) / 20))
        if k:
            own, before = F.greatest(F.lit(8), own), out[-1]
            fallen = F.greatest(before - 4, F.floor(before / 2), F.lit(4))
            out.append(F.when(own >= before, fallen).otherwise(own).cast("int"))
        else:
            least = F.least(F.lit(64), F.greatest(F.lit(8), _multiple_of_four(F.log10(n_samples) * 12)))
            out.append(F.when(n_samples > 1000, F.greatest(least, own)).otherwise(F.greatest(F.lit(8), own)).cast("int"))
    return out


def dims_by_ratio(dim: Column, ratios: list[Column]) -> list[Column]:
    """Lengths of vectors by given ratios: multiples of four, four at least."""
    return [F.greatest(F.lit(4), _multiple_of_four(dim * r)) for r in ratios]


def _picked(score: Column, table: list, level: int) -> Column:
    out = F.lit(table[-1][1][level])
    for bound, ratios in reversed(table[:-1]):
        out = F.when(score > bound, F.lit(ratios[level])).otherwise(out)
    return out


def adaptive_ratios(strategy: str, variance: Column, dimensions: Column, information: Column, correlation: Column, levels: int = 3) -> list[Column]:
    """Ratios of each level by scores between 0 and 1: of the variance, of the number of features, of what few components explain, of correlation.

    `balanced` weighs the three tables by how much each score stands out.
    """
    redundancy = (information + correlation) / 2
    own = {"variance": (variance, BY_VARIANCE), "dimensionality": (dimensions, BY_DIMENSIONS), "information": (redundancy, BY_REDUNDANCY)}
    if strategy in own:
        return [_picked(*own[strategy], k) for k in range(levels)]
    if strategy != "balanced":
        raise ValueError(f"no strategy {strategy!r}; there are {sorted([*own, 'balanced'])}")
    weights = {"variance": variance, "dimensionality": dimensions, "information": 1 - information}
    whole = variance + dimensions + 1 - information
    share = {n: F.when(whole > 0, w / whole).otherwise(F.lit(1 / 3)) for n, w in weights.items()}
    return [F.bround(sum((_picked(*own[n], k) * share[n] for n in own), F.lit(0.0)), 2) for k in range(levels)]
