"""Unit-cube parameters: decoding to typed values, one-hot columns, strata, Sobol points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def validate_weights(weights: list[float], choices: list) -> None:
    if len(weights) != len(choices):
        raise ValueError("a weight for each choice is needed")
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")


def decode(u: Column, spec: dict) -> Column:
    """A unit value as a typed value.

    kind: integer (half-even rounding) or continuous (with `log`, between powers of ten) between `lo` and `hi`;
    choice among `choices` (with `weights`, by their cumulated sums, a value at an edge going right); boolean (u > 0.5).
    """
    kind = spec["kind"]
    if kind == "integer":
        return F.rint(spec["lo"] + u * (spec["hi"] - spec["lo"])).cast("int")
    if kind == "continuous":
        if spec.get("log"):
            lo, hi = math.log10(spec["lo"]), math.log10(spec["hi"])
            return F.pow(F.lit(10.0), lo + u * (hi - lo))
        return spec["lo"] + u * (spec["hi"] - spec["lo"])
    if kind == "boolean":
        return u > 0.5
    if kind == "choice":
        return F.element_at(F.array(*map(F.lit, spec["choices"])), choice_index(u, spec) + 1)
    raise ValueError(f"no kind {kind!r}")


def choice_index(u: Column, spec: dict) -> Column:
    """Number of the choice that a unit value stands for, from 0."""
    n = len(spec["choices"])
    weights = spec.get("weights")
    if not weights:
        return F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    validate_weights(weights, spec["choices"])
    edges = [sum(weights[: i + 1]) for i in range(n - 1)]
    return reduce(lambda a, b: a + b, [(u >= e).cast("int") for e in edges], F.lit(0))


def one_hot(index: Column, n: int) -> list[Column]:
    return [(index == i).cast("double") for i in range(n)]


def feature_columns(u: dict[str, Column], spec: dict[str, dict[str, dict]]) -> dict[str, Column]:
    """Features of decoded parameters, in the order of the spec's categories: {category: {parameter: spec of decode()}}.

    A number is `category_parameter`; one on a log scale is its log10 as well, and
    where it lies between its bounds; a choice is a column a choice, and its value
    if choices are numbers.
    """
    out: dict[str, Column] = {}
    for category, parameters in spec.items():
        for name, own in parameters.items():
            at, value = f"{category}_{name}", decode(u[name], own)
            if own["kind"] == "choice":
                if all(isinstance(c, int | float) for c in own["choices"]):
                    out[at] = value.cast("double")
                hot = one_hot(choice_index(u[name], own), len(own["choices"]))
                out |= {f"{at}_{c}": h for c, h in zip(own["choices"], hot, strict=True)}
            else:
                out[at] = value.cast("double")
                if own.get("log"):
                    lo, hi = math.log10(own["lo"]), math.log10(own["hi"])
                    out[f"{at}_log"] = F.log10(value + 1e-10)
                    out[f"{at}_score"] = F.least(F.greatest((F.log10(value + 1e-10) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return out


def stratum(u: Column, strata: int) -> Column:
    return F.least(F.greatest(F.floor(u * strata), F.lit(0)), F.lit(strata - 1)).cast("int")


def stratification(units: list[Column], strata: int) -> dict[str, Column]:
    """Mixed-radix number of the stratum, distance to the cube's surface, distance from its centre."""
    number = reduce(lambda a, b: a + b, [stratum(u, strata) * (strata**i) for i, u in enumerate(units)])
    edge = F.least(*[F.least(u, 1 - u) for u in units])
    centre = F.sqrt(reduce(lambda a, b: a + b, [(u - 0.5) * (u - 0.5) for u in units]))
    return {"stratum_hash": number, "boundary_distance": edge, "centre_distance": centre}


#: Direction numbers of the first dimensions (fixed values, from the published tables of Joe and Kuo): degree, coefficients, initial m.
JOE_KUO = [
    (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]),
    (5, 7, [1, 1, 7, 11, 19]),
]
BITS = 30


def direction_numbers(dim: int) -> list[int]:
    """Direction numbers of a dimension (0: van der Corput), scaled to BITS bits."""
    if dim == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    if dim > len(JOE_KUO):
        raise ValueError(f"at most {len(JOE_KUO) + 1} dimensions")
    degree, poly, m = JOE_KUO[dim - 1]
    m = list(m)
    for k in range(degree, BITS):
        new = m[k - degree] ^ (m[k - degree] << degree)
        for j in range(1, degree):
            if poly >> (degree - 1 - j) & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [v << (BITS - 1 - k) for k, v in enumerate(m)]


def sobol(spark: SparkSession, n: int, dims: int) -> DataFrame:
    """The first n Sobol points, each computed from its own index: no state, any partitioning."""
    points = spark.range(n)
    gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))

    def coordinate(dim: int) -> Column:
        bits = [F.when(F.shiftright(gray, k).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(F.lit(0)) for k, v in enumerate(direction_numbers(dim)[: max(1, n.bit_length())])]
        return reduce(lambda a, b: a.bitwiseXOR(b), bits).cast("long") / float(1 << BITS)

    return points.select("id", *[coordinate(d).alias(f"u{d}") for d in range(dims)])
