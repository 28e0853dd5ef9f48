"""Training of codebooks: exponential averages of what codes are given, and resets of codes that hardly anything falls to.

A state is a table (by..., code, vec, size, weight) of as many rows as codes (checked by `assign_codes`). A step
assigns every vector to its nearest code (row-local, the codebooks are broadcast), sums
vectors by code (one aggregate, combined in each task) and decays the old sums; only the
state passes from step to step, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridstat.operators.matrix import assign_codes
from gridstat.sources.steps import Steps

#: Dimensions that are summed as columns of one aggregate; vectors with more are summed by (code, dimension).
WIDE = 256


def initial_state(codebook: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The state before the first step: nothing was assigned yet, sums are the codes themselves."""
    return codebook.select(*(by or []), "code", "vec", F.lit(0.0).alias("size"), F.col("vec").alias("weight"))


def code_sums(assigned: DataFrame, dims: int, vector: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by..., code, n, sums, error): vectors of each code, their sum, and the sum of squared distances."""
    keys = [*(by or []), "code"]
    n, error = F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("error")
    if dims <= WIDE:
        return assigned.groupBy(*keys).agg(n, F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(dims)]).alias("sums"), error)
    each = assigned.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    sums = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("sums"))
    return assigned.groupBy(*keys).agg(n, error).join(sums, keys).select(*keys, "n", "sums", "error")


def step(vectors: DataFrame, state: DataFrame, decay: float = 0.99, epsilon: float = 1e-5, vector: str = "vec", by: list[str] | None = None) -> DataFrame:
    """The state after one pass over the vectors, with `n` and `error` of the pass.

    Sizes are smoothed so that no code's is zero while anything was assigned in its group.
    """
    keys = by or []
    state = state.select(*keys, "code", "vec", "size", "weight")
    first = state.select(F.size("vec").alias("d")).first()
    found = assign_codes(vectors, state.select(*keys, "code", F.col("vec").alias("vec")), vector, by)
    sums = code_sums(found, first["d"] if first else 0, vector, by)
    both = state.join(F.broadcast(sums), [*keys, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("error", F.coalesce("error", F.lit(0.0)))
    both = both.withColumn("raw", decay * F.col("size") + (1 - decay) * F.col("n"))
    totals = both.groupBy(*keys).agg(F.sum("raw").alias("total"), F.count("*").alias("k"))
    both = both.join(F.broadcast(totals), keys) if keys else both.join(F.broadcast(totals))  # a row a group, as many as codebooks
    size = F.when(F.col("total") > 0, (F.col("raw") + epsilon) / (F.col("total") + F.col("k") * epsilon) * F.col("total")).otherwise(F.lit(0.0))
    sums_or_none = F.coalesce("sums", F.transform("weight", lambda _: F.lit(0.0)))
    both = both.withColumn("size", size).withColumn("weight", F.zip_with("weight", sums_or_none, lambda w, x: decay * w + (1 - decay) * x))
    vec = F.when(F.col("size") > 0, F.transform("weight", lambda w: w / F.col("size"))).otherwise(F.col("vec"))
    return both.select(*keys, "code", vec.alias("vec"), "size", "weight", "n", "error")


def train(
    vectors: DataFrame, codebook: DataFrame, steps: int, decay: float = 0.99, epsilon: float = 1e-5, vector: str = "vec", by: list[str] | None = None, folder: str | None = None
) -> Steps:
    """Train for a number of steps; each one's state stays as a table. A folder that holds some of them already is gone on with."""
    kept = Steps(vectors.sparkSession, folder)
    state = initial_state(codebook, by).withColumns({"n": F.lit(0).cast("long"), "error": F.lit(0.0)})
    kept.write(0, state)
    for i in range(kept.last() + 1, steps + 1):
        kept.write(i, step(vectors, kept.read(i - 1), decay, epsilon, vector, by))
    return kept


def dead_codes(state: DataFrame, percent: float = 10.0, most: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """(by..., code, place): codes whose size is at or below a percentile of their codebook's sizes, smallest first, at most a share of the codebook."""
    keys = by or []
    bounds = state.groupBy(*keys).agg(F.percentile("size", percent / 100).alias("bound"), F.count("*").alias("k"))  # as many sizes as codes
    low = (state.join(F.broadcast(bounds), keys) if keys else state.join(F.broadcast(bounds))).where(F.col("size") <= F.col("bound"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "code"))
    return low.withColumn("place", place).where(F.col("place") <= F.floor(F.col("k") * most)).select(*keys, "code", "place")


def _draw(id: Column, seed: int) -> Column:
    """A seeded order of rows, as text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id.cast("string")).cast("binary"))


def drawn(vectors: DataFrame, wanted: DataFrame, id: str, seed: int, vector: str = "vec", by: list[str] | None = None) -> DataFrame:
    """(by..., place, drawn): the first `wanted` vectors of each group in a seeded order of their ids.

    The order's beginning is found by a share of the order's range that holds enough of it (checked; else all
    rows are looked at), so that no group is sorted whole.
    """
    keys = by or []
    order = vectors.select(*keys, F.col(vector).alias("drawn"), _draw(F.col(id), seed).alias("draw"))
    n = order.groupBy(*keys).agg(F.count("*").alias("rows"))
    n = (n.join(wanted, keys) if keys else n.join(wanted)).where("wanted > 0")
    share = F.least(F.lit(1.0), (F.col("wanted") + 10 * F.sqrt("wanted") + 10) / F.col("rows"))
    asked = n.select(*keys, "wanted", "rows", share.alias("share")).collect()  # a row a codebook
    spark = vectors.sparkSession
    schema = n.select(*keys, "wanted", "rows").schema.add("share", "double")
    at = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / 2.0**32
    while True:
        limits = F.broadcast(spark.createDataFrame(asked, schema))
        first = (order.join(limits, keys) if keys else order.join(limits)).where(at < F.col("share"))
        enough = first.groupBy(*keys).agg(F.count("*").alias("c"))
        short = (limits.join(enough, keys, "left") if keys else limits.join(enough)).where((F.coalesce("c", F.lit(0)) < F.least("wanted", "rows")) & (F.col("share") < 1))
        if short.isEmpty():
            break
        asked = [(*r[:-1], 1.0) for r in asked]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))
    return first.withColumn("place", place).where(F.col("place") <= F.col("wanted")).select(*keys, "place", "drawn")


def reset_dead(
    state: DataFrame, vectors: DataFrame, id: str, percent: float = 10.0, most: float = 0.25, seed: int = 0, vector: str = "vec", by: list[str] | None = None
) -> DataFrame:
    """The state with dead codes moved to vectors drawn by seed; their size becomes the lower median, so that they don't die at once.

    `moved` tells which codes were. A group with fewer vectors than dead codes moves as many as it has.
    """
    keys = by or []
    dead = dead_codes(state, percent, most, by)
    wanted = dead.groupBy(*keys).agg(F.count("*").alias("wanted"))
    new = drawn(vectors, wanted, id, seed, vector, by).join(dead, [*keys, "place"]).select(*keys, "code", "drawn")
    middle = state.groupBy(*keys).agg(F.expr("percentile_disc(0.5) within group (order by size)").alias("middle"))
    both = state.join(F.broadcast(middle), keys) if keys else state.join(F.broadcast(middle))
    both = both.join(F.broadcast(new), [*keys, "code"], "left")
    moved = F.col("drawn").isNotNull()
    return both.select(
        *keys, "code", F.coalesce("drawn", "vec").alias("vec"), F.when(moved, F.col("middle")).otherwise(F.col("size")).alias("size"),
        F.coalesce("drawn", "weight").alias("weight"), moved.alias("moved"),
    )


def quantisation_error(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., error): mean squared difference of a number and its code's in the pass that led to a state."""
    keys, d = by or [], F.size("vec")
    return state.groupBy(*keys).agg((F.sum("error") / F.sum(F.col("n") * d)).alias("error"))


