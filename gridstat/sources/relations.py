"""The canonical relations, bound to the tables of a data folder.

fields   packed grids:  sample_id, label, h, w, data array<double> (row-major)
cells    one row a cell: sample_id, label, y, x, v
channels one row a cell of four 4 x 4 channels: sample_id, c, y, x, v
ensemble realizations of one sample: sample_id, realization, y, x, v
series   sequences: sample_id, c, t, y
features long feature matrix: sample_id, label, feature, value
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and column choices reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"), "label", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.col("embedding").cast("array<double>").alias("data")
    )


def cells_of(packed: DataFrame) -> DataFrame:
    """Cells of packed grids: position p is row p div w, column p mod w."""
    keys = [c for c in packed.columns if c not in ("h", "w", "data")]
    flat = packed.select(*keys, "w", F.posexplode("data").alias("p", "v"))
    return flat.select(*keys, (F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "v")


def packed_of(cells: DataFrame, keys: list[str], w: int = SIDE) -> DataFrame:
    """Packed grids of cells: the inverse of cells_of."""
    pos = F.struct((F.col("y") * w + F.col("x")).alias("p"), "v")
    grid = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(pos)).alias("s"))
    return grid.select(*keys, (F.size("s") / w).cast("int").alias("h"), F.lit(w).alias("w"), F.transform("s", lambda e: e["v"]).alias("data"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(fields(spark, sf_dir))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("p", "v"))
    return e.select(
        "sample_id", F.expr("p div 16").cast("int").alias("c"), F.expr("(p % 16) div 4").cast("int").alias("y"), (F.col("p") % 4).alias("x"), F.col("v").cast("double").alias("v")
    )


def ensemble_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed grids of each label's realizations, numbered by id."""
    w = Window.partitionBy("sample_id").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample_id"), "vec_id", F.col("embedding").cast("array<double>").alias("data"))
    return e.select("sample_id", (F.row_number().over(w) - 1).alias("realization"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), "data")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed grids of each label's realizations, named by their ids: no order of a label's rows, which one task would have to make.

    Rows are dealt over tasks, however few row groups the file has: what follows is work on single rows.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("sample_id"), F.col("vec_id").alias("realization"), F.col("embedding").cast("array<double>").alias("data"))
    return e.repartition("realization").select("sample_id", "realization", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), "data")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(ensemble_fields(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of each user and event type. Keys are named before the window, so that later groupings reuse its partitions."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("c"), "ts", "event_id", F.col("value").alias("y"))
    w = Window.partitionBy("sample_id", "c").orderBy("ts", "event_id")
    return e.select("sample_id", "c", (F.row_number().over(w) - 1).alias("t"), "y")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), "ts", "event_id", F.col("value").alias("y"))
    w = Window.partitionBy("sample_id").orderBy("ts", "event_id")
    return e.select("sample_id", (F.row_number().over(w) - 1).alias("t"), "y")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned channels: the mean value of each event type on each day."""
    e = table(spark, sf_dir, "events")
    t = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    return e.groupBy(F.col("event_type").alias("c"), t.alias("t")).agg(F.avg("value").alias("y"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("feature", "value"))
    return flat.withColumn("value", F.col("value").cast("double"))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for each label: the mean of its vectors."""
    f = features(spark, sf_dir).groupBy(F.col("label").alias("code"), "feature").agg(F.avg("value").alias("e"))
    pair = F.struct("feature", "e")
    return f.groupBy("code").agg(F.array_sort(F.collect_list(pair)).alias("s")).select("code", F.transform("s", lambda p: p["e"]).alias("vec"))
