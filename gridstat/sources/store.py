"""A dataset folder: tables of samples, fields and features as Parquet, in any file system that Spark knows.

Tables: params, inputs (packed fields), outputs (packed trajectories), metrics
(a row a step), samples (types, policies, regimes, grid sizes), metadata (key,
JSON value), and, for each family, features and registry. Readers push ranges of
sample_id and column choices down to the files.

A dataset grows by batches. Each batch has folders of its own in its tables, and counts once
its entry is in the manifest, which is written last and as a whole. Readers see batches of the
manifest only, so a write that failed between two tables leaves nothing that can be read; the
same batch written again replaces its files.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.sources.steps import Files

TABLES = ("params", "inputs", "outputs", "metrics", "samples")

_ENTRY = "batch string, tables array<string>, n long, least long, top long"


class Manifest:
    """The committed batches of a dataset: a small JSON file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def batches(self) -> list[dict]:
        """Entries in order of their names; one small row a batch."""
        if not any(n.startswith("batch-") for n in self.files.names("manifest")):
            return []
        rows = self.spark.read.schema(_ENTRY).json(f"{self.files.folder}/manifest/batch-*.json").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["batch"])

    def commit(self, entry: dict) -> None:
        self.files.publish(f"manifest/batch-{entry['batch']}.json", json.dumps(entry))

    def read(self, table: str, entries: list[dict]) -> DataFrame:
        """A table's rows of some batches."""
        root = f"{self.files.folder}/{table}"
        paths = [f"{root}/batch={e['batch']}" for e in entries if table in e["tables"]]
        if not paths:
            raise ValueError(f"no committed batch has a table {table}")
        return self.spark.read.parquet(*paths)


class DatasetWriter:
    """Writes batches of a dataset of a fixed number of samples."""

    def __init__(self, spark: SparkSession, path: str, num_samples: int, compression: str = "zstd"):
        self.spark, self.path, self.num_samples, self.compression = spark, path.rstrip("/"), num_samples, compression
        self.manifest = Manifest(spark, self.path)

    def write_batch(self, batch: str | None = None, **tables: DataFrame) -> str:
        """Write tables that hold the same samples as one batch, and commit it; its name.

        Ids beyond the dataset's size, or written before, are an error. Without a name it is the number of batches
        so far: the name of a batch that failed. Writers that work at the same time must name theirs.
        """
        unknown = set(tables) - set(TABLES)
        if unknown or not tables:
            raise ValueError(f"no table {sorted(unknown)}; there are {TABLES}")
        known = self.manifest.batches()
        batch = batch if batch is not None else f"{len(known):06d}"
        if any(e["batch"] == batch for e in known):
            raise ValueError(f"batch {batch!r} is committed")
        names = sorted(tables, key=TABLES.index)
        for name in names:
            tables[name].write.mode("overwrite").option("compression", self.compression).parquet(f"{self.path}/{name}/batch={batch}")
        # Checks read what was written, its ids alone.
        written = {name: self.spark.read.parquet(f"{self.path}/{name}/batch={batch}").select("sample_id").distinct() for name in names}
        sizes = {name: ids.agg(F.count("*").alias("n"), F.min("sample_id").alias("least"), F.max("sample_id").alias("top")).first() for name, ids in written.items()}
        size = sizes[names[0]]
        if len({tuple(s) for s in sizes.values()}) > 1 or (len(names) > 1 and reduce(lambda a, b: a.intersect(b), written.values()).count() != size["n"]):
            raise ValueError("the tables of a batch must hold the same samples")
        if size["top"] is not None and size["top"] >= self.num_samples:
            raise ValueError(f"the dataset has {self.num_samples} samples")
        # Only batches whose range of ids meets this one's are looked into.
        near = [e for e in known if e["n"] and size["n"] and e["least"] <= size["top"] and e["top"] >= size["least"]]
        for e in near:
            there = self.manifest.read(e["tables"][0], [e]).select("sample_id").where(F.col("sample_id").between(size["least"], size["top"]))
            if not written[names[0]].join(there, "sample_id", "left_semi").isEmpty():
                raise ValueError(f"batch {e['batch']!r} has some of these samples already")
        self.manifest.commit({"batch": batch, "tables": names, "n": size["n"], "least": size["least"], "top": size["top"]})
        return batch

    def discard_uncommitted(self) -> list[str]:
        """Delete files of batches that were never committed; only while no other writer works. Their tables and names."""
        known, gone = {e["batch"] for e in self.manifest.batches()}, []
        for name in TABLES:
            for folder in self.manifest.files.names(name):
                if folder.startswith("batch=") and folder[6:] not in known:
                    self.manifest.files.delete(f"{name}/{folder}")
                    gone.append(f"{name}/{folder}")
        return gone

    def write_metadata(self, values: dict) -> None:
        rows = [(k, json.dumps(v, sort_keys=True)) for k, v in values.items()]
        self.spark.createDataFrame(rows, "key string, value string").write.mode("append").parquet(f"{self.path}/metadata")


class DatasetReader:
    """Lazy slices of a dataset: a range of sample ids, or all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def _table(self, name: str, ids: tuple[int, int] | list[int] | None, *columns: str) -> DataFrame:
        entries = self.manifest.batches()
        if isinstance(ids, tuple):  # batches beyond the range aren't opened
            entries = [e for e in entries if e["n"] and e["least"] < ids[1] and e["top"] >= ids[0]] or entries[:1]
        df = self.manifest.read(name, entries)
        if isinstance(ids, tuple):
            df = df.where(F.col("sample_id").between(ids[0], ids[1] - 1))
        elif ids is not None:
            df = df.where(F.col("sample_id").isin(ids))
        return df.select("sample_id", *columns) if columns else df

    def get_parameters(self, ids=None) -> DataFrame:
        return self._table("params", ids)

    def get_inputs(self, ids=None) -> DataFrame:
        return self._table("inputs", ids)

    def get_outputs(self, ids=None) -> DataFrame:
        return self._table("outputs", ids)

    def get_trajectory(self, sample: int, realization: int) -> DataFrame:
        return self._table("outputs", [sample]).where(F.col("realization") == realization).orderBy("t")

    def get_metrics(self, sample: int, realization: int) -> DataFrame:
        """Metrics of a trajectory by step."""
        return self._table("metrics", [sample]).where(F.col("realization") == realization).orderBy("t")

    def get_sample_columns(self, *columns: str, ids=None) -> DataFrame:
        """ic_type, policy, noise_regime, grid_size and the like."""
        return self._table("samples", ids, *columns)

    def num_samples(self) -> int:
        """Samples of the committed batches, as the manifest says: no table is read."""
        return sum(e["n"] for e in self.manifest.batches())

    def shape_info(self) -> DataFrame:
        out = self._table("outputs", None)
        return out.agg(
            (F.max("sample_id") + 1).alias("samples"), (F.max("realization") + 1).alias("realizations"), (F.max("t") + 1).alias("steps"), F.max("h").alias("h"), F.max("w").alias("w")
        )

    def get_metadata(self) -> dict:
        return {r["key"]: json.loads(r["value"]) for r in self.spark.read.parquet(f"{self.path}/metadata").collect()}

    def compatible_with(self, other: DatasetReader) -> bool:
        """Whether two datasets have tables of the same columns and types."""
        return all(self._table(t, None).dtypes == other._table(t, None).dtypes for t in ("params", "inputs"))


class FeatureStore:
    """Feature tables by family: long rows (sample_id, ..., feature, value) and a registry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, family: str, level: str, rows: DataFrame, overwrite: bool = False) -> None:
        """One table of a family; an existing one is kept unless told otherwise."""
        tagged = rows.withColumns({"family": F.lit(family), "level": F.lit(level)})
        tagged.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{self.path}/{family}/{level}")
        names = rows.select("feature").distinct().withColumns({"family": F.lit(family), "level": F.lit(level)})
        names.write.mode("overwrite").parquet(f"{self.path}/registry/table={family}.{level}")

    def read(self, family: str, level: str, features: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{family}/{level}")
        return df.where(F.col("feature").isin(features)) if features else df

    def families(self) -> list[str]:
        return [r["family"] for r in self.spark.read.parquet(f"{self.path}/registry").select("family").distinct().orderBy("family").collect()]

    def registry(self) -> DataFrame:
        """(feature, family, level) of what is there now."""
        return self.spark.read.parquet(f"{self.path}/registry").select("feature", "family", "level").distinct()

    def series(self, family: str, level: str, features: list[str] | None = None) -> DataFrame:
        """(sample_id, feature, series): each feature's values in order of t."""
        rows = self.read(family, level, features).groupBy("sample_id", "feature").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
        return rows.select("sample_id", "feature", F.transform("s", lambda e: e["value"]).alias("series"))

    def with_inputs(self, reader: DatasetReader, levels: dict[str, str], ids=None) -> DataFrame:
        """(sample_id, h, w, data, features): initial fields beside a map of all features of a sample, for training."""
        rows = self.combined(levels).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
        return reader.get_inputs(ids).select("sample_id", "h", "w", "data").join(rows, "sample_id")

    def combined(self, levels: dict[str, str]) -> DataFrame:
        """One matrix of several families, features named family::name, NaN as 0."""
        parts = [
            self.read(family, level).select(
                "sample_id", F.concat_ws("::", F.lit(family), "feature").alias("feature"), F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value")
            )
            for family, level in levels.items()
        ]
        return reduce(DataFrame.unionByName, parts)


def padded(vector: F.Column, size: int) -> F.Column:
    """A vector cut or filled with zeros to a size."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)


def save_stats(stats: DataFrame, path: str, method: str) -> None:
    """Statistics of a normalisation (a row a feature), with the method that they belong to."""
    stats.withColumn("method", F.lit(method)).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str, method: str) -> DataFrame:
    """Such statistics again; those of another method are an error."""
    df = spark.read.parquet(path)
    if not df.where(F.col("method") != method).isEmpty():
        raise ValueError(f"the statistics at {path} aren't those of {method!r}")
    return df.drop("method")


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A report as JSON lines or CSV with a header."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no kind {kind!r}; there are json and csv")
