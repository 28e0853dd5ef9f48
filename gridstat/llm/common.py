"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handled at a time inside an Arrow batch: bounds what a task holds besides the batch.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. The path may be of any file system that Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the split between learning and held-out rows."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def hash_share(key: Column, share: float) -> Column:
    """True for about `share` of the keys, always the same ones, however small the share."""
    return below_share(F.xxhash64(key), F.lit(float(share)))


def below_share(h: Column, share: Column) -> Column:
    """Whether a 64-bit hash lies in the lowest `share` of its range."""
    return (h.cast("double") + 2.0**63) < share * 2.0**64


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def map_arrow(
    df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """Apply a function to small record batches, row-local and without a shuffle.

    `fn` is called once a task and returns the function of a batch, so what a
    task prepares (tables of a model, caches) is prepared once.
    """
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_what_others_keep(owner)
        one = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                made = one(batch.slice(at, SLICE_ROWS))
                if made is not None and made.num_rows:
                    yield made

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if c.type != f.type else c for c, f in zip(made.columns, arrow, strict=True)],
                schema=arrow,
            )

    small_batches(df.sparkSession)
    return df.mapInArrow(typed, out)


def _drop_what_others_keep(owner: str) -> None:
    """A worker process keeps the tables and caches of one operator at a time: those of the task that it works on."""
    for name in ("bpe", "decontaminate", "token_counts"):
        module = sys.modules.get(f"{__package__}.{name}")
        if module is not None and module.__name__ != owner:
            module.drop_kept()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch: texts may be long, and a batch is held whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a local session without one, a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and reread it.

    Cuts the lineage, survives lost executors and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
