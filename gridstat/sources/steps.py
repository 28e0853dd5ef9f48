"""Tables of iterative jobs: a Parquet table a step in a shared folder, so that a job goes on from its last whole step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session of one machine without it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Files:
    """What has to be asked of a folder's file system, whichever it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm = folder.rstrip("/"), spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def publish(self, name: str, text: str) -> None:
        """Write a small file so that it is there whole or not at all: under another name first, then renamed. A name that is taken is an error."""
        if self.exists(name):
            raise FileExistsError(f"{self.folder}/{name}")
        head, _, tail = name.rpartition("/")
        draft = f"{head}/_{uuid.uuid4().hex}-{tail}" if head else f"_{uuid.uuid4().hex}-{tail}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if not self._fs.rename(self._path(draft), self._path(name)):
            self.delete(draft)
            raise FileExistsError(f"{self.folder}/{name}")


class Steps:
    """Steps 0, 1, ... of a job. A step counts once its table is whole; what a lost driver left half written is written anew."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}").rstrip("/")
        self.files = Files(spark, self.folder)

    def whole(self, n: int) -> bool:
        return self.files.exists(f"step-{n:06d}/_SUCCESS")

    def last(self) -> int:
        """The last whole step; -1 without one."""
        whole = [int(name[5:]) for name in self.files.names() if name.startswith("step-") and self.whole(int(name[5:]))]
        return max(whole, default=-1)

    def write(self, n: int, df: DataFrame) -> DataFrame:
        """Write a step, unless it is there, and read it: later steps plan from the files alone."""
        if not self.whole(n):
            df.write.mode("overwrite").parquet(f"{self.folder}/step-{n:06d}")
        return self.read(n)

    def read(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/step-{n:06d}")

    def keep_only(self, n: int) -> None:
        """Delete what lies before a step."""
        for i in range(n):
            self.files.delete(f"step-{i:06d}")
