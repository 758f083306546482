"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of the input that a file of an intermediate table, and so a task that writes it, should stand for at least.
BYTES_PER_FILE = 2 << 20

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a local one where the master itself is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = tempfile.mkdtemp(prefix="cantata-")
    return "file://" + _OWN_DIRS[key]


def input_bytes(df: DataFrame) -> int:
    """The size of a table as the optimizer knows it without a job: of its files, for one that is read. Very large where it isn't known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; what is left lies in the shared folder
        pass


class Scratch:
    """Tables of one operator call, written as Parquet into the shared folder.

    A table cuts the lineage: a lost executor costs the tasks that ran on it and not the stages before.
    drop() removes a table that no later step reads; the others go when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cantata-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def clear(self) -> None:
        """Deletes all of it, once what was made from its tables has been written."""
        _delete(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, size: int | None = None) -> DataFrame:
        """size: input_bytes() of the table that df is made from; then it is written by no more tasks than one for BYTES_PER_FILE of these, so that small
        inputs don't leave many tiny files."""
        path = self.path(name)
        if size is not None:
            df = df.coalesce(int(min(size // BYTES_PER_FILE + 1, 1 << 30)))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))
