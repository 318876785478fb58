"""Written checkpoints of intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Tables that lazily evaluated results read: they go when the application ends.
_KEPT: list[str] = []


@atexit.register
def _clear() -> None:
    jvm = SparkContext._jvm
    while jvm is not None and _KEPT:
        try:
            path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # the application is over; its JVM may be gone already
            return


def kept(path: str) -> str:
    """path, to be removed when the application ends."""
    _KEPT.append(path)
    return path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (tests) uses a folder of its own, and a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors.

    The table lasts as long as the application, for the result is read when a caller likes.
    """
    return _written(df, kept(shared_dir(df.sparkSession, name)), codec)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one run below one shared folder, which goes when the with block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_dir(spark, name), 0

    def stored(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.count += 1
        return _written(df, f"{self.path}/{self.count:04d}-{name}", codec)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)
