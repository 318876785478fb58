"""What the operators share: input tables, written intermediate tables, free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.sources.storage import Scratch, remove, shared_dir
from strandloom.sources.storage import checkpointed as stored

__all__ = ["Scratch", "free_names", "remove", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; only Spark opens the path, so it may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (case is ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
