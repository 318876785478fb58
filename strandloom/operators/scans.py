"""Running results of a key without one task a key: a range-partitioned scan in two passes.

Rows are dealt in order of their keys and of the order into ranges of about equal size, so that a key with most of the
rows fills many ranges. A first pass sums each key's part of a range up; what the ranges before give (the carry) is a
window over these sums, a row a key and range. A second pass runs inside the ranges and adds the carry.

The layout must not change between the passes, so it is written: keep(df) writes df to storage that outlives an
executor and returns what is read again. Nulls are keys like others; a key's order may have ties and nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.sources.storage import checkpointed

RANGE = "__range"
Keep = Callable[[DataFrame], DataFrame]


def written(df: DataFrame) -> DataFrame:
    """A table of the shared folder that goes when the application ends."""
    return checkpointed(df, "scan")


def dealt(df: DataFrame, keys: list[str], order: list[str], keep: Keep = written) -> DataFrame:
    """df with the number of each row's range; ranges follow keys and order."""
    return keep(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()))


def inside(keys: list[str], order: list[str]):
    """The window of a key's rows in a range, up to the row itself."""
    return W.partitionBy(*keys, RANGE).orderBy(*order)


def carried(df: DataFrame, keys: list[str], **of: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """df with, by name, what a fold (second) makes of the sums (first) of the key's ranges before: null in its first."""
    sums = df.groupBy(*keys, RANGE).agg(*(first.alias(name) for name, (first, _) in of.items()))
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"__k{i}" for i, k in enumerate([*keys, RANGE])}
    sums = sums.select(*(F.col(k).alias(n) for k, n in names.items()), *(fold(F.col(name)).over(before).alias(name) for name, (_, fold) in of.items()))
    same = [df[k].eqNullSafe(sums[n]) for k, n in names.items()]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(sums, on, "left").drop(*names.values())


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, keep: Keep = written) -> DataFrame:
    """df with each row's place in its key's order, from 0."""
    rows = dealt(df, keys, order, keep).withColumn("__own", F.row_number().over(inside(keys, order)) - 1)
    out = carried(rows, keys, __before=(F.count("*"), F.sum))
    return out.withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__own", "__before", RANGE)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, keep: Keep = written) -> DataFrame:
    """df with the sum of value over the key's rows up to each, itself included."""
    rows = dealt(df.withColumn("__value", value), keys, order, keep)
    up_to = inside(keys, order).rowsBetween(W.unboundedPreceding, 0)
    out = carried(rows, keys, __before=(F.sum("__value"), F.sum))
    return out.withColumn(name, F.sum("__value").over(up_to) + F.coalesce("__before", F.lit(0))).drop("__value", "__before", RANGE)


def last_largest(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, keep: Keep = written) -> DataFrame:
    """df with the last value that is not null of the key's rows up to each; value must not fall along the order."""
    rows = dealt(df, keys, order, keep)
    up_to = inside(keys, order).rowsBetween(W.unboundedPreceding, 0)
    out = carried(rows, keys, __before=(F.max(value), F.max))
    return out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(up_to), "__before")).drop("__before", RANGE)


def gap_groups(df: DataFrame, keys: list[str], at: Column, gap: int, ties: list[str], keep: Keep = written) -> DataFrame:
    """df with group_no: rows of a key whose place is more than gap behind the one before begin a group."""
    order = ["__at", *ties]
    rows = carried(dealt(df.withColumn("__at", at), keys, order, keep), keys, __before=(F.max("__at"), F.max))
    one = inside(keys, order)
    last = F.coalesce(F.lag("__at").over(one), "__before")
    # Ranges stay as they are, so their counts of groups need no new deal.
    flagged = keep(rows.withColumn("__new", F.coalesce((F.col("__at") - last > gap).cast("int"), F.lit(1))).drop("__before"))
    out = carried(flagged, keys, __before=(F.sum("__new"), F.sum))
    return out.withColumn("group_no", F.sum("__new").over(one.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("__before", F.lit(0))).drop("__at", "__new", "__before", RANGE)
