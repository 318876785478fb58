"""Exact order statistics without gathering a group's values: selection by radix histograms.

A double is a 64-bit number that sorts as the double does. Equal values are counted first, before and after the
shuffle. Each round then counts, by group and wanted rank, the next BITS bits of the values that share the bits found so
far, and goes down into the bin that holds the rank; after 64 / BITS rounds the bits are the value. What a group needs
in a round is a histogram of at most 2**BITS counts a rank, which tasks and executors add up, whatever the group's size.

NaN is above all numbers, as elsewhere in Spark; nulls do not count; -0.0 is 0.0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from strandloom.operators.scans import Keep, written

BITS = 16


@F.pandas_udf(LongType())
def sortable(x: pd.Series) -> pd.Series:
    """64-bit integers in the order of the doubles."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def unsorted(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def select(df: DataFrame, keys: list[str], value: str, ranks: Column, keep: Keep = written) -> DataFrame:
    """keys, n, rank, x: the values at the ranks (an array of longs from 0, made of n, the group's count) of each group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    rows = keep(counts.select(*keys, sortable("__x").alias("__b"), "__c"))
    # What is wanted: the bits above those still to be found, and the rank among the values that have them.
    want = rows.groupBy(*keys).agg(F.sum("__c").alias("n")).select(*keys, "n", F.explode(F.array_distinct(ranks)).alias("rank"))
    want = want.filter("rank BETWEEN 0 AND n - 1").withColumn("__top", F.lit(None).cast("long")).withColumn("__left", F.col("rank"))
    same = lambda a, b, c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    for low in range(64 - BITS, -1, -BITS):
        above = F.shiftright("__b", low + BITS) if low + BITS < 64 else F.lit(None).cast("long")
        bins = rows.groupBy(*keys, above.alias("__top"), F.shiftright("__b", low).alias("__bin")).agg(F.sum("__c").alias("__c"))
        met = want.alias("w").join(bins.alias("b"), _all([same("w", "b", c) for c in [*keys, "__top"]]))
        met = met.select(*(F.col(f"w.{c}").alias(c) for c in [*keys, "n", "rank", "__left"]), F.col("b.__bin").alias("__bin"), F.col("b.__c").alias("__c"))
        run = F.sum("__c").over(W.partitionBy(*keys, "rank").orderBy("__bin"))  # at most 2**BITS bins
        found = met.withColumn("__run", run).filter((F.col("__run") > F.col("__left")) & (F.col("__run") - F.col("__c") <= F.col("__left")))
        want = found.select(*keys, "n", "rank", F.col("__bin").alias("__top"), (F.col("__left") - F.col("__run") + F.col("__c")).alias("__left"))
    return want.select(*keys, "n", "rank", unsorted("__top").alias("x"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, keep: Keep = written, **fractions: float) -> DataFrame:
    """keys, n and, by name, the quantile of each fraction, interpolated between the two values beside it; groups without
    values have no row."""
    place = lambda f: F.lit(f) * (F.col("n") - 1)
    ranks = F.array(*(g(place(f)).cast("long") for f in fractions.values() for g in (F.floor, F.ceil)))
    got = select(df, keys, value, ranks, keep)

    def between(f: float) -> Column:
        low, high = (F.max(F.when(F.col("rank") == g(place(f)).cast("long"), F.col("x"))) for g in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * F.max(place(f) - F.floor(place(f))))  # infinities stay

    return got.groupBy(*keys, "n").agg(*(between(f).alias(name) for name, f in fractions.items()))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str, keep: Keep = written) -> DataFrame:
    """keys and the value at place n div 2 of each group."""
    return select(df, keys, value, F.array(F.floor(F.col("n") / 2).cast("long")), keep).select(*keys, F.col("x").alias(name))


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of other's row of the same keys, nulls being keys like others."""
    named = other.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return df.join(named, _all([df[k].eqNullSafe(named[f"__{k}"]) for k in keys]), "left").drop(*(f"__{k}" for k in keys))
