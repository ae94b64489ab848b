"""Exact quantiles of counted values, without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column) -> Column:
    """A number that never falls as a finite ``x`` rises: sign, exponent and a 128th of the octave."""
    size = F.abs(x)
    octave = F.when(size > 0, F.greatest(F.floor(F.log2(size)), F.lit(-1000))).cast("long")
    part = F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), octave.cast("double")) - 1.0) * 128), F.lit(0)), F.lit(127)).cast("long")
    code = (octave + 1001) * 128 + part
    return F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0).cast("long"))


def counted_medians(counts: DataFrame, keys: Sequence[str], value: str, times: str, alias: str = "median") -> DataFrame:
    """The exact median of ``value`` for each group, each row standing for ``times`` equal values.

    One row for each group that has a finite value: ``keys, alias``. Even groups give the mean of
    the two middle values. Groups are cut into buckets of nearly equal values; running totals over
    the (few) buckets find those that hold the middle, and only their distinct values are ordered.
    Null, NaN and infinite values do not count. Null keys form groups.
    """
    x = F.col(value).cast("double")
    rows = counts.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(*keys, x.alias("_x"), F.col(times).alias("_n")).withColumn("_b", _bucket(F.col("_x")))
    buckets = rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy(*keys)
    buckets = buckets.withColumn("_upto", F.sum("_in").over(whole.orderBy("_b"))).withColumn("_all", F.sum("_in").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = buckets.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_in") < high)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_mb"), (F.col("_upto") - F.col("_in")).alias("_before"), low.alias("_low"), high.alias("_high"))
    match = F.col("_b") == F.col("_mb")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = rows.join(middle, match)
    near = near.groupBy(*keys, "_b", "_x").agg(F.sum("_n").alias("_n"), F.first("_before").alias("_before"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_x"))
    near = near.withColumn("_upto", upto)
    holds = lambda rank: (F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_n") < F.col(rank))
    return near.groupBy(*keys).agg(((F.max(F.when(holds("_low"), F.col("_x"))) + F.max(F.when(holds("_high"), F.col("_x")))) / 2).alias(alias))
