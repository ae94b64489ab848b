"""Bars and implied volatilities from tables that hold neither, with long daily histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import build_features, clean, first_per_day, joint_calendar
from tidemark.params import Protocol
from tidemark.session import table

#: Dates of the protocol on the adapted tables, which end in 2001.
PROTOCOL = Protocol(eval_start="1998-01-01", dev_end="1999-12-31")


def asset_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday bars of lineitem prices by ship date; first and last by the full row key, so ties cannot occur."""
    rows = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"), (1000 + F.col("l_extendedprice") / 3000).alias("p"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k")).where(F.weekday("date") < 5)
    bars = rows.groupBy("date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"))
    return bars.select(F.lit("asset").alias("series_id"), "*")


def asset_volatility(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    # Whole cents, so the sum does not depend on its order; a prime divisor, so rounding never meets a tie.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    v = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg((10 + cents / (F.count("o_totalprice") * 1999993.0)).alias("close"))
    return v.select(F.lit("asset").alias("series_id"), "*")


def asset_features(spark: SparkSession, folder: str) -> DataFrame:
    return build_features(joint_calendar(asset_bars(spark, folder), asset_volatility(spark, folder)))


def series_bars(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One cleaned bar for each series and day of a bar table."""
    bars = table(spark, folder, name).select("series_id", "date", "bar_id", "open", "high", "low", "close")
    return clean(first_per_day(bars.where(F.col("date").isNotNull()), "bar_id")).drop("bar_id")


def series_features(spark: SparkSession, folder: str) -> DataFrame:
    return build_features(joint_calendar(series_bars(spark, folder, "gspc"), series_bars(spark, folder, "vix")))
