"""Register of the configurations that were tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import read_or_empty

KEYS = ("phase", "model", "horizon", "params", "eval_window")
SCHEMA = "phase string, model string, horizon int, params string, eval_window string, first_logged_utc timestamp"


def new_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct entries that are not in the register yet."""
    return entries.select(*KEYS).distinct().join(known.select(*KEYS), list(KEYS), "left_anti").withColumn("first_logged_utc", F.current_timestamp())


def log_configs(spark: SparkSession, path: str, entries: DataFrame) -> int:
    """Append what is new; the number of distinct configurations afterwards."""
    new_entries(entries, read_or_empty(spark, path, SCHEMA)).write.mode("append").parquet(path)
    return total_configs(spark, path)


def total_configs(spark: SparkSession, path: str) -> int:
    return read_or_empty(spark, path, SCHEMA).select(*KEYS).distinct().count()
