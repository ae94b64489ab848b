"""Evaluation indexes with an information barrier, common samples and the holdout guard.

Forecasts are long tables ``(series_id, date, horizon, model, forecast)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.params import Protocol


class HoldoutViolation(RuntimeError):
    """A development step was handed holdout dates."""


def positions(features: DataFrame) -> DataFrame:
    """``pos``, the row's place in its series from zero, and ``n_pos``, the series' length."""
    whole = Window.partitionBy("series_id")
    return features.withColumns({"pos": F.row_number().over(whole.orderBy("date")) - 1, "n_pos": F.count(F.lit(1)).over(whole)})


def dev_rows(features: DataFrame, horizon: int, protocol: Protocol) -> DataFrame:
    """Evaluation rows whose whole target window lies in the development period; ``ordinal`` counts them from zero."""
    numbered = positions(features)
    end = F.max(F.when(F.col("date") <= F.lit(protocol.dev_end).cast("date"), F.col("pos"))).over(Window.partitionBy("series_id"))
    rows = numbered.withColumn("_end", end).where((F.col("date") >= F.lit(protocol.eval_start).cast("date")) & (F.col("pos") <= F.col("_end") - horizon)).drop("_end")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("series_id").orderBy("date")) - 1)


def holdout_rows(features: DataFrame, horizon: int, protocol: Protocol) -> DataFrame:
    """Rows after the development period whose targets are observed."""
    rows = positions(features).where((F.col("date") > F.lit(protocol.dev_end).cast("date")) & (F.col("pos") <= F.col("n_pos") - 1 - horizon))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("series_id").orderBy("date")) - 1)


def after_dev(df: DataFrame, protocol: Protocol) -> DataFrame:
    """The rows of the holdout."""
    return df.where(F.col("date") > F.lit(protocol.dev_end).cast("date"))


def holdout_guard(rows: DataFrame, protocol: Protocol) -> None:
    last = rows.agg(F.max("date").cast("string").alias("d")).first()["d"]
    if last is not None and last > protocol.dev_end:
        raise HoldoutViolation(f"evaluation rows reach {last}; development ends {protocol.dev_end}")


def guarded(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """Development rows, after the guard has let them pass."""
    holdout_guard(rows, protocol)
    return rows


def common_sample(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """Forecasts with their target ``y``, on the dates on which the target and every model are there."""
    models = panel.select("horizon", "model").distinct().groupBy("horizon").agg(F.count(F.lit(1)).alias("_models"))
    joined = panel.where(F.col("forecast").isNotNull()).join(targets.where(F.col("y").isNotNull()), ["series_id", "date", "horizon"])
    # Few rows: as many as there are horizons.
    joined = joined.join(F.broadcast(models), "horizon").withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy("series_id", "date", "horizon")))
    return joined.where(F.col("_have") == F.col("_models")).drop("_have", "_models")


def targets(features: DataFrame, horizons: tuple[int, ...] = (1, 5, 22)) -> DataFrame:
    return features.select("series_id", "date", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_rv_{h}").alias("y")) for h in horizons])))
