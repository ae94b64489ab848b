"""The data behind the usual figures; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def implied_and_realised(features: DataFrame) -> DataFrame:
    """Implied volatility and that realised over the next 22 days, in points."""
    d = features.where(F.col("iv30").isNotNull() & F.col("target_rv_22").isNotNull())
    return d.select("series_id", "date", "vix_close", (F.sqrt("target_rv_22") * 100).alias("realised_points"))


def premium_histogram(features: DataFrame, bins: int = 80, tail: float = 0.005) -> DataFrame:
    """``bin, low, high, days`` of the premium, winsorised at both tails. Empty bins are absent; the last includes its upper end."""
    d = features.where(F.col("vrp_expost").isNotNull()).select("vrp_expost")
    ends = d.agg(F.percentile("vrp_expost", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    ends = ends.select(F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    x = F.least(F.greatest(F.col("vrp_expost"), F.col("_low")), F.col("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    # One row of limits for all.
    placed = d.join(F.broadcast(ends)).withColumn("bin", F.when(width > 0, F.least(F.floor((x - F.col("_low")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
    out = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("days"), F.first("_low").alias("_low"), F.first(width).alias("_w"))
    return out.select("bin", (F.col("_low") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_low") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "days")


def forecasts_beside_targets(sample: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Target and chosen forecasts side by side."""
    return sample.where(F.col("model").isin(*models)).groupBy("series_id", "date", "horizon").pivot("model", list(models)).agg(F.max("forecast")).join(sample.select("series_id", "date", "horizon", "y").distinct(), ["series_id", "date", "horizon"])


def aggregation_ratio(panel: DataFrame, model: str, horizon: int = 22) -> DataFrame:
    """How far the summed variance path lies from the one-day forecast held flat, in percent."""
    by = panel.where(F.col("model") == model).groupBy("series_id", "date").agg(F.max(F.when(F.col("horizon") == horizon, F.col("forecast"))).alias("whole"), F.max(F.when(F.col("horizon") == 1, F.col("forecast"))).alias("flat")).na.drop()
    return by.select("series_id", "date", ((F.col("whole") / F.nullif("flat", F.lit(0.0)) - 1) * 100).alias("ratio_percent"))


def equity_curves(simulations: DataFrame, value: str = "pnl_net") -> DataFrame:
    so_far = Window.partitionBy("series_id", "strategy", "half_spread").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return simulations.select("series_id", "strategy", "half_spread", "date", F.sum(F.coalesce(value, F.lit(0.0))).over(so_far).alias("equity"))


def spread_curve(simulations: DataFrame) -> DataFrame:
    """Net Sharpe ratio of each strategy at each spread."""
    return simulations.groupBy("series_id", "strategy", "half_spread").agg((F.avg("pnl_net") / F.nullif(F.stddev_samp("pnl_net"), F.lit(0.0)) * (252**0.5)).alias("sharpe"))
