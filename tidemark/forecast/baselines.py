"""Forecasts that are projections or windows of the feature table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date
from tidemark.params import HORIZONS


def random_walk(features: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The trailing variance of the same horizon."""
    return features.select("series_id", "date", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit("random_walk").alias("model"), F.col(f"rv_cc_trail_{h}").alias("forecast")) for h in horizons])))


def _flat(df: DataFrame, model: str, value: str, horizons: tuple[int, ...]) -> DataFrame:
    return df.select("series_id", "date", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"), F.lit(model).alias("model"), F.col(value).alias("forecast"))


def implied(features: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return _flat(features, "vix", "iv30", horizons)


def expanding_mean(features: DataFrame, least: int = 252, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Mean of the annualised daily variance through the day, once ``least`` values are there."""
    so_far = by_date().rowsBetween(Window.unboundedPreceding, 0)
    mean = F.when(F.count("dv_cc").over(so_far) >= least, F.avg(F.col("dv_cc") * 252).over(so_far))
    return _flat(features.withColumn("_mean", mean), "expanding_mean", "_mean", horizons)


def ewma(features: DataFrame, decay: float = 0.94, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Recursive mean ``s = decay s + (1 - decay) x`` from the first present value, annualised; a missing value decays the weight of the past only.

    A recursion over each series' days, of bounded number; Arrow moves two columns.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        return pdf[["series_id", "date"]].assign(_ewma=pdf["dv_cc"].astype(float).ewm(alpha=1 - decay, adjust=False).mean() * 252)

    out = features.select("series_id", "date", "dv_cc").groupBy("series_id").applyInPandas(run, "series_id string, date date, _ewma double")
    return _flat(out, "ewma_riskmetrics", "_ewma", horizons)


def union(parts: Iterator[DataFrame] | list[DataFrame]) -> DataFrame:
    """UNION ALL of forecast tables."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_first(panels: list[DataFrame], keys: tuple[str, ...] = ("series_id", "date", "horizon", "model")) -> DataFrame:
    """Union of panels; where several have a key, the earliest panel's row."""
    ranked = union([p.withColumn("_rank", F.lit(i)) for i, p in enumerate(panels)])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    return ranked.withColumn("_first", first).where(F.col("_first") == 1).drop("_rank", "_first")
