"""Losses, scores and tests of forecasts on a common sample ``(series_id, date, horizon, model, forecast, y)``.

Every series is scored on its own: lags and bootstrap blocks never run from one series into another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import chi2_two_df, two_sided
from tidemark.params import FORECAST_FLOOR, SEED, TARGET_FLOOR
from tidemark.session import spread_groups

KEYS = ("series_id", "horizon", "model")


def qlike(y: Column, f: Column) -> Column:
    q = y / F.nullif(f, F.lit(0.0))
    return F.when(q > 0, q - F.ln(q) - 1)


def squared_error(y: Column, f: Column) -> Column:
    return (y - f) * (y - f)


def losses(sample: DataFrame) -> DataFrame:
    """The sample with clipped forecasts, their QLIKE (target floored) and squared error (target as it is)."""
    clipped = F.greatest(F.col("forecast"), F.lit(FORECAST_FLOOR))
    df = sample.withColumns({"clipped": F.when(F.col("forecast").isNotNull(), clipped), "was_clipped": F.col("forecast") < FORECAST_FLOOR})
    return df.withColumns({"qlike": qlike(F.greatest(F.col("y"), F.lit(TARGET_FLOOR)), F.col("clipped")), "se": squared_error(F.col("y"), F.col("clipped"))})


def scores(lossed: DataFrame, bench: str = "expanding_mean") -> DataFrame:
    """By series, horizon and model: n, qlike, mse_x1e4, r2 against the benchmark model, clipped forecasts; best first."""
    by = lossed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("qlike").alias("qlike"), (F.avg("se") * 1e4).alias("mse_x1e4"), F.sum("se").alias("_sse"), F.count_if("was_clipped").alias("n_clipped"))
    base = by.where(F.col("model") == bench).select("series_id", "horizon", F.col("_sse").alias("_base"))
    return by.join(base, ["series_id", "horizon"], "left").select(*KEYS, "n", "qlike", "mse_x1e4", (1 - F.col("_sse") / F.nullif("_base", F.lit(0.0))).alias("oos_r2"), "n_clipped").orderBy("series_id", "horizon", "qlike")


def out_of_sample_r2(sample: DataFrame, model: str, bench: str) -> DataFrame:
    """1 - SSE / SSE of the benchmark on the dates both have, forecasts unclipped."""
    wide = sample.where(F.col("model").isin(model, bench)).groupBy("series_id", "date", "horizon").agg(F.max("y").alias("y"), F.max(F.when(F.col("model") == model, F.col("forecast"))).alias("a"), F.max(F.when(F.col("model") == bench, F.col("forecast"))).alias("b")).na.drop()
    return wide.groupBy("series_id", "horizon").agg((1 - F.sum(squared_error(F.col("y"), F.col("a"))) / F.nullif(F.sum(squared_error(F.col("y"), F.col("b"))), F.lit(0.0))).alias("oos_r2"))


def long_run_variance(df: DataFrame, value: str, keys: Sequence[str], lag: int, order: str = "date") -> DataFrame:
    """Newey-West variance by group: ``keys, n, mean, lrv``.

    The deviations' lagged products are summed under one window specification; no group leaves
    the engine. Missing values are left out first. Lags end at n - 1; the variance is at least 1e-300.
    """
    whole = Window.partitionBy(*keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, order, (F.col(value) - F.avg(value).over(whole)).alias("_d"), F.avg(value).over(whole).alias("_mean"))
    w = whole.orderBy(order)
    lagged = d.select(*keys, "_mean", *[(F.col("_d") * (F.lag("_d", k).over(w) if k else F.col("_d"))).alias(f"_g{k}") for k in range(lag + 1)])
    sums = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_mean").alias("mean"), *[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lag + 1)])
    # The weights belong to min(lag, n - 1).
    used = F.least(F.lit(lag), F.col("n") - 1)
    total = reduce(lambda a, b: a + b, [F.when(F.lit(k) <= used, 2 * (1 - F.lit(k) / (used + 1)) * F.col(f"_s{k}")).otherwise(0.0) for k in range(1, lag + 1)], F.col("_s0"))
    return sums.select(*keys, "n", "mean", F.greatest(total / F.col("n"), F.lit(1e-300)).alias("lrv"))


def diebold_mariano(lossed: DataFrame, loss: str, benchmark: str, lag: int = 44, keys: Sequence[str] = KEYS, short: str = "raise") -> DataFrame:
    """Each model against the benchmark: ``series_id, horizon, model, n, mean_diff, stat, p_value``.

    Series with too few days (under 2.5 lags) raise when the plan runs; with ``short="null"`` their statistics are null.
    """
    base = lossed.where(F.col("model") == benchmark).select("series_id", "date", "horizon", F.col(loss).alias("_b"))
    pairs = lossed.where(F.col("model") != benchmark).join(base, ["series_id", "date", "horizon"]).withColumn("_diff", F.col(loss) - F.col("_b"))
    out = long_run_variance(pairs, "_diff", keys, lag)
    few = F.lit(None) if short == "null" else F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" common days are too few for the lag")))
    stat = F.when(F.col("n") >= 10 * lag // 4, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).otherwise(few.cast("double"))
    return out.select(*keys, "n", F.col("mean").alias("mean_diff"), stat.alias("stat")).withColumn("p_value", two_sided(F.col("stat")))


def mincer_zarnowitz(sample: DataFrame, lag: int = 44, keys: Sequence[str] = KEYS, forecast: str = "forecast") -> DataFrame:
    """Regression of the target on the forecast: ``alpha, beta, r2, wald, p_joint`` of alpha = 0 and beta = 1 with autocorrelation-robust covariance."""
    f, y = F.col(forecast), F.col("y")
    d = sample.where(f.isNotNull() & y.isNotNull())
    fit = d.groupBy(*keys).agg(F.regr_slope(y, f).alias("beta"), F.regr_intercept(y, f).alias("alpha"), F.regr_r2(y, f).alias("r2"), F.count(F.lit(1)).alias("n"), F.avg(f).alias("_mf"), F.avg(f * f).alias("_mff"))
    e = d.join(fit.select(*keys, "alpha", "beta"), list(keys)).withColumn("_e", y - F.col("alpha") - F.col("beta") * f)
    w = Window.partitionBy(*keys).orderBy("date")
    e = e.select(*keys, F.col("_e").alias("_u"), (F.col("_e") * f).alias("_v"), *[F.lag("_e", k).over(w).alias(f"_u{k}") for k in range(1, lag + 1)], *[F.lag(F.col("_e") * f, k).over(w).alias(f"_v{k}") for k in range(1, lag + 1)])
    parts = []
    for name, (a, b) in {"uu": ("_u", "_u"), "uv": ("_u", "_v"), "vv": ("_v", "_v")}.items():
        total = F.sum(F.col(a) * F.col(b))
        for k in range(1, lag + 1):
            weight = 1 - k / (lag + 1)
            total = total + weight * F.coalesce(F.sum(F.col(a) * F.col(f"{b}{k}") + F.col(f"{a}{k}") * F.col(b)), F.lit(0.0))
        parts.append(total.alias(f"_{name}"))
    meat = e.groupBy(*keys).agg(*parts)
    both = fit.join(meat, list(keys))
    n, m, q = F.col("n"), F.col("_mf"), F.col("_mff")
    # theta' (X'X) S^-1 (X'X) theta with X'X = n [[1, m], [m, q]]: the Wald statistic without inverting X'X.
    a, b = F.col("alpha"), F.col("beta") - 1
    g1, g2 = n * (a + m * b), n * (m * a + q * b)
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    wald = (F.col("_vv") * g1 * g1 - 2 * F.col("_uv") * g1 * g2 + F.col("_uu") * g2 * g2) / F.nullif(det, F.lit(0.0))
    return both.select(*keys, "n", "alpha", "beta", "r2", wald.alias("wald")).withColumn("p_joint", chi2_two_df(F.col("wald")))


def confidence_set(lossed: DataFrame, loss: str = "qlike", reps: int = 1000, block: int = 44, seed: int = SEED) -> DataFrame:
    """Model confidence set by range statistic and circular block bootstrap: ``series_id, horizon, model, p_value, in_90, in_75``.

    One task for each series and horizon; its days (one row each, the models' losses as an array) are bounded by the calendar.
    """
    days = lossed.groupBy("horizon", "series_id", "date").agg(F.array_sort(F.collect_list(F.struct("model", F.col(loss).alias("loss")))).alias("losses"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        names = [x["model"] for x in pdf["losses"].iloc[0]]
        data = np.array([[x["loss"] for x in row] for row in pdf["losses"]], float)
        n = len(data)
        rng = np.random.default_rng(seed)
        starts = rng.integers(0, n, (reps, -(-n // block)))
        index = ((starts[:, :, None] + np.arange(block)) % n).reshape(reps, -1)[:, :n]
        means = np.stack([data[i].mean(0) for i in index])
        mean = data.mean(0)
        alive, p_values, highest = list(range(len(names))), {}, 0.0
        while len(alive) > 1:
            d = mean[alive][:, None] - mean[alive][None, :]
            drawn = means[:, alive][:, :, None] - means[:, alive][:, None, :] - d
            spread = np.sqrt(np.maximum((drawn**2).mean(0), 1e-300))
            stat = np.abs(d) / spread
            largest = stat.max()
            p = float((np.abs(drawn / spread).reshape(reps, -1).max(1) >= largest).mean())
            highest = max(highest, p)
            worst = alive[int((d / spread).max(1).argmax())]
            p_values[worst] = highest
            alive.remove(worst)
        p_values[alive[0]] = 1.0
        rows = [(pdf["series_id"].iloc[0], int(pdf["horizon"].iloc[0]), names[i], p, p >= 0.10, p >= 0.25) for i, p in p_values.items()]
        return pd.DataFrame(rows, columns=["series_id", "horizon", "model", "p_value", "in_90", "in_75"])

    return spread_groups(days, "series_id", "horizon").groupBy("series_id", "horizon").applyInPandas(run, "series_id string, horizon int, model string, p_value double, in_90 boolean, in_75 boolean")


def score_table(sample: DataFrame, bench: str = "expanding_mean", against: str = "har", lag: int = 44) -> DataFrame:
    """All scores of each model: losses, R2, calibration regression of the clipped forecasts, and test of its QLIKE against a model; best first."""
    lossed = losses(sample)
    base = scores(lossed, bench)
    fit = mincer_zarnowitz(lossed, lag, forecast="clipped").select(*KEYS, F.col("alpha").alias("mz_alpha"), F.col("beta").alias("mz_beta"), F.col("r2").alias("mz_r2"), F.col("p_joint").alias("mz_p"))
    test = diebold_mariano(lossed, "qlike", against, lag, short="null").select(*KEYS, F.col("stat").alias("dm_stat"), F.col("p_value").alias("dm_p"))
    return base.join(fit, list(KEYS), "left").join(test, list(KEYS), "left").orderBy("series_id", "horizon", "qlike")
