"""Signals, costs, the path-dependent simulation and its metrics.

Tables are long: weights ``(series_id, strategy, date, base_w)``, simulations ``(series_id, strategy, half_spread, date, w, ...)``.
Every series is a market of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import STANDARD
from tidemark.functions.nullsafe import clip, ratio
from tidemark.functions.windows import by_date
from tidemark.params import Backtest
from tidemark.session import spread_groups

KEYS = ("series_id", "strategy")
SIMULATION = "series_id string, strategy string, half_spread double, date date, w double, pnl_gross double, cost double, pnl_net double, unit_pnl double"


def vrp_signal(implied: Column, forecast: Column) -> Column:
    return implied - forecast


def always(signal: Column) -> Column:
    return F.lit(1.0)


def binary(signal: Column) -> Column:
    return F.when(signal > 0, 1.0).when(signal.isNotNull(), 0.0)


def linear_weights(df: DataFrame, signal: str, out: str, least: int = 252, most: float = 1.5) -> DataFrame:
    """signal over the median of its earlier positive values (once ``least`` of them are there), between 0 and ``most``."""
    # As a window a growing median would sort the whole past anew on every day; here each day costs a step in a sorted list.
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "_norm double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        past = pdf[signal].astype(float)
        past = past.where(past > 0).shift(1).expanding(min_periods=least).median()
        return pdf.assign(_norm=pd.array([None if math.isnan(v) else v for v in past], dtype="Float64"))

    normed = spread_groups(df, "series_id").groupBy("series_id").applyInPandas(run, schema)
    return normed.withColumn(out, clip(ratio(F.col(signal), F.col("_norm")), 0.0, most)).drop("_norm")


def spread_cost(vix: Column, half_spread: Column) -> Column:
    """Cost of a unit of notional: what the spread, in volatility points, adds to the variance."""
    s, h = vix / 100, half_spread / 100
    return (s + h) * (s + h) - s * s


def turnover(w: Column, previous: Column, roll_days: int = 22) -> Column:
    return previous / roll_days + F.abs(w - previous)


def unit_pnl(features: DataFrame) -> DataFrame:
    """``series_id, date, carry, m2m, unit_pnl`` of a short unit of variance."""
    before = F.lag("iv30").over(by_date())
    df = features.select("series_id", "date", "vix_close", ((before - 252 * F.col("dv_cc")) / 22).alias("carry"), (-(F.col("iv30") - before) * F.lit(21 / 22)).alias("m2m"))
    return df.withColumn("unit_pnl", F.col("carry") + F.col("m2m"))


def with_scale(weights: DataFrame, units: DataFrame, p: Backtest) -> DataFrame:
    """Weights with unit P&L, vix and volatility scale; the volatility window starts with the strategy's own dates."""
    df = weights.join(units.select("series_id", "date", "unit_pnl", "vix_close"), ["series_id", "date"], "left")
    recent = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(-(p.vol_lookback - 1), 0)
    vol = F.when(F.count("unit_pnl").over(recent) >= 30, F.stddev_samp("unit_pnl").over(recent) * math.sqrt(252))
    # A volatility of zero would be an unbounded scale: the cap.
    return df.withColumn("scale", F.when(vol == 0, F.lit(p.cap)).otherwise(clip(ratio(F.lit(p.vol_target), vol), high=p.cap)))


def simulate(scaled: DataFrame, spreads: Sequence[float], p: Backtest = Backtest()) -> DataFrame:
    """Daily simulation of every strategy at every half spread (parameters, so rows are multiplied by their number without a join).

    Weight, month-to-date result and stop depend on the day before, so each (series, strategy, spread) is a
    fold over its days in one task; all run in parallel.
    """
    table = scaled.withColumn("half_spread", F.explode(F.array(*[F.lit(float(x)) for x in dict.fromkeys(spreads)])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        base, scale, unit = (pdf[c].to_numpy(float) for c in ("base_w", "scale", "unit_pnl"))
        every = pdf["rebalance_every"].to_numpy(int)
        s, h = pdf["vix_close"].to_numpy(float) / 100, pdf["half_spread"].to_numpy(float) / 100
        spread = (s + h) ** 2 - s**2
        months = [(d.year, d.month) for d in pdf["date"]]
        wanted = np.clip(np.where(np.isfinite(base) & np.isfinite(scale), base * scale, 0.0), 0.0, p.cap)
        w, gross, cost = np.zeros(len(pdf)), np.zeros(len(pdf)), np.zeros(len(pdf))
        held, result, month, stopped = 0.0, 0.0, None, False
        for i, m in enumerate(months):
            if m != month:
                month, result, stopped = m, 0.0, False
            if math.isfinite(unit[i]):
                gross[i] = held * unit[i]
            result += gross[i]
            stopped = stopped or result < p.stop
            goal = 0.0 if stopped else wanted[i] if i % every[i] == 0 else held
            if math.isfinite(spread[i]):
                cost[i] = (held / p.roll_days + abs(goal - held)) * spread[i]
            result -= cost[i]
            w[i] = held = goal
        return pd.DataFrame({"series_id": pdf["series_id"], "strategy": pdf["strategy"], "half_spread": pdf["half_spread"], "date": pdf["date"], "w": w, "pnl_gross": gross, "cost": cost, "pnl_net": gross - cost, "unit_pnl": unit})

    keys = (*KEYS, "half_spread")
    return spread_groups(table, *keys).groupBy(*keys).applyInPandas(run, SIMULATION)


def drawdowns(pnl: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, date, equity, drawdown``; the peak starts with the first equity, so a first loss is none."""
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = pnl.where(F.col(value).isNotNull()).select(*keys, "date", F.sum(value).over(so_far).alias("equity"))
    return df.withColumn("drawdown", F.col("equity") - F.max("equity").over(so_far))


def drawdown_episodes(pnl: DataFrame, value: str, keys: tuple[str, ...] = KEYS, top: int = 5) -> DataFrame:
    """The ``top`` deepest islands below the peak by group: start, trough, end (null while open; the day of recovery), depth, days (it included)."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = drawdowns(pnl, value, keys).withColumn("_under", F.col("drawdown") < 0)
    d = d.withColumn("_island", F.sum((~F.col("_under")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("date").over(w))
    e = d.where("_under").groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.min(F.struct("drawdown", "date"))["date"].alias("trough"), F.max(F.struct("date", "_next"))["_next"].alias("end"), F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("_n"))
    e = e.withColumn("days", F.col("_n") + F.col("end").isNotNull().cast("int"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "start"))
    return e.withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "rank", "start", "trough", "end", "depth", "days")


def performance(pnl: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ann_return, ann_vol, sharpe, max_dd, skew, kurtosis, var and cvar at 95 and 99 %, hit_rate by group."""
    x = F.col(value)
    d = pnl.where(x.isNotNull())
    cut = d.groupBy(*keys).agg(F.percentile(x, F.lit(0.05)).alias("var95"), F.percentile(x, F.lit(0.01)).alias("var99"))
    base = d.join(cut, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(x) * 252).alias("ann_return"), (F.stddev_samp(x) * math.sqrt(252)).alias("ann_vol"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"),
        F.first("var95").alias("var95"), F.avg(F.when(x <= F.col("var95"), x)).alias("cvar95"), F.first("var99").alias("var99"), F.avg(F.when(x <= F.col("var99"), x)).alias("cvar99"), F.avg((x > 0).cast("int")).alias("hit_rate"),
    )
    worst = drawdowns(d, value, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_dd"))
    out = base.withColumn("sharpe", F.col("ann_return") / F.nullif("ann_vol", F.lit(0.0))).join(worst, list(keys))
    return out.select(*keys, "n", "ann_return", "ann_vol", "sharpe", "max_dd", "skew", "kurtosis", "var95", "cvar95", "var99", "cvar99", "hit_rate")


def breakeven(simulations: DataFrame) -> DataFrame:
    """By series and strategy the first spread of the grid at which the net Sharpe ratio is not positive, null if none."""
    by = simulations.groupBy(*KEYS, "half_spread").agg((F.avg("pnl_net") / F.nullif(F.stddev_samp("pnl_net"), F.lit(0.0)) * math.sqrt(252)).alias("sharpe"))
    return by.groupBy(*KEYS).agg(F.min(F.when(F.col("sharpe") <= 0, F.col("half_spread"))).alias("breakeven"))


def event_windows(pnl: DataFrame, events: Sequence[tuple[str, str, str]], value: str) -> DataFrame:
    """Running result inside each closed event window ``(event, first day, last day)``; windows are parameters, so no join is needed."""
    windows = [F.when(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), F.lit(name)) for name, first, last in events]
    d = pnl.withColumn("event", F.explode(F.array_compact(F.array(*windows))))
    so_far = Window.partitionBy("event", *KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("event", *KEYS, "date", F.sum(F.coalesce(value, F.lit(0.0))).over(so_far).alias("cumulative"))


def sharpe_moments(pnl: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    x = F.col(value)
    return pnl.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("sr"), F.skewness(x).alias("g3"), (F.kurtosis(x) + 3).alias("g4"))


def deflated(n: int, sr: float, g3: float, g4: float, trials: int) -> tuple[float, float, float]:
    """(annual Sharpe ratio, probability that it beats the best of so many trials without skill, annual benchmark)."""
    shape = 1 - g3 * sr + (g4 - 1) / 4 * sr * sr
    spread = math.sqrt(max(shape / (n - 1), 1e-12))
    trials = max(trials, 2)
    euler = 0.5772156649015329
    best = spread * ((1 - euler) * STANDARD.inv_cdf(1 - 1 / trials) + euler * STANDARD.inv_cdf(1 - 1 / (trials * math.e)))
    return sr * math.sqrt(252), STANDARD.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(shape)), best * math.sqrt(252)


def deflated_sharpe(pnl: DataFrame, value: str, trials: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, sharpe_ann, dsr, benchmark_ann, trials``."""
    moments = sharpe_moments(pnl, value, keys)

    @F.pandas_udf("sharpe_ann double, dsr double, benchmark_ann double")
    def judge(n: pd.Series, sr: pd.Series, g3: pd.Series, g4: pd.Series) -> pd.DataFrame:
        rows = [deflated(int(a), b, c, d, trials) if a > 1 and np.isfinite([b, c, d]).all() else (None,) * 3 for a, b, c, d in zip(n, sr, g3, g4)]
        return pd.DataFrame(rows, columns=["sharpe_ann", "dsr", "benchmark_ann"], dtype=float)

    return moments.withColumn("_r", judge("n", "sr", "g3", "g4")).select(*keys, "_r.*", F.lit(trials).alias("trials"))


def strategy_weights(features: DataFrame, panel: DataFrame, physical: str = "gjr_n", robust: str = "har_log_iv") -> DataFrame:
    """``series_id, date, strategy, base_w, rebalance_every`` of the eight standard strategies over the panel's dates: always short, and
    short by the premium over the trailing variance, a physical model or a robust one, some of them traded weekly."""
    wide = panel.groupBy("series_id", "date").agg(*[F.max(F.when(F.col("model") == m, F.col("forecast"))).alias(k) for k, m in (("_p", physical), ("_r", robust))])
    df = wide.join(features.select("series_id", "date", "iv30", "rv_cc_trail_22"), ["series_id", "date"])
    df = df.withColumns({"s_model": vrp_signal(F.col("iv30"), F.col("_p")), "s_robust": vrp_signal(F.col("iv30"), F.col("_r")), "s_naive": vrp_signal(F.col("iv30"), F.col("rv_cc_trail_22"))})
    df = linear_weights(df, "s_model", "linear")
    flat, model = always(F.col("s_model")), binary(F.col("s_model"))
    cells = [("always_short", flat, 1), ("always_short_5d", flat, 5), ("naive_binary", binary(F.col("s_naive")), 1), ("model_binary", model, 1), ("model_binary_5d", model, 5), ("model_linear", F.col("linear"), 1), ("model_linear_5d", F.col("linear"), 5), ("robust_binary", binary(F.col("s_robust")), 1)]
    return df.select("series_id", "date", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), w.alias("base_w"), F.lit(k).alias("rebalance_every")) for n, w, k in cells])))


def performance_table(simulations: DataFrame) -> DataFrame:
    """Gross and net figures, average weight and yearly cost by series, strategy and spread."""
    keys = (*KEYS, "half_spread")
    gross = performance(simulations, "pnl_gross", keys).select(*keys, F.col("ann_return").alias("gross_ann_return"), F.col("sharpe").alias("gross_sharpe"))
    net = performance(simulations, "pnl_net", keys).select(*keys, F.col("ann_return").alias("net_ann_return"), F.col("sharpe").alias("net_sharpe"), F.col("max_dd").alias("net_max_dd"), F.col("skew").alias("net_skew"), F.col("cvar99").alias("net_cvar99"))
    use = simulations.groupBy(*keys).agg(F.avg("w").alias("avg_weight"), (F.avg("cost") * 252).alias("ann_cost"))
    return gross.join(net, list(keys)).join(use, list(keys))


def net_edge(simulations: DataFrame, bench: str, lag: int = 22) -> DataFrame:
    """Each strategy's daily net result less that of ``bench``: ``series_id, strategy, n, mean_daily_diff, ann_diff, t_stat, p_value``, robust to autocorrelation."""
    from tidemark.evaluate.scores import diebold_mariano

    rows = simulations.select("series_id", "date", F.lit(0).alias("horizon"), F.col("strategy").alias("model"), F.col("pnl_net"))
    out = diebold_mariano(rows, "pnl_net", bench, lag)
    return out.select("series_id", F.col("model").alias("strategy"), "n", F.col("mean_diff").alias("mean_daily_diff"), (F.col("mean_diff") * 252).alias("ann_diff"), F.col("stat").alias("t_stat"), "p_value")
