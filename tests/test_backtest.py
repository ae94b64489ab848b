import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.backtest import strategies as B


def market(spark, n=120, shock=None):
    rng = np.random.default_rng(23)
    dates = [x.date() for x in pd.bdate_range("2020-01-01", periods=n)]
    dv = rng.uniform(2e-5, 3e-4, n)
    if shock is not None:
        dv[shock] = 0.02
    vix = 15 + 8 * rng.uniform(size=n)
    df = spark.createDataFrame([("s", d, float(a), float(v), float((v / 100) ** 2)) for d, a, v in zip(dates, dv, vix)], "series_id string, date date, dv_cc double, vix_close double, iv30 double")
    return df, dates, dv, vix


def run(spark, df, weights, p=B.Backtest(), every=1, spread=0.5):
    table = spark.createDataFrame([("s", "x", d, w, every) for d, w in weights], "series_id string, strategy string, date date, base_w double, rebalance_every int")
    scaled = B.with_scale(table, B.unit_pnl(df), p)
    return B.simulate(scaled, [spread], p).orderBy("date").toPandas()


def test_costs_and_turnover(spark):
    r = spark.range(1).select(B.spread_cost(F.lit(20.0), F.lit(1.0)).alias("c"), B.turnover(F.lit(1.0), F.lit(0.0)).alias("a"), B.turnover(F.lit(1.0), F.lit(1.0)).alias("b"), B.turnover(F.lit(0.5), F.lit(1.0)).alias("d")).first()
    assert (r["c"], r["a"], r["b"], r["d"]) == pytest.approx((0.0041, 1, 1 / 22, 1 / 22 + 0.5))


def test_simulation_matches_a_plain_loop(spark):
    df, dates, dv, vix = market(spark, 200, shock=150)
    rng = np.random.default_rng(3)
    base = [None if i % 17 == 0 else float(rng.uniform(-0.2, 1.5)) for i in range(200)]
    p = B.Backtest(stop=-0.01)
    got = run(spark, df, list(zip(dates, base)), p, every=3)
    iv = (vix / 100) ** 2
    unit = np.r_[np.nan, (iv[:-1] - 252 * dv[1:]) / 22 - 21 / 22 * np.diff(iv)]
    vol = pd.Series(unit).rolling(66, min_periods=30).std() * math.sqrt(252)
    w, mtd, month, stopped, stops = 0.0, 0.0, None, None, 0
    for i, d in enumerate(dates):
        if (d.year, d.month) != month:
            month, mtd = (d.year, d.month), 0.0
        gross = w * unit[i] if np.isfinite(unit[i]) else 0.0
        mtd += gross
        if mtd < p.stop:
            stopped = month
        scale = min(p.vol_target / vol[i], p.cap)
        goal = 0.0 if stopped == month else w if i % 3 else min(max(base[i] * scale, 0), p.cap) if base[i] is not None and np.isfinite(scale) else 0.0
        cost = (w / 22 + abs(goal - w)) * ((vix[i] / 100 + 0.005) ** 2 - (vix[i] / 100) ** 2)
        mtd -= cost
        stops += stopped == month
        w = goal
        assert (got.w[i], got.pnl_gross[i], got.cost[i]) == pytest.approx((w, gross, cost), abs=1e-12)
    assert stops > 0 and (got.w > 0).any()


def test_weight_earns_from_the_next_day_on(spark):
    df, dates, *_ = market(spark, 100)
    got = run(spark, df, [(d, 1.0 if i == 50 else 0.0) for i, d in enumerate(dates)])
    assert got.w[50] > 0 and got.pnl_gross[50] == 0 and got.pnl_gross[51] != 0 and (got.pnl_gross[52:] == 0).all()


def test_linear_weights_use_earlier_positive_signals_only(spark):
    dates = [x.date() for x in pd.bdate_range("2018-01-01", periods=300)]
    rng = np.random.default_rng(4)
    s = rng.normal(0.5, 1, 300)
    df = spark.createDataFrame([("s", d, float(x)) for d, x in zip(dates, s)], "series_id string, date date, sig double")
    got = B.linear_weights(df, "sig", "w", least=100).orderBy("date").toPandas().w
    for i in (120, 250):
        past = [x for x in s[:i] if x > 0]
        want = None if len(past) < 100 else min(max(s[i] / np.median(past), 0), 1.5)
        assert (math.isnan(got[i]) and want is None) or got[i] == pytest.approx(want)


def test_metrics_and_drawdowns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.001, 0.006, 1000)
    dates = [d.date() for d in pd.bdate_range("2015-01-01", periods=1000)]
    pnl = spark.createDataFrame([("s", "a", d, float(v)) for d, v in zip(dates, x)], "series_id string, strategy string, date date, p double")
    r = B.performance(pnl, "p").first()
    equity = np.cumsum(x)
    dd = equity - np.maximum.accumulate(equity)
    q = np.quantile(x, 0.05)
    z = (x - x.mean()) / x.std()
    assert (r["sharpe"], r["max_dd"], r["var95"], r["cvar95"], r["skew"], r["kurtosis"], r["hit_rate"]) == pytest.approx((x.mean() / x.std(ddof=1) * math.sqrt(252), dd.min(), q, x[x <= q].mean(), (z**3).mean(), (z**4).mean(), (x > 0).mean()))
    e = B.drawdown_episodes(pnl, "p", top=3).orderBy("rank").collect()
    assert len(e) == 3 and e[0]["depth"] == pytest.approx(dd.min()) and e[0]["trough"] == dates[int(dd.argmin())]
    if e[0]["end"]:
        i, j = dates.index(e[0]["start"]), dates.index(e[0]["end"])
        assert e[0]["days"] == j - i + 1 and dd[j] == 0 and (dd[i:j] < 0).all()
    small = spark.createDataFrame([("s", "a", dates[i], v) for i, v in enumerate((-1.0, 2.0, -0.5, -0.25))], "series_id string, strategy string, date date, p double")
    only = B.drawdown_episodes(small, "p").collect()
    assert [(r["start"], r["trough"], r["end"], r["depth"], r["days"]) for r in only] == [(dates[2], dates[3], None, -0.75, 2)]


def test_deflated_sharpe_falls_with_trials(spark):
    a, b = B.deflated(1000, 0.05, -0.5, 5.0, 2), B.deflated(1000, 0.05, -0.5, 5.0, 200)
    assert a[0] == b[0] and a[1] > b[1] and a[2] < b[2]
    pnl = spark.createDataFrame([("s", "a", dt.date(2020, 1, 1) + dt.timedelta(i), 0.001 * ((i * 7) % 5 - 1.5)) for i in range(200)], "series_id string, strategy string, date date, p double")
    assert 0 <= B.deflated_sharpe(pnl, "p", 10).first()["dsr"] <= 1


def test_breakeven_and_events(spark):
    rows = [("s", "a", s, dt.date(2020, 1, 1 + i), (1.0 - s) * (i + 1)) for s in (0.0, 0.5, 1.0, 1.5) for i in range(5)]
    sims = spark.createDataFrame(rows, "series_id string, strategy string, half_spread double, date date, pnl_net double")
    assert B.breakeven(sims).first()["breakeven"] in (1.0, 1.5)
    events = [("e", "2020-01-02", "2020-01-03"), ("none", "2019-01-01", "2019-01-02")]
    got = B.event_windows(sims.where("half_spread = 0"), events, "pnl_net").orderBy("date").collect()
    assert [r["cumulative"] for r in got] == [2.0, 5.0]


def test_tables_of_simulations(spark):
    rng = np.random.default_rng(8)
    rows = [("x", s, 0.5, dt.date(2020, 1, 1) + dt.timedelta(i), 1.0, float(x), 0.001, float(x) - 0.001, 0.0) for s, shift in (("base", 0.0), ("better", 0.01)) for i, x in enumerate(rng.normal(0.001, 0.005, 200) + shift)]
    sims = spark.createDataFrame(rows, B.SIMULATION)
    table = {r["strategy"]: r for r in B.performance_table(sims).collect()}
    assert table["base"]["ann_cost"] == pytest.approx(0.252) and table["better"]["avg_weight"] == 1.0
    assert table["better"]["gross_ann_return"] - table["better"]["net_ann_return"] == pytest.approx(0.252)
    edge = B.net_edge(sims, "base").collect()
    assert [r["strategy"] for r in edge] == ["better"] and edge[0]["t_stat"] > 5 and edge[0]["p_value"] < 1e-4 and edge[0]["ann_diff"] == pytest.approx(252 * edge[0]["mean_daily_diff"])


def test_standard_strategies(spark):
    df, dates, _, vix = market(spark, 60)
    df = df.withColumn("rv_cc_trail_22", F.lit(0.05))
    panel = df.select("series_id", "date", F.inline(F.array(F.struct(F.lit("gjr_n").alias("model"), F.lit(0.03).alias("forecast")), F.struct(F.lit("har_log_iv").alias("model"), F.lit(None).cast("double").alias("forecast")))), F.lit(22).alias("horizon"))
    rows = B.strategy_weights(df, panel).collect()
    assert len(rows) == 8 * 60 and {r["rebalance_every"] for r in rows if r["strategy"].endswith("5d")} == {5}
    by = {(r["strategy"], r["date"]): r["base_w"] for r in rows}
    for d, v in zip(dates, vix):
        iv = (v / 100) ** 2
        assert by[("model_binary", d)] == float(iv > 0.03) and by[("naive_binary", d)] == float(iv > 0.05) and by[("robust_binary", d)] is None and by[("always_short", d)] == 1.0 and by[("model_linear", d)] is None


def test_two_series_give_what_each_gives_alone(spark):
    """Weights, scale, simulation and every figure know only their own series."""
    one, *_ = market(spark, 90)
    other = one.withColumns({"series_id": F.lit("t"), "dv_cc": F.col("dv_cc") * 3, "vix_close": F.col("vix_close") + 5}).withColumn("iv30", F.pow(F.col("vix_close") / 100, 2))

    def all_of(df):
        table = df.select("series_id", "date", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(w).alias("base_w"), F.lit(k).alias("rebalance_every")) for n, w, k in (("a", 1.0, 1), ("b", 0.5, 5))])))
        sims = B.simulate(B.with_scale(table, B.unit_pnl(df), B.Backtest()), [0.25, 0.5]).cache()
        key = lambda r: tuple(str(x) for x in r[:4])
        parts = (sims, B.performance_table(sims), B.breakeven(sims), B.net_edge(sims.where("half_spread = 0.5"), "a", 5), B.drawdown_episodes(sims.where("half_spread = 0.5"), "pnl_net"))
        return [sorted((tuple(r) for r in p.collect()), key=key) for p in parts]

    both, alone, second = all_of(one.unionByName(other)), all_of(one), all_of(other)
    for k in range(5):
        assert [repr(r) for r in both[k]] == [repr(r) for r in sorted(alone[k] + second[k], key=lambda r: tuple(str(x) for x in r[:4]))]
    assert len(both[0]) == 90 * 2 * 2 * 2
