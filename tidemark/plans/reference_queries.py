"""Queries for the analytics operators. Those on long histories use the adapted tables, the others the index series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.backtest import strategies as B
from tidemark.evaluate import scores as S
from tidemark.evaluate.registry import new_entries
from tidemark.forecast import baselines, boost, garch, protocol, walkforward
from tidemark.forecast.panel import common_models, forecast_panel
from tidemark.functions.windows import by_date
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.params import HORIZONS, SAMPLE_START, WalkForward
from tidemark.plans import figures
from tidemark.plans.market import PROTOCOL, asset_bars, asset_features, asset_volatility, series_bars, series_features
from tidemark.session import cut_lineage, table
from tidemark.streaming.bars import daily_bars


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Floating results rounded, dates as text: sums in another order then compare equal."""
    change = {f.name: F.round(f.name, digits) + 0.0 for f in df.schema.fields if f.dataType.typeName() == "double"}
    change |= {f.name: F.col(f.name).cast("string") for f in df.schema.fields if f.dataType.typeName() == "date"}
    return df.withColumns(change) if change else df


def market(df: DataFrame, digits: int = 8) -> DataFrame:
    """Results on the adapted tables, which hold one market: its name is left out."""
    return tidy(df.drop("series_id"), digits)


# Bars, calendars and checks


def bars_daily(s: SparkSession, d: str) -> DataFrame:
    return tidy(asset_bars(s, d))


def iv_daily(s: SparkSession, d: str) -> DataFrame:
    return tidy(asset_volatility(s, d), 5)


def events_bars(s: SparkSession, d: str) -> DataFrame:
    return tidy(daily_bars(table(s, d, "events")))


def series_bars_first(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_bars(s, d, "gspc"))


def calendar_joint(s: SparkSession, d: str) -> DataFrame:
    joint = X.joint_calendar(series_bars(s, d, "gspc"), series_bars(s, d, "vix"), start="2000-01-03")
    return tidy(joint.select("series_id", "date", "spx_close", "vix_close"))


def calendar_joint_whole(s: SparkSession, d: str) -> DataFrame:
    """The join from the first day of the sample on; ``calendar_joint`` holds the days from the evaluation start, as its SQL."""
    joint = X.joint_calendar(series_bars(s, d, "gspc"), series_bars(s, d, "vix"), start=SAMPLE_START)
    return tidy(joint.select("series_id", "date", "spx_close", "vix_close"))


def calendar_dropped(s: SparkSession, d: str) -> DataFrame:
    return X.dropped_days(series_bars(s, d, "gspc"), series_bars(s, d, "vix"))


def crosscheck(s: SparkSession, d: str) -> DataFrame:
    return tidy(X.cross_check(series_bars(s, d, "gspc"), series_bars(s, d, "spx_stooq")))


def _raw(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, name).select("series_id", "date", "bar_id", "open", "high", "low", "close").where(F.col("date").isNotNull())


def quality_index(s: SparkSession, d: str) -> DataFrame:
    return Q.check_index(_raw(s, d, "gspc"), "bar_id").withColumn("examples", F.concat_ws(",", "examples"))


def quality_ohlc(s: SparkSession, d: str) -> DataFrame:
    bars = X.first_per_day(_raw(s, d, "gspc"), "bar_id")
    return Q.check_ohlc(bars, 100, 50000).where(F.col("severity") != "info").withColumn("examples", F.concat_ws(",", "examples"))


def quality_ohlc_shares(s: SparkSession, d: str) -> DataFrame:
    bars = X.first_per_day(_raw(s, d, "gspc"), "bar_id")
    return Q.check_ohlc(bars, 100, 50000).where(F.col("severity") == "info").drop("examples")


def quality_close(s: SparkSession, d: str) -> DataFrame:
    return Q.check_close(X.first_per_day(_raw(s, d, "vix"), "bar_id"), 4, 200).withColumn("examples", F.concat_ws(",", "examples"))


def quality_variance(s: SparkSession, d: str) -> DataFrame:
    columns = ("dv_cc", "dv_parkinson", "dv_garman_klass", "dv_rogers_satchell")
    return Q.check_variance(table(s, d, "features").select("series_id", "date", *columns), columns).withColumn("examples", F.concat_ws(",", "examples"))


# Features


def dv_estimators(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_features(s, d).select("series_id", "date", "ret_cc", "dv_cc", "dv_parkinson", "dv_garman_klass", "dv_rogers_satchell"))


def yang_zhang(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_features(s, d).select("series_id", "date", "dv_yang_zhang22"))


def rv_trailing(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_features(s, d).select("series_id", "date", *[f"rv_{k}_trail_{n}" for k in ("cc", "gk", "pk") for n in (1, 5, 22)]))


def rv_forward(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_features(s, d).select("series_id", "date", "target_rv_1", "target_rv_5", "target_rv_22", "vrp_expost"))


def bipower_jump(s: SparkSession, d: str) -> DataFrame:
    return tidy(series_features(s, d).select("series_id", "date", "bv_trail_5", "bv_trail_22", "jump_5", "jump_22"))


def features_full(s: SparkSession, d: str) -> DataFrame:
    return tidy(asset_features(s, d), 7)


def open_synthetic_by_year(s: SparkSession, d: str) -> DataFrame:
    return tidy(X.synthetic_open_share(series_features(s, d)))


def vrp_summary_by_period(s: SparkSession, d: str) -> DataFrame:
    return tidy(X.vrp_summary(asset_features(s, d)), 6)


def estimator_table(s: SparkSession, d: str) -> DataFrame:
    return tidy(X.estimator_table(asset_features(s, d), "1998-01-01"), 6)


# Forecasts


def baseline_random_walk(s: SparkSession, d: str) -> DataFrame:
    return tidy(baselines.random_walk(asset_features(s, d)))


def baseline_expanding_mean(s: SparkSession, d: str) -> DataFrame:
    return tidy(baselines.expanding_mean(asset_features(s, d)))


def baseline_ewma(s: SparkSession, d: str) -> DataFrame:
    return tidy(baselines.ewma(asset_features(s, d), horizons=(22,)))


def _dev(s: SparkSession, d: str, horizon: int = 22) -> tuple[DataFrame, DataFrame]:
    """Features, written once for the many forecasts that read them, and evaluation rows."""
    features = cut_lineage(asset_features(s, d))
    return features, protocol.guarded(protocol.dev_rows(features, horizon, PROTOCOL), PROTOCOL)


def eval_index(s: SparkSession, d: str) -> DataFrame:
    features, dev = _dev(s, d)
    rows = [dev.withColumn("part", F.lit("dev")), protocol.holdout_rows(features, 22, PROTOCOL).withColumn("part", F.lit("holdout"))]
    return tidy(rows[0].unionByName(rows[1]).select("part", "date", F.col("pos").cast("long").alias("pos"), F.col("ordinal").cast("long").alias("ordinal")))


def walkforward_uni(s: SparkSession, d: str) -> DataFrame:
    features, dev = _dev(s, d)
    return tidy(walkforward.walkforward_single(features, dev, "rv_cc_trail_22", WalkForward(22)))


def _har(s: SparkSession, d: str, names: tuple[str, ...], horizons: tuple[int, ...] = (22,)) -> DataFrame:
    features = cut_lineage(asset_features(s, d))
    return baselines.union([walkforward.walkforward_ols(features, protocol.dev_rows(features, h, PROTOCOL), walkforward.HAR_SPECS[n], WalkForward(h)) for n in names for h in horizons])


def walkforward_har(s: SparkSession, d: str) -> DataFrame:
    return tidy(_har(s, d, tuple(walkforward.HAR_SPECS), HORIZONS))


def _panel(features: DataFrame, dev: DataFrame) -> DataFrame:
    every = baselines.union([baselines.random_walk(features, (22,)), baselines.implied(features, (22,)), baselines.expanding_mean(features, horizons=(22,)), walkforward.walkforward_single(features, dev, "rv_cc_trail_22", WalkForward(22))])
    return every.join(dev.select("series_id", "date"), ["series_id", "date"])


def _sample(s: SparkSession, d: str) -> DataFrame:
    features, dev = _dev(s, d)
    return cut_lineage(protocol.common_sample(_panel(features, dev), protocol.targets(features, (22,))))


def _dev_panel(s: SparkSession, d: str) -> DataFrame:
    """Common sample of every model at every horizon it has over the development period, written once: fifteen at 22 days, those but boosting at 1 and 5.

    GARCH is fitted once, on the rows of 22 days, for all horizons.
    """
    features = cut_lineage(asset_features(s, d))
    rows = {h: protocol.guarded(protocol.dev_rows(features, h, PROTOCOL), PROTOCOL) for h in HORIZONS}
    parts = [forecast_panel(features, rows[h], h, ("baseline", "har", "boosting") if h == 22 else ("baseline", "har")) for h in HORIZONS]
    parts.append(garch.garch_forecasts(features, rows[22], horizons=HORIZONS).select("series_id", "date", "horizon", "model", "forecast"))
    return cut_lineage(protocol.common_sample(baselines.union(parts), protocol.targets(features)))


def common_sample(s: SparkSession, d: str) -> DataFrame:
    return tidy(_sample(s, d))


def loss_scores(s: SparkSession, d: str) -> DataFrame:
    return market(S.scores(S.losses(_sample(s, d))), 6)


def oos_r2(s: SparkSession, d: str) -> DataFrame:
    return market(S.out_of_sample_r2(_sample(s, d), "vix", "expanding_mean"), 6)


def newey_west_lrv(s: SparkSession, d: str) -> DataFrame:
    return market(S.long_run_variance(S.losses(_sample(s, d)), "qlike", ("series_id", "model"), 22), 6)


def dm_stat(s: SparkSession, d: str) -> DataFrame:
    return tidy(S.diebold_mariano(S.losses(_sample(s, d)), "qlike", "random_walk", 22, short="null").select("model", "n", "mean_diff", "stat"), 6)


def dm_p_values(s: SparkSession, d: str) -> DataFrame:
    return market(S.diebold_mariano(S.losses(_dev_panel(s, d)), "qlike", "random_walk", short="null"), 6)


def mz_ols(s: SparkSession, d: str) -> DataFrame:
    return tidy(S.mincer_zarnowitz(_sample(s, d)).select("model", "n", "alpha", "beta", "r2"), 6)


def mz_joint(s: SparkSession, d: str) -> DataFrame:
    return market(S.mincer_zarnowitz(_dev_panel(s, d)), 6)


def dm_sample(s: SparkSession, d: str) -> DataFrame:
    """The test with its probabilities on the four models whose SQL is stated."""
    return market(S.diebold_mariano(S.losses(_sample(s, d)), "qlike", "random_walk", 22).drop("horizon"), 6)


def mz_sample(s: SparkSession, d: str) -> DataFrame:
    out = S.mincer_zarnowitz(_sample(s, d), 22).drop("horizon")
    return market(out.withColumn("wald", F.round("wald", 4)), 6)


def score_table_sample(s: SparkSession, d: str) -> DataFrame:
    return market(S.score_table(_sample(s, d), against="random_walk", lag=22).drop("horizon"), 6)


def model_confidence_set(s: SparkSession, d: str) -> DataFrame:
    return market(S.confidence_set(S.losses(_dev_panel(s, d))), 4)


def _both_parts(features: DataFrame) -> list[DataFrame]:
    return [protocol.guarded(protocol.dev_rows(features, 22, PROTOCOL), PROTOCOL), protocol.holdout_rows(features, 22, PROTOCOL)]


def garch_fit(s: SparkSession, d: str) -> DataFrame:
    features = cut_lineage(asset_features(s, d))
    return tidy(baselines.union([garch.garch_forecasts(features, rows, min_train=1250) for rows in _both_parts(features)]))


def boosting(s: SparkSession, d: str) -> DataFrame:
    features = cut_lineage(asset_features(s, d))
    return tidy(baselines.union([boost.boosting_forecasts(features, rows) for rows in _both_parts(features)]))


def boosting_importance(s: SparkSession, d: str) -> DataFrame:
    return tidy(boost.feature_importance(asset_features(s, d), 22, PROTOCOL.dev_end), 4)


def config_registry(s: SparkSession, d: str) -> DataFrame:
    """Register of order settings: distinct ones not among those of fulfilled orders."""
    orders = table(s, d, "orders")
    entry = lambda o: o.select(F.lit("orders").alias("phase"), F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("horizon"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("params"), F.lit("all").alias("eval_window"))
    return new_entries(entry(orders), entry(orders.where(F.col("o_orderstatus") == "F"))).drop("first_logged_utc")


# Strategies


def _weights(features: DataFrame) -> DataFrame:
    """Five strategies over the days with trailing variance: always, binary and linear, the latter two also weekly."""
    df = features.select("series_id", "date", "rv_cc_trail_22", B.vrp_signal(F.col("iv30"), F.col("rv_cc_trail_22")).alias("signal"))
    df = B.linear_weights(df, "signal", "linear").where(F.col("rv_cc_trail_22").isNotNull())
    cells = [("always_short", B.always(F.col("signal")), 1), ("naive_binary", B.binary(F.col("signal")), 1), ("naive_binary_5d", B.binary(F.col("signal")), 5), ("naive_linear", F.col("linear"), 1), ("naive_linear_5d", F.col("linear"), 5)]
    return df.select("series_id", "date", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), w.alias("base_w"), F.lit(k).alias("rebalance_every")) for n, w, k in cells])))


def weights(s: SparkSession, d: str) -> DataFrame:
    return market(_weights(asset_features(s, d)), 6)


def unit_pnl(s: SparkSession, d: str) -> DataFrame:
    return tidy(B.unit_pnl(asset_features(s, d)).select("date", "carry", "m2m", "unit_pnl", B.spread_cost(F.col("vix_close"), F.lit(0.5)).alias("spread_cost")))


def turnover(s: SparkSession, d: str) -> DataFrame:
    w = _weights(asset_features(s, d)).where(F.col("base_w").isNotNull())
    before = F.coalesce(F.lag("base_w").over(by_date("series_id", "strategy")), F.lit(0.0))
    return tidy(w.select("strategy", "date", B.turnover(F.col("base_w"), before).alias("turnover")), 6)


def _simulated(s: SparkSession, d: str, spreads: list[float]) -> DataFrame:
    return _simulate(cut_lineage(asset_features(s, d)), spreads)


def _simulate(features: DataFrame, spreads: list[float]) -> DataFrame:
    p = B.Backtest()
    return B.simulate(B.with_scale(_weights(features), B.unit_pnl(features), p), spreads, p)


def strategy_sim(s: SparkSession, d: str) -> DataFrame:
    return market(_simulated(s, d, [0.5]), 6)


def series_sim(s: SparkSession, d: str) -> DataFrame:
    """The simulation of every index series, each a market of its own."""
    return tidy(_simulate(cut_lineage(series_features(s, d)), [0.5]), 6)


def series_performance(s: SparkSession, d: str) -> DataFrame:
    out = B.performance(_simulate(cut_lineage(series_features(s, d)), [0.5]), "pnl_net")
    return tidy(out.select("series_id", "strategy", "n", "ann_return", "max_dd", "var95", "cvar95", "hit_rate"), 6)


def series_scores(s: SparkSession, d: str) -> DataFrame:
    """Robust variance of the losses of two forecasts, for every index series."""
    features = cut_lineage(series_features(s, d))
    panel = baselines.union([baselines.random_walk(features, (22,)), baselines.implied(features, (22,))])
    sample = protocol.common_sample(panel, protocol.targets(features, (22,)))
    return tidy(S.long_run_variance(S.losses(sample), "qlike", S.KEYS, 22).drop("horizon"), 6)


def breakeven_sweep(s: SparkSession, d: str) -> DataFrame:
    return market(B.breakeven(_simulated(s, d, [x / 4 for x in range(13)])))


def perf_summary(s: SparkSession, d: str) -> DataFrame:
    return market(B.performance(_simulated(s, d, [0.5]), "pnl_net"), 6)


def deflated_sharpe(s: SparkSession, d: str) -> DataFrame:
    """Trials are the configurations of the register."""
    return market(B.deflated_sharpe(_simulated(s, d, [0.5]), "pnl_net", config_registry(s, d).count()), 6)


def _units(s: SparkSession, d: str) -> DataFrame:
    """The unit result as a strategy of its own: what the metrics are checked on against SQL."""
    return B.unit_pnl(asset_features(s, d)).where(F.col("unit_pnl").isNotNull()).select("series_id", F.lit("unit").alias("strategy"), "date", "unit_pnl")


def perf_unit(s: SparkSession, d: str) -> DataFrame:
    return market(B.performance(_units(s, d), "unit_pnl"), 6)


def drawdown_series(s: SparkSession, d: str) -> DataFrame:
    return market(B.drawdowns(_units(s, d), "unit_pnl"), 6)


def drawdown_top5(s: SparkSession, d: str) -> DataFrame:
    return market(B.drawdown_episodes(_units(s, d), "unit_pnl").withColumn("rank", F.col("rank").cast("long")), 6)


def event_windows(s: SparkSession, d: str) -> DataFrame:
    events = [("first", "1996-03-01", "1996-06-28"), ("second", "1999-09-01", "1999-12-31")]
    return market(B.event_windows(_units(s, d), events, "unit_pnl"), 6)


def sharpe_moments(s: SparkSession, d: str) -> DataFrame:
    return market(B.sharpe_moments(_units(s, d), "unit_pnl"), 6)


def alignment_report(s: SparkSession, d: str) -> DataFrame:
    return tidy(X.alignment_report(series_bars(s, d, "gspc"), series_bars(s, d, "vix")))


def score_table(s: SparkSession, d: str) -> DataFrame:
    return market(S.score_table(_dev_panel(s, d)), 6)


def holdout_strategies(s: SparkSession, d: str) -> DataFrame:
    """The eight strategies over the holdout, from all fifteen models' panel; weights and positions come from the development period on."""
    features = cut_lineage(asset_features(s, d))
    dev, holdout = (forecast_panel(features, rows) for rows in _both_parts(features))
    panel = cut_lineage(baselines.keep_first(list(common_models(dev, holdout))))
    scaled = B.with_scale(B.strategy_weights(features, panel), B.unit_pnl(features), B.Backtest())
    simulated = B.simulate(scaled, [0.5])
    return market(B.performance_table(protocol.after_dev(simulated, PROTOCOL)), 6)


def net_edge(s: SparkSession, d: str) -> DataFrame:
    return market(B.net_edge(cut_lineage(_simulated(s, d, [0.5])), "always_short"), 6)


def spread_curve(s: SparkSession, d: str) -> DataFrame:
    return market(figures.spread_curve(_simulated(s, d, [x / 4 for x in range(13)])), 6)


def equity_curves(s: SparkSession, d: str) -> DataFrame:
    return market(figures.equity_curves(_simulated(s, d, [0.5])), 6)


def premium_histogram(s: SparkSession, d: str) -> DataFrame:
    return tidy(figures.premium_histogram(series_features(s, d)), 6)


def implied_and_realised(s: SparkSession, d: str) -> DataFrame:
    return tidy(figures.implied_and_realised(asset_features(s, d)), 6)


def forecasts_beside_targets(s: SparkSession, d: str) -> DataFrame:
    return tidy(figures.forecasts_beside_targets(_sample(s, d), ("vix", "random_walk")))


def aggregation_ratio(s: SparkSession, d: str) -> DataFrame:
    features = cut_lineage(asset_features(s, d))
    return tidy(figures.aggregation_ratio(garch.garch_forecasts(features, protocol.holdout_rows(features, 22, PROTOCOL), ("gjr_n",)), "gjr_n"), 6)


QUERIES = {
    f.__name__: f
    for f in (
        bars_daily, iv_daily, events_bars, series_bars_first, calendar_joint, calendar_joint_whole, calendar_dropped, crosscheck, quality_index, quality_ohlc, quality_ohlc_shares, quality_close, quality_variance,
        dv_estimators, yang_zhang, rv_trailing, rv_forward, bipower_jump, features_full, open_synthetic_by_year, vrp_summary_by_period, estimator_table,
        baseline_random_walk, baseline_expanding_mean, baseline_ewma, eval_index, walkforward_uni, walkforward_har, common_sample, loss_scores, oos_r2, newey_west_lrv, dm_stat, dm_p_values, dm_sample, mz_ols, mz_joint, mz_sample, score_table_sample, series_sim, series_performance, series_scores,
        model_confidence_set, garch_fit, boosting, boosting_importance, config_registry, weights, unit_pnl, turnover, strategy_sim, breakeven_sweep, perf_summary, deflated_sharpe, perf_unit, drawdown_series, drawdown_top5, event_windows, sharpe_moments,
        alignment_report, score_table, holdout_strategies, net_edge, spread_curve, equity_curves, premium_histogram, implied_and_realised, forecasts_beside_targets, aggregation_ratio,
    )
}
