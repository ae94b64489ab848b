import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.evaluate import scores as S
from tidemark.evaluate.registry import log_configs, total_configs
from tidemark.forecast import baselines, boost, garch, protocol, walkforward
from tidemark.params import Protocol, WalkForward
from tidemark.plans import reference_queries

PROTOCOL = Protocol("2001-12-03", "2002-05-31")
NAMES = ["dv_cc", "rv_cc_trail_1", "rv_cc_trail_5", "rv_cc_trail_22", "target_rv_22"]


def frame(days=400, series="s", start="2001-01-02", speed=0.2):
    """A series whose variance wanders around its level by the golden-ratio sequence, with its trailing and forward averages."""
    turn = np.modf(np.arange(1, days + 1) * 0.6180339887498949)[0]
    dv = 2e-4 * np.exp(0.8 * np.sin(np.arange(days) * speed / np.pi) + turn - 0.5)
    total = np.r_[0.0, np.cumsum(dv)]
    d = pd.DataFrame({"series_id": series, "date": [x.date() for x in pd.bdate_range(start, periods=days)], "dv_cc": dv, "iv30": 0.04})
    for h in (1, 5, 22):
        mean = np.r_[np.full(h - 1, np.nan), (total[h:] - total[:-h]) * 252 / h]
        d[f"rv_cc_trail_{h}"] = mean
        if h == 22:
            d["target_rv_22"] = np.r_[mean[h:], np.full(h, np.nan)]
    return d


def load(spark, d):
    names = [c for c in d.columns if c not in ("series_id", "date")]
    rows = [(r["series_id"], r["date"], *[None if pd.isna(r[c]) else float(r[c]) for c in names]) for r in d.to_dict("records")]
    return spark.createDataFrame(rows, "series_id string, date date, " + ", ".join(f"{c} double" for c in names))


def expected(d, columns, first, last, spec, log=False):
    """Every evaluation row between two places on its own: normal equations over the rows its block may know."""
    table = d[[*columns, "target_rv_22"]].to_numpy()
    table = np.log(np.maximum(table, 1e-5)) if log else table
    out = {}
    for p in range(first, last + 1):
        refit = first + (p - first) // spec.refit_every * spec.refit_every
        known = table[: max(0, refit - spec.horizon + 1)]
        known = known[~np.isnan(known).any(1)]
        if len(known) < spec.min_train or np.isnan(table[p, :-1]).any():
            out[d.date[p]] = None
            continue
        a = np.c_[np.ones(len(known)), known[:, :-1]]
        beta = np.linalg.solve(a.T @ a, a.T @ known[:, -1])
        value = np.r_[1.0, table[p, :-1]] @ beta
        out[d.date[p]] = np.exp(value) * np.exp(known[:, -1] - a @ beta).mean() if log else value
    return out


def at_places(df, d, first, last):
    """Evaluation rows of the days at those places."""
    days = {x: i for i, x in enumerate(d.date[first : last + 1])}
    rows = df.sparkSession.createDataFrame([(d.series_id[0], x, i) for x, i in days.items()], "series_id string, date date, ordinal int")
    return rows


def close_to(got, want):
    assert set(got) == set(want)
    for day, value in want.items():
        assert (got[day] is None) == (value is None) and (value is None or got[day] == pytest.approx(value, rel=1e-6))


@pytest.mark.parametrize("name, columns", [("har", [1, 5, 22]), ("har_log", [1, 5, 22]), ("har_iv", None)])
def test_regressions_match_one_solved_for_each_row(spark, name, columns):
    d, spec = frame(), WalkForward(22, 7, 120)
    d["iv30"] = d.rv_cc_trail_5.fillna(0.03) * 0.9 + 0.01 * np.cos(np.arange(len(d)))
    d.loc[260, "rv_cc_trail_5"] = np.nan
    df = load(spark, d)
    names = [f"rv_cc_trail_{n}" for n in (1, 5, 22)] + ([] if columns else ["iv30"])
    out = walkforward.walkforward_ols(df, at_places(df, d, 150, 340), walkforward.HAR_SPECS[name], spec)
    got = {r["date"]: r["forecast"] for r in out.collect()}
    want = expected(d, names, 150, 340, spec, "log" in name)
    close_to(got, want)
    assert sum(v is None for v in want.values()) > 10 and out.count() == 191


def test_single_regressor_stays_in_the_engine(spark):
    d, spec = frame(), WalkForward(22, 7, 120)
    df = load(spark, d)
    got = {r["date"]: r["forecast"] for r in walkforward.walkforward_single(df, at_places(df, d, 150, 340), "rv_cc_trail_5", spec).collect()}
    close_to(got, expected(d, ["rv_cc_trail_5"], 150, 340, spec))


def test_dev_rows_end_a_horizon_before_the_development_period_does(spark):
    d = frame()
    places = [r["pos"] for r in protocol.dev_rows(load(spark, d), 22, PROTOCOL).orderBy("date").collect()]
    assert places[-1] == sum(x <= pd.Timestamp(PROTOCOL.dev_end).date() for x in d.date) - 1 - 22


def test_a_block_knows_the_targets_complete_at_its_first_row_and_no_other(spark):
    class Largest:
        """Forecasts the largest target it was shown: any row beyond the barrier would show."""

        def fit(self, x, y):
            self.most = y.max()

        def predict(self, x):
            return np.full(len(x), self.most)

    d, spec = frame(), WalkForward(22, 10, 50)
    d["target_rv_22"] = np.arange(len(d), dtype=float)
    two = pd.concat([d, d.assign(series_id="t", target_rv_22=-d.target_rv_22)], ignore_index=True)
    df = load(spark, two)
    rows = at_places(df, d, 200, 245)
    rows = rows.unionByName(rows.withColumn("series_id", F.lit("t")))
    design = walkforward.har_design(df, walkforward.HAR_SPECS["har"], 22)
    for stripes in (1, 4):
        out = walkforward.walkforward_model(design, rows, "largest", Largest, spec, stripes=stripes).collect()
        place = {x: i for i, x in enumerate(d.date)}
        assert len(out) == 92
        for r in out:
            first = 200 + (place[r["date"]] - 200) // 10 * 10
            assert r["forecast"] == (first - 22 if r["series_id"] == "s" else -21)


def test_evaluation_rows_the_features_lack_are_refused(spark):
    d = frame()
    df = load(spark, d)
    rows = at_places(df, d, 200, 230)
    for call in (lambda: walkforward.walkforward_ols(df.where(F.col("date") != d.date[210]), rows, walkforward.HAR_SPECS["har"], WalkForward()), lambda: walkforward.walkforward_single(df.where(F.col("date") != d.date[210]), rows, "rv_cc_trail_5", WalkForward())):
        with pytest.raises(Exception, match="features lack"):
            call().collect()


def test_logs_stay_positive_and_specs_are_checked(spark):
    df = load(spark, frame())
    rows = protocol.dev_rows(df, 22, PROTOCOL)
    out = walkforward.walkforward_ols(df, rows, walkforward.HAR_SPECS["har_log"], WalkForward(22, 22, 100)).toPandas()
    assert (out.forecast > 0).all() and len(out) == rows.count()
    for bad in ({"jumps": "x"}, {"jumps": "j", "log": True}):
        with pytest.raises(ValueError):
            walkforward.HarSpec("bad", **bad)


def test_guard_common_sample_and_keep_first(spark):
    df = load(spark, frame())
    protocol.holdout_guard(protocol.dev_rows(df, 22, PROTOCOL), PROTOCOL)
    with pytest.raises(protocol.HoldoutViolation):
        protocol.holdout_guard(protocol.holdout_rows(df, 22, PROTOCOL), PROTOCOL)
    rw = baselines.random_walk(df, (22,))
    other = rw.withColumn("model", F.lit("b")).where(F.col("date") > "2002-03-01")
    sample = protocol.common_sample(baselines.union([rw, other]), protocol.targets(df.withColumns({"target_rv_1": F.lit(None).cast("double"), "target_rv_5": F.lit(None).cast("double")}), (22,)))
    per_day = sample.groupBy("date").count()
    assert per_day.where("count <> 2").count() == 0 and sample.count() > 0
    assert baselines.keep_first([rw, rw.withColumn("forecast", F.lit(-1.0))]).where("forecast = -1").count() == 0


def test_baselines(spark):
    d = frame(300)
    df = load(spark, d)
    mean = baselines.expanding_mean(df, horizons=(1,)).orderBy("date").toPandas().forecast
    assert mean[:251].isna().all() and mean[260] == pytest.approx(d.dv_cc[:261].mean() * 252)
    ewma = baselines.ewma(df, horizons=(1,)).orderBy("date").toPandas().forecast
    s = d.dv_cc[0]
    for x in d.dv_cc[1:]:
        s = 0.94 * s + 0.06 * x
    assert ewma.iloc[-1] == pytest.approx(s * 252)


def test_losses_and_tests(spark):
    rng = np.random.default_rng(11)
    n = 600
    dates = [x.date() for x in pd.bdate_range("2001-01-01", periods=n)]
    y = rng.uniform(0.01, 0.09, n)
    rows = [("s", d, 22, m, float(f), float(v)) for i, (d, v) in enumerate(zip(dates, y)) for m, f in (("good", v * 1.01 + rng.normal(0, 1e-3)), ("bad", v * 1.5), ("over", 0.5 * v + 0.01 + rng.normal(0, 1e-3)))]
    sample = spark.createDataFrame(rows, "series_id string, date date, horizon int, model string, forecast double, y double")
    lossed = S.losses(sample).cache()
    one = spark.createDataFrame([(0.02, 0.01), (0.01, 0.02)], "y double, f double").select(S.qlike(F.col("y"), F.col("f")).alias("q")).collect()
    assert [r["q"] for r in one] == pytest.approx([2 - np.log(2) - 1, 0.5 - np.log(0.5) - 1])
    dm = {r["model"]: r for r in S.diebold_mariano(lossed, "se", "good").collect()}
    assert dm["bad"]["stat"] > 3 and dm["bad"]["p_value"] < 0.01
    d = np.array([(y[i] * 0.5) ** 2 for i in range(n)]) - np.array([r["se"] for r in lossed.where("model = 'good'").orderBy("date").collect()])
    e = d - d.mean()
    lrv = e @ e / n + 2 * sum((1 - k / 45) * (e[k:] @ e[:-k]) / n for k in range(1, 45))
    assert dm["bad"]["stat"] == pytest.approx(d.mean() / np.sqrt(lrv / n), rel=1e-9)
    mz = {r["model"]: r for r in S.mincer_zarnowitz(sample).collect()}
    assert mz["over"]["p_joint"] < 1e-3 and mz["over"]["beta"] == pytest.approx(2, abs=0.1)
    x = np.column_stack([np.ones(n), [r["forecast"] for r in sample.where("model = 'good'").orderBy("date").collect()]])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ b)[:, None]
    meat = u.T @ u + sum((1 - k / 45) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 45))
    bread = np.linalg.inv(x.T @ x)
    t = b - [0, 1]
    assert mz["good"]["wald"] == pytest.approx(t @ np.linalg.inv(bread @ meat @ bread) @ t, rel=1e-6)
    sets = {r["model"]: (r["in_90"], r["p_value"]) for r in S.confidence_set(lossed, "se", 200).collect()}
    assert sets["good"] == (True, 1.0) and not sets["bad"][0]
    short = lossed.where(F.col("date") < "2001-03-01")
    assert S.diebold_mariano(short, "se", "good", short="null").first()["stat"] is None
    with pytest.raises(Exception, match="too few"):
        S.diebold_mariano(short, "se", "good").collect()
    two = lossed.unionByName(lossed.withColumns({"series_id": F.lit("t"), "se": F.col("se") + F.when(F.col("model") == "bad", 5.0).otherwise(0.0)}))
    for call in (lambda x: S.long_run_variance(x, "se", S.KEYS, 22), lambda x: S.diebold_mariano(x, "se", "good"), lambda x: S.mincer_zarnowitz(x)):
        single = {r["model"]: r for r in call(lossed).collect()}
        for r in call(two).where("series_id = 's'").collect():
            assert [x if isinstance(x, str) else round(x, 12) for x in r] == [x if isinstance(x, str) else round(x, 12) for x in single[r["model"]]]


def test_garch_recovers_persistence_and_cache_resumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, h, r = 1500, 1.0, []
    for _ in range(n):
        r.append(np.sqrt(h) * rng.standard_normal())
        h = 0.05 + 0.08 * r[-1] ** 2 + 0.87 * h
    _, params = garch.fit(garch.GARCH_SPECS["garch_n"], np.array(r))
    assert 0.85 < params[2] + params[4] < 0.995 and params[2] < 0.2
    for name in garch.GARCH_SPECS:
        ahead = garch.variance_forecast(garch.GARCH_SPECS[name], garch.fit(garch.GARCH_SPECS[name], np.array(r[:400]))[1], 1.0, 22, 3)
        assert (ahead > 0).all() and len(ahead) == 22
    dates = [x.date() for x in pd.bdate_range("2001-01-01", periods=330)]
    df = spark.createDataFrame([("s", d, float(x) / 100) for d, x in zip(dates, r)], "series_id string, date date, ret_cc double")
    rows = df.where(F.col("date") >= dates[300]).withColumn("ordinal", F.datediff("date", F.lit(dates[300])) * 0 + F.row_number().over(__import__("pyspark").sql.Window.orderBy("date")) - 1)
    path = str(tmp_path / "cache")
    first = garch.ensure_cached(spark, path, df, rows.limit(22), ("garch_n",), min_train=250, refit_every=22)
    assert first.count() == 22 * 3
    both = garch.ensure_cached(spark, path, df, rows, ("garch_n",), min_train=250, refit_every=22)
    assert both.count() == 30 * 3 and both.select("date", "horizon").distinct().count() == 90


def test_boosting_learns_and_respects_its_limits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.5 * x[:, 1] + rng.normal(0, 0.1, 800)
    model = boost.Boosting(rounds=120).fit(x[:600], y[:600])
    error = ((model.predict(x[600:]) - y[600:]) ** 2).mean()
    assert error < 0.15 * y.var() and model.gain.argmax() == 0 and max(sum(n[0] is None for n in t) for t in model.trees) <= 15
    assert model.predict(x[:5]).tolist() == boost.Boosting(rounds=120).fit(x[:600], y[:600]).predict(x[:5]).tolist()


def test_registered_boosting_runs_the_default_rounds(spark, monkeypatch):
    used = []
    for name in ("boosting_forecasts", "feature_importance"):
        real = getattr(boost, name)
        monkeypatch.setattr(boost, name, lambda *a, _real=real, **k: used.append(inspect.signature(_real).bind(*a, **k)) or spark.range(0).select(F.lit("s").alias("series_id"), F.current_date().alias("date"), F.lit(22).alias("horizon"), F.lit("boosting").alias("model"), F.lit(0.0).alias("forecast")))
    monkeypatch.setattr(reference_queries, "cut_lineage", lambda df: df)
    for name in ("boosting", "boosting_importance", "holdout_strategies"):
        reference_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(used) >= 3 and all(b.arguments.get("rounds", 300) == 300 for b in used) and boost.Boosting().rounds == 300


def test_one_row_is_predicted_as_many_are():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    model = boost.Boosting(rounds=20).fit(x, x[:, 0] + rng.normal(size=600))
    assert [model.predict(x[i : i + 1])[0] for i in range(40)] == model.predict(x[:40]).tolist()


def test_holdout_strategies_are_carried_over_from_development(spark, monkeypatch):
    """Weights and simulation run over both parts; only then are the rows cut to the holdout."""
    d = frame(900)
    d["vix_close"], d["target_rv_1"], d["target_rv_5"] = 20.0, None, None
    features, split = load(spark, d), Protocol("2001-12-03", "2003-06-30")
    made = lambda f, rows, **k: rows.select("series_id", "date", F.lit(22).alias("horizon"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(0.03).alias("forecast")) for m in ("gjr_n", "har_log_iv")])))
    seen, real = [], reference_queries.B.simulate
    monkeypatch.setattr(reference_queries, "asset_features", lambda s, folder: features)
    monkeypatch.setattr(reference_queries, "PROTOCOL", split)
    monkeypatch.setattr(reference_queries, "forecast_panel", made)
    monkeypatch.setattr(reference_queries.B, "simulate", lambda scaled, *a: seen.append(scaled) or real(scaled, *a))
    got = {r["strategy"]: r for r in reference_queries.holdout_strategies(spark, "").collect()}
    scaled = seen[0].where(F.col("strategy") == "model_linear")
    first = scaled.where(F.col("date") > split.dev_end).orderBy("date").first()
    assert scaled.where(F.col("date") <= split.dev_end).count() > 300 and first["base_w"] == 1.0 and first["scale"] is not None
    assert len(got) == 8 and got["model_linear"]["avg_weight"] == got["always_short"]["avg_weight"] > 0


def test_dev_panel_holds_every_model_at_its_horizons(spark, monkeypatch):
    d = frame(900)
    d["jump_22"] = d["jump_5"] = d["target_rv_1"] = d["target_rv_5"] = 0.01
    for c in ("bv_trail_5", "bv_trail_22", "rv_pk_trail_5", "rv_pk_trail_22"):
        d[c] = d["rv_cc_trail_5"]
    d["ret_cc"] = np.sqrt(d["dv_cc"])
    features, split = load(spark, d), Protocol("2003-06-02", "2003-12-31")
    flat = lambda f, rows, model, horizons: rows.select("series_id", "date", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"), F.lit(model).alias("model"), F.lit(0.03).alias("forecast"))
    monkeypatch.setattr(boost, "boosting_forecasts", lambda f, rows, *a: flat(f, rows, "boosting", (22,)))
    monkeypatch.setattr(garch, "garch_forecasts", lambda f, rows, horizons, **k: baselines.union([flat(f, rows, m, horizons) for m in garch.GARCH_SPECS]))
    monkeypatch.setattr(reference_queries, "asset_features", lambda s, folder: features)
    monkeypatch.setattr(reference_queries, "PROTOCOL", split)
    have = {}
    for r in reference_queries._dev_panel(spark, "").select("horizon", "model", "date").collect():
        have.setdefault((r["horizon"], r["model"]), set()).add(r["date"])
    assert {h: len({m for k, m in have if k == h}) for h in (1, 5, 22)} == {1: 14, 5: 14, 22: 15}
    assert len({frozenset(x) for x in have.values()}) == 1  # the rows of 22 days, on which GARCH is fitted
    lossed = []
    monkeypatch.setattr(reference_queries, "_dev_panel", lambda s, folder: lossed.append(1) or features)
    for name in ("score_table", "model_confidence_set", "dm_p_values", "mz_joint"):
        with pytest.raises(Exception):
            reference_queries.QUERIES[name](spark, "")
    assert len(lossed) == 4


def test_registry_counts_each_configuration_once(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = spark.createDataFrame([("2", "har", 22, "{}", "dev")] * 2 + [("2", "har", 5, "{}", "dev")], "phase string, model string, horizon int, params string, eval_window string")
    assert total_configs(spark, path) == 0
    assert log_configs(spark, path, entry) == 2
    assert log_configs(spark, path, entry) == 2
