import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as V
from tidemark.functions.nullsafe import clip
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.plans import reference_queries


def days(n, start="2019-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars(spark, o, h, lo, c, dates=None, name="s"):
    dates = dates or days(len(c))
    return spark.createDataFrame([(name, d, *map(float, x)) for d, *x in zip(dates, o, h, lo, c)], "series_id string, date date, open double, high double, low double, close double")


def features(spark, index, implied=None):
    implied = implied or index.select("series_id", "date", F.lit(20.0).alias("close"))
    return X.build_features(X.joint_calendar(index, implied)).orderBy("date").toPandas()


def test_hand_computed_estimators(spark):
    f = features(spark, bars(spark, [98, 100], [99.5, 104], [97, 98], [99, 102])).iloc[1]
    assert f.dv_cc == pytest.approx(8.911994088162194e-4, rel=1e-12)
    assert f.dv_parkinson == pytest.approx(1.273590587787223e-3, rel=1e-12)
    assert f.dv_garman_klass == pytest.approx(1.6140884158007947e-3, rel=1e-12)
    assert f.dv_rogers_satchell == pytest.approx(1.5698072417271618e-3, rel=1e-12)
    assert f.iv30 == pytest.approx(0.04)


def test_windows_are_exact_and_never_partial(spark):
    rng = np.random.default_rng(7)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 70)))
    f = features(spark, bars(spark, c, c * 1.01, c * 0.99, c))
    dv = np.diff(np.log(c)) ** 2
    assert f.target_rv_22.isna().sum() == 22 and f.rv_cc_trail_22.isna().sum() == 22
    for t in (25, 40):
        assert f.target_rv_22[t] == pytest.approx(252 / 22 * dv[t : t + 22].sum())
        assert f.rv_cc_trail_5[t] == pytest.approx(252 / 5 * dv[t - 5 : t].sum())
        r = np.abs(np.diff(np.log(c)))
        assert f.bv_trail_22[t] == pytest.approx(math.pi / 2 * 252 / 21 * (r[t - 21 : t] * r[t - 22 : t - 1])[-21:].sum())
        assert f.jump_22[t] == pytest.approx(max(f.rv_cc_trail_22[t] - f.bv_trail_22[t], 0))


def test_the_future_does_not_leak_and_targets_ignore_the_past(spark):
    rng = np.random.default_rng(11)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 80)))
    later, earlier = c.copy(), c.copy()
    later[50:] *= 3
    earlier[:50] *= 3
    a, b, e = (features(spark, bars(spark, x, x * 1.01, x * 0.99, x)) for x in (c, later, earlier))
    for name in ("rv_cc_trail_22", "bv_trail_22", "dv_yang_zhang22"):
        assert np.array_equal(a[name][:50], b[name][:50], equal_nan=True)
    assert np.allclose(a.target_rv_22[50:58], e.target_rv_22[50:58], rtol=1e-9)


def test_missing_and_impossible_prices_stay_missing(spark):
    c = [100.0, 101, 0, 103, 104, 105]
    index = X.clean(bars(spark, c, [x + 1 for x in c], [x - 1 for x in c], c))
    f = features(spark, index)
    assert f.ret_cc.isna().tolist() == [True, False, True, True, False, False]
    none = spark.range(1).select(clip(F.lit(None).cast("double"), 0.0).alias("x"), clip(F.lit(-1.0), 0.0, 1.0).alias("y")).first()
    assert none["x"] is None and none["y"] == 0.0


def test_yang_zhang_of_constant_ratios_is_its_range_term(spark):
    n, c = 40, [100.0]
    for _ in range(n - 1):
        c.append(c[-1] * 1.002 * 1.008)
    o = [x / 1.008 for x in c]
    f = features(spark, bars(spark, o, [x * 1.004 for x in c], [x * 0.996 for x in o], c))
    k = 0.34 / (1.34 + 23 / 21)
    assert f.dv_yang_zhang22[39] == pytest.approx((1 - k) * f.dv_rogers_satchell[39], rel=1e-9)


def test_horizons_are_checked():
    for call in (lambda: V.trailing_rv(None, None, 0), lambda: V.forward_rv(None, None, 0), lambda: V.bipower(None, None, None, 1), lambda: V.yang_zhang(None, None, None, None, 1)):
        with pytest.raises(ValueError):
            call()


def test_calendar_keeps_common_days_and_counts_the_rest(spark):
    d = days(6)
    index = bars(spark, *[[100.0] * 5] * 4, dates=d[:5])
    implied = bars(spark, *[[20.0] * 5] * 4, dates=d[1:])
    term = {"vix3m": implied.limit(2)}
    joint = X.joint_calendar(index, implied, term, start=str(d[2]))
    assert joint.count() == 3 and joint.where("vix9d_close is not null").count() == 0
    assert {(r["side"], r["days"]) for r in X.dropped_days(index, implied).collect()} == {("index_only", 1), ("implied_only", 1)}
    check = X.cross_check(index, bars(spark, *[[100.0] * 4 + [101.0]] * 4, dates=d[:5])).first()
    assert (check["days"], check["days_over_20bp"], round(check["max_diff"], 6)) == (5, 1, 0.01)


def codes(issues):
    return {r["code"]: (r["severity"], r["n"]) for r in issues.collect()}


def test_each_rule_fires_on_its_own_corruption(spark):
    d = days(50, "2020-01-01")
    c = np.linspace(3000, 3100, 50)
    o, h, lo = c * 0.999, c * 1.01, c * 0.99
    clean = bars(spark, o, h, lo, c, d)
    assert set(codes(Q.check_index(clean))) == set() and set(codes(Q.check_ohlc(clean, 100, 50000))) == {"open_eq_prevclose", "zero_range_days"}
    assert codes(Q.check_index(clean.unionByName(clean.limit(1))))["dup_dates"] == ("error", 1)
    assert codes(Q.check_index(bars(spark, o, h, lo, c, [dt.date(2020, 3, 14), *d[1:]])))["weekend"] == ("error", 1)
    gap = bars(spark, o[:25], h[:25], lo[:25], c[:25], d[:20] + d[45:])
    assert codes(Q.check_index(gap))["calendar_gap"] == ("error", 1)
    bad_h, bad_c = h.copy(), c.copy()
    bad_h[10], bad_c[20] = lo[10] * 0.5, -1
    got = codes(Q.check_ohlc(bars(spark, o, bad_h, lo, bad_c, d), 100, 50000))
    assert got["high_violated"][0] == "error" and got["nonpositive"] == ("error", 1) and got["range"] == ("warn", 1) and got["low_violated"] == ("error", 1)
    vol = bars(spark, [17, 19.24, 17], [18, 18.57, 18], [16, 17, 16], [17, 18, 17])
    assert codes(Q.check_close(vol, 4, 200)) == {"ohlc_fields_inconsistent": ("warn", 1)}
    negative = spark.createDataFrame([("s", d[0], 1e-4), ("s", d[1], -1e-6)], "series_id string, date date, v double")
    issues = Q.check_variance(negative, ("v",))
    assert codes(issues) == {"negative_v": ("error", 1)}
    with pytest.raises(Q.InvalidData):
        Q.assert_clean(issues)
    unsorted = clean.withColumn("k", F.when(F.col("date") == d[3], 0).otherwise(F.datediff("date", F.lit(d[0])) + 1))
    assert codes(Q.check_index(unsorted, "k"))["unsorted"][0] == "error"


def test_report_and_histogram(spark):
    from tidemark.plans import figures

    d = days(6)
    index, implied = bars(spark, *[[100.0] * 5] * 4, dates=d[:5]), bars(spark, *[[20.0] * 3] * 4, dates=[d[1], d[2], d[5]])
    r = X.alignment_report(index, implied).first()
    assert (r["index_days"], r["implied_days"], r["joint_days"], r["first_day"], r["last_day"]) == (5, 3, 2, d[1], d[2])
    x = np.random.default_rng(1).normal(size=500)
    got = figures.premium_histogram(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "vrp_expost double"), bins=10).orderBy("bin").collect()
    lo, hi = np.quantile(x, [0.005, 0.995])
    counts, edges = np.histogram(np.clip(x, lo, hi), bins=10)
    assert [b["days"] for b in got] == counts.tolist() and [b["low"] for b in got] == pytest.approx(edges[:-1].tolist())
    same = figures.premium_histogram(spark.createDataFrame([(1.0,)] * 3, "vrp_expost double")).collect()
    assert [(b["bin"], b["days"]) for b in same] == [(0, 3)]


def test_every_variance_column_is_checked(spark, monkeypatch):
    spoiled = spark.createDataFrame([("s", dt.date(2020, 1, 1), -1.0, -1.0, -1.0, -1.0)], "series_id string, date date, dv_cc double, dv_parkinson double, dv_garman_klass double, dv_rogers_satchell double")
    monkeypatch.setattr(reference_queries, "table", lambda s, d, name: spoiled)
    assert {r["code"] for r in reference_queries.quality_variance(spark, "").collect()} == {f"negative_dv_{k}" for k in ("cc", "parkinson", "garman_klass", "rogers_satchell")}
