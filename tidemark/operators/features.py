"""From two bar tables to the feature table: calendar join, estimators, trailing windows and forward targets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as V
from tidemark.functions.fold import first_values
from tidemark.functions.nullsafe import finite
from tidemark.params import HORIZONS

PRICES = ("open", "high", "low", "close")


def first_per_day(bars: DataFrame, order: str | None = None, keys: tuple[str, ...] = ("series_id", "date")) -> DataFrame:
    """The first row of each key (by ``order``, then by value), others dropped; folded before the exchange."""
    rest = [c for c in bars.columns if c not in keys and c != order]
    kept = ([order] if order else []) + rest
    return bars.groupBy(*keys).agg(*[x.alias(n) for n, x in first_values(bars, kept, order).items()]).select(*keys, *kept)


def clean(bars: DataFrame) -> DataFrame:
    """Missing markers and prices that cannot be become null."""
    return bars.withColumns({c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c)) for c in PRICES if c in bars.columns})


def joint_calendar(index: DataFrame, implied: DataFrame, term: Mapping[str, DataFrame] | None = None, start: str | None = None) -> DataFrame:
    """Days both tables have; term-structure closes attached without filling. The start date is applied before any lag."""
    bars = index.select("series_id", "date", *[F.col(c).alias(f"spx_{c}") for c in PRICES])
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    out = bars.join(implied.select("series_id", "date", F.col("close").alias("vix_close")), ["series_id", "date"])
    for name in ("vix9d", "vix3m", "vix6m"):
        if term and name in term:
            out = out.join(term[name].select("series_id", "date", F.col("close").alias(f"{name}_close")), ["series_id", "date"], "left")
        else:
            out = out.withColumn(f"{name}_close", F.lit(None).cast("double"))
    return out


def dropped_days(index: DataFrame, implied: DataFrame) -> DataFrame:
    """Days only one of the tables has, counted by series."""
    a, b = index.select("series_id", "date").distinct(), implied.select("series_id", "date").distinct()
    only = a.join(b, ["series_id", "date"], "left_anti").withColumn("side", F.lit("index_only")).unionByName(b.join(a, ["series_id", "date"], "left_anti").withColumn("side", F.lit("implied_only")))
    return only.groupBy("series_id", "side").agg(F.count(F.lit(1)).alias("days"))


def cross_check(index: DataFrame, second: DataFrame) -> DataFrame:
    """Relative close differences of two sources by series: days, median, largest, days over 20 basis points."""
    both = index.select("series_id", "date", "close").join(second.select("series_id", "date", F.col("close").alias("_other")), ["series_id", "date"])
    both = both.withColumn("_d", F.abs(F.col("_other") / F.nullif("close", F.lit(0.0)) - 1)).where(F.col("_d").isNotNull())
    return both.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"), F.percentile("_d", F.lit(0.5)).alias("median_diff"), F.max("_d").alias("max_diff"), F.count_if(F.col("_d") > 0.002).alias("days_over_20bp"))


def build_features(joint: DataFrame) -> DataFrame:
    """The feature table of a joint calendar. All windows share one partitioning and order, hence one exchange and sort."""
    w = V.by_date()
    o, h, lo, c = (F.col(f"spx_{k}") for k in PRICES)
    df = joint.withColumns({"_prev": F.lag(c).over(w), "ret_cc": V.log_return(c, w)})
    df = df.withColumns(
        {
            "dv_cc": F.col("ret_cc") * F.col("ret_cc"),
            "dv_parkinson": V.parkinson(h, lo),
            "dv_garman_klass": V.garman_klass(o, h, lo, c),
            "dv_rogers_satchell": V.rogers_satchell(o, h, lo, c),
            "_overnight": V.positive_log(V.ratio(o, F.col("_prev"))),
            "_day": V.positive_log(V.ratio(c, o)),
            "_ret1": F.lag("ret_cc").over(w),
            "spx_open_synthetic": F.coalesce(F.bround(o, 4) == F.bround("_prev", 4), F.lit(False)),
        }
    )
    rolled = {"dv_yang_zhang22": V.yang_zhang(F.col("_overnight"), F.col("_day"), F.col("dv_rogers_satchell"), w)}
    for n in HORIZONS:
        for short, dv in (("cc", "dv_cc"), ("gk", "dv_garman_klass"), ("pk", "dv_parkinson")):
            rolled[f"rv_{short}_trail_{n}"] = V.trailing_rv(F.col(dv), w, n)
        rolled[f"target_rv_{n}"] = V.forward_rv(F.col("dv_cc"), w, n)
    for n in (5, 22):
        rolled[f"bv_trail_{n}"] = V.bipower(F.col("ret_cc"), F.col("_ret1"), w, n)
    df = df.withColumns(rolled)
    square = lambda name: F.col(name) / 100 * (F.col(name) / 100)
    last = {f"jump_{n}": V.jump(F.col(f"rv_cc_trail_{n}"), F.col(f"bv_trail_{n}")) for n in (5, 22)}
    last |= {iv: square(name) for iv, name in (("iv30", "vix_close"), ("iv9d", "vix9d_close"), ("iv3m", "vix3m_close"), ("iv6m", "vix6m_close"))}
    df = df.withColumns(last).withColumn("vrp_expost", F.col("iv30") - F.col("target_rv_22"))
    return df.drop("_prev", "_overnight", "_day", "_ret1")


def vrp_summary(features: DataFrame) -> DataFrame:
    """Premium by decade and over all rows, by one pass over grouping sets."""
    d = features.where(F.col("iv30").isNotNull() & F.col("target_rv_22").isNotNull())
    d = d.withColumn("decade", F.concat((F.floor(F.year("date") / 10) * 10).cast("string"), F.lit("s")))
    out = d.groupingSets([["decade"], []], "decade").agg(
        F.grouping("decade").alias("_all"),
        F.count(F.lit(1)).alias("days"),
        F.avg("vix_close").alias("mean_iv_points"),
        F.avg(F.sqrt("target_rv_22") * 100).alias("mean_fwd_vol_points"),
        F.avg("iv30").alias("mean_iv"),
        F.avg("target_rv_22").alias("mean_fwd_rv"),
        F.avg("vrp_expost").alias("mean_vrp"),
        F.avg((F.col("vrp_expost") > 0).cast("int")).alias("share_positive"),
    )
    return out.select(F.when(F.col("_all") == 1, "full sample").otherwise(F.col("decade")).alias("period"), *[c for c in out.columns if c not in ("decade", "_all")])


def estimator_table(features: DataFrame, since: str = "2008-01-01") -> DataFrame:
    """Annualised volatility of each estimator, in all and since a date, and correlation of its 22-day sums with those of dv_cc, which restart there."""
    names = {"dv_cc": "cc", "dv_parkinson": "parkinson", "dv_garman_klass": "garman_klass", "dv_rogers_satchell": "rogers_satchell", "dv_yang_zhang22": "yang_zhang"}
    d = features.select("series_id", "date", *names).na.drop(subset=list(names))
    late = d.where(F.col("date") >= F.lit(since).cast("date"))
    frame = V.by_date().rowsBetween(-21, 0)
    late = late.withColumns({f"_s_{n}": V.full(F.sum, F.col(n), frame, 22) for n in names})
    vol = lambda n: F.sqrt(F.avg(n) * 252) * 100
    first = d.agg(*[vol(n).alias(n) for n in names]).select(F.inline(F.array(*[F.struct(F.lit(v).alias("estimator"), F.col(n).alias("vol_full")) for n, v in names.items()])))
    second = late.agg(*[vol(n).alias(n) for n in names], *[F.corr(f"_s_{n}", "_s_dv_cc").alias(f"r_{n}") for n in names])
    second = second.select(F.inline(F.array(*[F.struct(F.lit(v).alias("estimator"), F.col(n).alias("vol_since"), F.col(f"r_{n}").alias("corr_cc")) for n, v in names.items()])))
    return first.join(second, "estimator")


def synthetic_open_share(features: DataFrame) -> DataFrame:
    return features.groupBy(F.year("date").alias("year")).agg(F.avg(F.col("spx_open_synthetic").cast("int")).alias("share_synthetic"))


def alignment_report(index: DataFrame, implied: DataFrame) -> DataFrame:
    """``index_days, implied_days, joint_days, first_day, last_day`` by series; series of one table only have no joint days."""
    a, b = (t.select("series_id", "date").distinct().withColumn(name, F.lit(1)) for t, name in ((index, "_a"), (implied, "_b")))
    days = a.join(b, ["series_id", "date"], "full_outer")
    both = F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.col("date"))
    return days.groupBy("series_id").agg(F.count("_a").alias("index_days"), F.count("_b").alias("implied_days"), F.count(both).alias("joint_days"), F.min(both).alias("first_day"), F.max(both).alias("last_day"))
