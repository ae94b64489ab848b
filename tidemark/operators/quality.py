"""Validation rules over bar tables, as rows of (series_id, severity, code, n, examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date

EPSILON = 1e-9


class InvalidData(ValueError):
    """Rules of severity error were violated."""


def _issues(flagged: DataFrame, rules: dict[str, tuple[str, Column]], by: list[str]) -> DataFrame:
    """Counts and up to three earliest days of each violated rule; only counters and three-element lists meet."""
    cells = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for code, (severity, cond) in rules.items()])
    hits = flagged.select(*by, "date", F.explode(F.array_compact(cells)).alias("_i")).select(*by, "date", "_i.severity", "_i.code")
    earliest = F.row_number().over(by_date(*by, "severity", "code"))
    counted = hits.groupBy(*by, "severity", "code").agg(F.count(F.lit(1)).alias("n"))
    shown = hits.withColumn("_k", earliest).where(F.col("_k") <= 3).groupBy(*by, "severity", "code").agg(F.array_sort(F.collect_list(F.col("date").cast("string"))).alias("examples"))
    return counted.join(shown, [*by, "severity", "code"])


def check_index(bars: DataFrame, order: str | None = None) -> DataFrame:
    """dup_dates, unsorted (against the ingest order, if given), weekend and calendar_gap (over three business days; error if one is over ten)."""
    w = by_date()
    days = bars.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("_copies"))
    previous = F.lag("date").over(w)
    gap = F.size(F.filter(F.sequence(previous, F.date_sub("date", 1)), lambda d: F.weekday(d) < 5))
    days = days.withColumn("_gap", F.when(previous < F.col("date"), gap).otherwise(0))
    out = _issues(days, {"dup_dates": ("error", F.col("_copies") > 1), "weekend": ("error", F.weekday("date") >= 5), "calendar_gap": ("warn", F.col("_gap") > 3), "_gap10": ("error", F.col("_gap") > 10)}, ["series_id"])
    wide = out.where(F.col("code") == "_gap10").select("series_id", F.lit("calendar_gap").alias("code"), F.lit("error").alias("_worse"))
    out = out.where(F.col("code") != "_gap10").join(wide, ["series_id", "code"], "left").withColumn("severity", F.coalesce("_worse", "severity")).select("series_id", "severity", "code", "n", "examples")
    if order:
        from pyspark.sql import Window

        earlier = F.lag("date").over(Window.partitionBy("series_id").orderBy(order))
        out = out.unionByName(_issues(bars.withColumn("_back", earlier > F.col("date")), {"unsorted": ("error", F.col("_back"))}, ["series_id"]))
    return out


def check_ohlc(bars: DataFrame, low_bound: float, high_bound: float) -> DataFrame:
    """nonpositive, high_violated, low_violated (errors), range and wild_return (warnings), shares of open == previous close and of zero range (info, n in ten-thousandths)."""
    w = by_date()
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    before = F.lag("close").over(w)
    flagged = bars.select("series_id", "date", "open", "high", "low", "close", before.alias("_before"))
    change = F.when((c > 0) & (F.col("_before") > 0), F.abs(F.ln(c / F.col("_before"))))
    rules = {
        "nonpositive": ("error", (F.least(o, h, lo, c) <= 0)),
        "high_violated": ("error", (h + EPSILON < o) | (h + EPSILON < c) | (h + EPSILON < lo)),
        "low_violated": ("error", (lo - EPSILON > o) | (lo - EPSILON > c)),
        "range": ("warn", (c < low_bound) | (c > high_bound)),
        "wild_return": ("warn", change > 0.35),
    }
    shares = flagged.groupBy("series_id").agg(
        F.avg(F.coalesce(F.bround(o, 4) == F.bround("_before", 4), F.lit(False)).cast("int")).alias("open_eq_prevclose"),
        F.avg(F.coalesce(F.bround(h, 6) == F.bround(lo, 6), F.lit(False)).cast("int")).alias("zero_range_days"),
    )
    info = shares.select("series_id", F.inline(F.array(*[F.struct(F.lit("info").alias("severity"), F.lit(k).alias("code"), F.round(F.col(k) * 10000).cast("long").alias("n")) for k in ("open_eq_prevclose", "zero_range_days")])), F.array().cast("array<string>").alias("examples"))
    return _issues(flagged, rules, ["series_id"]).unionByName(info)


def check_close(bars: DataFrame, low_bound: float, high_bound: float) -> DataFrame:
    """nonpositive (error) and range (warning) of the close; inconsistent other fields are a warning only."""
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    rules = {
        "nonpositive": ("error", c <= 0),
        "range": ("warn", (c < low_bound) | (c > high_bound)),
        "ohlc_fields_inconsistent": ("warn", (h + EPSILON < o) | (h + EPSILON < c) | (h + EPSILON < lo) | (lo - EPSILON > o) | (lo - EPSILON > c)),
    }
    return _issues(bars, rules, ["series_id"])


def check_variance(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return _issues(features, {f"negative_{c}": ("error", F.col(c) < -EPSILON) for c in columns}, ["series_id"])


def assert_clean(issues: DataFrame, show: int = 20) -> None:
    """Raise if any issue is an error; at most ``show`` of them are read."""
    errors = issues.where(F.col("severity") == "error").orderBy("series_id", "code").limit(show).collect()
    if errors:
        raise InvalidData("\n".join(f"{r['series_id']} {r['code']}: {r['n']} rows, e.g. {', '.join(r['examples'])}" for r in errors))


def report(issues: DataFrame) -> DataFrame:
    """Issues, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return issues.orderBy(rank, "series_id", "code")
