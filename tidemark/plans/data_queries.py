"""The general training-data queries, each over its whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.diff import diff_copies
from tidemark.operators.profile import load_shifts, out_of_line, profile_loads
from tidemark.operators.rejects import read_lines, typed_rows
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.spikes import Reading, SpikeRules, flag_spikes, tail_cutoffs
from tidemark.session import table

GSPC = SpikeRules(fields=(Reading("open"), Reading("low", above=("open", "close"))))
VIX = SpikeRules(fields=(Reading("open"), Reading("high", below=("open", "close"))))
_INDEX = ("open", "high", "low", "close", "adj_close", "volume")
ROLLED = ("dv_cc", "rv_cc_trail_22", "target_rv_22")
SHIFTED = ("dv_parkinson", "spx_open_synthetic", "vrp_expost")


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every implausible reading with its reasons."""
    parts = [flag_spikes(table(spark, folder, name), rules).select(F.lit(name).alias("table_name"), "*") for name, rules in (("gspc", GSPC), ("vix", VIX))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_flags(spark, folder).select("table_name", F.col("row_id").alias("bar_id"), "field")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings each rule finds."""
    return p1_flags(spark, folder).select("table_name", "field", F.explode("reasons").alias("reason")).groupBy("table_name", "field", "reason").agg(F.count(F.lit(1)).alias("readings"))


def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted tail of each series and field of gspc: residuals, those beyond the cutoff, cutoff and typical change."""
    scored = tail_cutoffs(table(spark, folder, "gspc"), GSPC)
    return scored.groupBy("series_id", "field").agg(
        F.count("residual").alias("residuals"), F.count_if(F.abs("residual") > F.col("cutoff")).alias("beyond"), F.round(F.max("cutoff"), 8).alias("cutoff"), F.round(F.max("typical"), 8).alias("typical_change")
    )


def p1_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Spikes of gspc by the tail alone, at a risk of one in ten thousand, without the exact check that ``p1_found`` adds."""
    rules = replace(GSPC, multiple=None, risk=0.0001)
    spikes = flag_spikes(table(spark, folder, "gspc"), rules).where(F.array_contains("reasons", "spike"))
    return spikes.select(F.col("row_id").alias("bar_id"), "field")


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    out = rolling_totals(table(spark, folder, "features"), ROLLED)
    numbers = [c for c in out.columns if c.startswith(("total_", "avg_"))]
    return out.drop("first_day").withColumns({c: F.round(c, 8) for c in numbers}).withColumn("day", F.col("day").cast("string"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rolled = rolling_totals(table(spark, folder, "features"), ROLLED).where(F.datediff("day", "first_day") >= 29)
    burst = (F.col("total_dv_cc_30") > 0) & (F.col("total_dv_cc_7") > 0.65 * F.col("total_dv_cc_30"))
    raised = [F.when((F.col(f"n_{v}_7") > 0) & (F.col(f"avg_{v}_7") > 1.6 * F.col(f"avg_{v}_30")), F.lit(v)) for v in ROLLED[1:]]
    fields = F.array_compact(F.array(F.when(burst, F.lit("dv_cc")), *raised))
    return rolled.select("series_id", F.col("day").cast("string").alias("day"), F.explode(fields).alias("field"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(table(spark, folder, "raw_lines"), {"date": "date", "close": "number"})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where(F.col("reason").isNotNull()).select("line_id", "reason")


def _bars(spark: SparkSession, folder: str, kind: str, numbers: tuple[str, ...]) -> DataFrame:
    bars = typed_rows(_lines(spark, folder).where(F.col("file_name").startswith(f"{kind}_")), {"date": "date"} | dict.fromkeys(numbers, "number"))
    return bars.withColumn("series_id", F.regexp_extract("file_name", r"^[a-z]+_(.*)\.csv$", 1)).drop("file_name")


def p3_gspc(spark: SparkSession, folder: str) -> DataFrame:
    """The valid gspc bars, typed."""
    return _bars(spark, folder, "gspc", _INDEX).drop("invalid")


def p3_vix(spark: SparkSession, folder: str) -> DataFrame:
    """The valid vix bars, typed."""
    return _bars(spark, folder, "vix", _INDEX[:4]).drop("invalid")


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    patterns = {"series_id": "^[a-z]{3}-[0-9]{8}$", "symbol": "^[A-Z]{3}$"}
    features = table(spark, folder, "features")
    numbers = [n for n, t in features.dtypes if t in ("double", "bigint", "int")]
    out = profile_loads(features, patterns=patterns).withColumn("median_abs", F.round("median_abs", 10))
    # Numbers as numbers: how they are spelt is not compared.
    ends = {f"{end}_number": F.when(F.col("column_name").isin(numbers), F.round(F.col(f"{end}_value").try_cast("double"), 10)) for end in ("min", "max")}
    texts = {f"{end}_value": F.when(~F.col("column_name").isin(numbers), F.col(f"{end}_value")) for end in ("min", "max")}
    return out.withColumns(ends).withColumns(texts)


def p4_shifts(spark: SparkSession, folder: str) -> DataFrame:
    return load_shifts(table(spark, folder, "features"), SHIFTED)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return out_of_line(table(spark, folder, "features"), SHIFTED, unsigned=("dv_parkinson",)).select("load_id", "column_name")


def _copies(spark: SparkSession, folder: str, fields: tuple[str, ...]) -> DataFrame:
    left, right = table(spark, folder, "gspc"), table(spark, folder, "spx_stooq")
    return diff_copies(left, right, ["series_id", "date"], fields, tolerance=dict.fromkeys(fields, 0.01), tie="bar_id")


def p5_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every differing field of the keys both copies have."""
    changed = _copies(spark, folder, ("open", "high", "low", "close", "volume")).where(F.col("kind") == "changed")
    return changed.select("series_id", F.col("date").cast("string").alias("day"), F.inline("differences")).withColumns({c: F.col(c).cast("double") for c in ("left_value", "right_value")})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("kind") == "left_only", "gspc_only").when(F.col("kind") == "right_only", "stooq_only").otherwise("close")
    return _copies(spark, folder, ("close",)).select("series_id", F.col("date").cast("string").alias("day"), kind.alias("kind"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_cutoffs, p1_tail, p2_found, p2_rolling, p3_found, p3_gspc, p3_vix, p4_found, p4_profile, p4_shifts, p5_found, p5_fields)}
