"""Queries that go through files and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.backtest import strategies as B
from tidemark.forecast import baselines, protocol
from tidemark.forecast.panel import common_models
from tidemark.functions.nullsafe import finite
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.plans import reference_oracles as O
from tidemark.plans.market import PROTOCOL, asset_bars, asset_features, asset_volatility, series_bars
from tidemark.plans.reference_queries import _weights, market, tidy
from tidemark.session import cut_lineage, scratch_folder, table
from tidemark.sources import files


def _written(spark: SparkSession, bars: DataFrame, name: str, order: str) -> str:
    """A folder with one CSV file for each series, rows in ``order``."""
    path = scratch_folder(spark, name)
    bars.repartition("series_id").sortWithinPartitions("series_id", order).drop(order).write.partitionBy("series_id").csv(path, header=True)
    return path


def _rounded(c: str, digits: int = 8):
    """SQL's ``round`` of a positive price: half away from zero on the binary product; Spark's, on the decimal text, differs where that text is a tie."""
    x, scale = F.col(c), 10.0**digits
    y = x * scale
    whole = F.rint(y)
    return F.when(y < float("inf"), F.when(y - whole == 0.5, whole + 1).otherwise(whole) / scale).otherwise(x).alias(c)


def source_bars(s: SparkSession, d: str) -> DataFrame:
    """Index, volatility and second-source bars written as CSV files, one for each series, and read back by their loaders."""
    parts = []
    readers = {"gspc": (files.read_index_bars, ("adj_close", "volume")), "vix": (files.read_vol_index, ()), "spx_stooq": (files.read_second_source, ("volume",))}
    for name, (read, more) in readers.items():
        # Behind a letter, as a folder's name cannot tell an empty series from a missing one.
        bars = table(s, d, name).where(F.col("date").isNotNull()).select(F.concat(F.lit("s"), "series_id").alias("series_id"), "date", "open", "high", "low", "close", *more, "bar_id")
        found = read(s, _written(s, bars, name, "bar_id"))
        parts.append(X.clean(found).select(F.lit(name).alias("table_name"), F.expr("substring(series_id, 2)").alias("series_id"), F.col("date").cast("string").alias("date"), *[_rounded(c) for c in files.OHLC]))
    absent = files.read_optional_vol_index(s, scratch_folder(s, "absent"), "none")
    assert absent is None
    return baselines.union(parts)


def source_charts(s: SparkSession, d: str) -> DataFrame:
    """The bars of each gspc series packed into a chart document and parsed again."""
    names = ("open", "high", "low", "close", "adj_close", "volume")
    first = X.first_per_day(table(s, d, "gspc").where(F.col("date").isNotNull()).select("series_id", "date", "bar_id", *names), "bar_id")
    bars = first.select("series_id", F.unix_timestamp("date").alias("t"), *[F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c)).alias(c) for c in names])
    days = bars.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", *names))).alias("days"))  # bounded by the calendar
    column = lambda c: F.transform("days", lambda x: x[c])
    quote = F.struct(*[column(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(F.struct(F.col("series_id").alias("symbol")).alias("meta"), column("t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(column("adj_close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    return tidy(files.chart_rows(days.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))))


def source_manifest(s: SparkSession, d: str) -> DataFrame:
    """Manifest of the raw files, put together from their lines."""
    lines = table(s, d, "raw_lines").groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "raw_line"))).alias("lines"))  # a file each
    content = F.encode(F.concat(F.array_join(F.transform("lines", lambda x: F.coalesce(x["raw_line"], F.lit(""))), "\n"), F.lit("\n")), "UTF-8")
    found = lines.select(F.concat(F.lit("/"), "file_name").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return files.manifest_of(found).withColumn("data_rows", F.col("data_rows").cast("long"))


def pipeline_from_files(s: SparkSession, d: str) -> DataFrame:
    """The whole chain: price files, checks, calendar, features, strategies, simulation, figures; as ``perf_summary`` from tables."""
    bars = asset_bars(s, d).withColumns({"adj_close": F.col("close"), "volume": F.lit(0.0), "_n": F.col("date")})
    vols = asset_volatility(s, d).select("series_id", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.col("date").alias("_n"))
    index = files.read_index_bars(s, f"{_written(s, bars, 'index', '_n')}/series_id=asset", "asset")
    implied = files.read_vol_index(s, f"{_written(s, vols, 'implied', '_n')}/series_id=asset", "asset")
    Q.assert_clean(Q.check_ohlc(index, 1, 1e9).unionByName(Q.check_close(implied, 1, 1e3)))
    features = cut_lineage(X.build_features(X.joint_calendar(index, implied)))
    Q.assert_clean(Q.check_variance(features, ("dv_cc", "dv_parkinson")))
    p = B.Backtest()
    sims = B.simulate(B.with_scale(_weights(features), B.unit_pnl(features), p), [p.half_spread], p)
    return market(B.performance(sims, "pnl_net"), 6)


def panel_union(s: SparkSession, d: str) -> DataFrame:
    """Development and holdout panels cut to the models they share and put together, the first panel's rows before the second's."""
    features = cut_lineage(asset_features(s, d))
    rows = protocol.guarded(protocol.dev_rows(features, 22, PROTOCOL), PROTOCOL)
    dev = baselines.union([baselines.random_walk(features, (22,)), baselines.implied(features, (22,))]).join(rows.select("series_id", "date"), ["series_id", "date"])
    later = baselines.union([baselines.random_walk(features, (22,)), baselines.expanding_mean(features, horizons=(22,))]).where(F.col("date") > "1999-06-30").withColumn("forecast", F.col("forecast") + 1)
    return tidy(baselines.keep_first(list(common_models(dev, later))))


def term_structure(s: SparkSession, d: str) -> DataFrame:
    """Term-structure closes attached where they are there: opens and highs of the volatility bars stand for other maturities, Januaries are missing."""
    vix = series_bars(s, d, "vix")
    part = vix.where(F.month("date") != 1)
    term = {"vix9d": part.withColumn("close", F.col("open")), "vix3m": part.withColumn("close", F.col("high"))}
    out = X.build_features(X.joint_calendar(series_bars(s, d, "gspc"), vix, term))
    return tidy(out.select("series_id", "date", "vix9d_close", "vix3m_close", "vix6m_close", "iv9d", "iv3m", "iv6m"))


def quality_variance_gap(s: SparkSession, d: str) -> DataFrame:
    """The rule for variances on a column that breaks it: close-to-close less range-based variance."""
    gap = table(s, d, "features").withColumn("dv_gap", F.col("dv_cc") - F.when(~F.isnan("dv_parkinson"), F.col("dv_parkinson")))
    return Q.check_variance(gap.select("series_id", "date", "dv_gap"), ("dv_gap",)).withColumn("examples", F.concat_ws(",", "examples"))


QUERIES = {f.__name__: f for f in (source_bars, source_charts, source_manifest, pipeline_from_files, panel_union, term_structure, quality_variance_gap)}


def _first(name: str, source: str) -> str:
    return O._bars(name, source)


_PRESENT = lambda c: f"CASE WHEN NOT isnan(b.{c}) AND NOT isinf(b.{c}) AND b.{c} > 0 THEN b.{c} END"
_ROUND4 = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close"

ORACLES = {
    "source_bars": f"WITH {_first('g', 'gspc')}, {_first('v', 'vix')}, {_first('o', 'spx_stooq')} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, series_id, CAST(date AS VARCHAR) AS date, {_ROUND4} FROM {t}" for n, t in (("gspc", "g"), ("vix", "v"), ("spx_stooq", "o"))),
    "source_charts": f"""WITH f AS (SELECT series_id, date, arg_min({{'open': open, 'high': high, 'low': low, 'close': close, 'adj_close': adj_close, 'volume': volume}}, bar_id) AS b FROM gspc WHERE date IS NOT NULL GROUP BY series_id, date),
c AS (SELECT series_id, date, {", ".join(f"{_PRESENT(c)} AS {c}" for c in ("open", "high", "low", "close", "adj_close", "volume"))} FROM f)
SELECT series_id, CAST(date AS VARCHAR) AS date, {_ROUND4}, round(coalesce(adj_close, close), 8) AS adj_close, round(coalesce(volume, 0), 8) + 0.0::DOUBLE AS volume FROM c WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
    "source_manifest": """WITH f AS (SELECT file_name AS file, string_agg(coalesce(raw_line, ''), chr(10) ORDER BY line_no, line_id) || chr(10) AS content FROM raw_lines GROUP BY file_name),
l AS (SELECT *, list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS kept FROM f)
SELECT file, octet_length(encode(content)) AS bytes, sha256(content) AS sha256, greatest(len(kept) - 1, 0) AS data_rows, CASE WHEN len(kept) > 1 THEN split_part(kept[2], ',', 1) END AS first_date, CASE WHEN len(kept) > 1 THEN split_part(kept[-1], ',', 1) END AS last_date,
  octet_length(encode(content)) >= 200 AND NOT coalesce(regexp_matches(lower(kept[1]), '^\\s*<(!doctype|html)'), false) AS accepted FROM l""",
    "pipeline_from_files": O.ORACLES["perf_summary"],
    "panel_union": f"{O._NUMBERED} SELECT series_id, CAST(feat.date AS VARCHAR) AS date, 22 AS horizon, 'random_walk' AS model, round(CASE WHEN EXISTS (SELECT 1 FROM dev WHERE dev.date = feat.date) THEN rv_cc_trail_22 ELSE rv_cc_trail_22 + 1 END, 8) AS forecast FROM feat WHERE date > DATE '1999-06-30' OR EXISTS (SELECT 1 FROM dev WHERE dev.date = feat.date)",
    "term_structure": f"""WITH {O._SERIES} SELECT g.series_id, CAST(g.date AS VARCHAR) AS date, round(n.open, 8) AS vix9d_close, round(n.high, 8) AS vix3m_close, CAST(NULL AS DOUBLE) AS vix6m_close, round(n.open / 100 * (n.open / 100), 8) AS iv9d, round(n.high / 100 * (n.high / 100), 8) AS iv3m, CAST(NULL AS DOUBLE) AS iv6m
FROM g JOIN v ON g.series_id = v.series_id AND g.date = v.date LEFT JOIN (SELECT * FROM v WHERE month(date) <> 1) n ON g.series_id = n.series_id AND g.date = n.date""",
    "quality_variance_gap": O._issues("WITH flagged AS (SELECT series_id, date, dv_cc - CASE WHEN NOT isnan(dv_parkinson) THEN dv_parkinson END AS dv_gap FROM features)", [("negative_dv_gap", "error", "dv_gap < -1e-9")]),
}
