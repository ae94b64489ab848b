"""Files in and out: price CSVs, charts in JSON, feature and forecast tables, manifests, small tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.features import first_per_day

OHLC = ("open", "high", "low", "close")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _series_files(spark: SparkSession, path: str, columns: tuple[str, ...], text: dict[str, bool]) -> DataFrame:
    """All files of a folder of ``series_id=...`` folders in one scan; a file whose header is not the first one's makes the read fail."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, shown = (system.globStatus(at(at(path), x)) for x in ("series_id=*", "[^_.]*"))  # by the JVM: a call a file would be slow
    if system.getFileStatus(at(path)).isFile() or len(found) < len(shown):
        raise ValueError(f"{path} holds other than folders of series")
    name = StructField("series_id", StringType())  # given, as a name like 007 would else become a number
    if not len(found):
        return spark.createDataFrame([], StructType([*[StructField(c, StringType()) for c in columns], name]))
    header = spark.read.csv(found[0].getPath().toString(), **text).schema
    return spark.read.csv(path, schema=StructType([*[f for f in header if f.name != name.name], name]), enforceSchema=False, **text)


def _day(c: str):
    text = F.trim(F.col(c))
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def _prices(spark: SparkSession, path: str, series_id: str | None, wanted: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """Header names are trimmed and lower-cased; the first row of a day, in file order, is kept.

    Without ``series_id`` the path is a folder of ``series_id=...`` folders with a file each: one scan, whose plan does not grow with their number.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    text = {"header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if series_id is None:
        raw = _series_files(spark, path, ("date", *wanted), text)
    else:
        raw = spark.read.csv(path, inferSchema=False, **text)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns]).withColumn("_order", F.monotonically_increasing_id())
    missing = [c for c in ("date", *required) if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    kept = [c for c in wanted if c in raw.columns]
    series = F.col("series_id") if series_id is None else F.lit(series_id)
    typed = raw.select(series.alias("series_id"), _day("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in kept], "_order").where(F.col("date").isNotNull())
    return first_per_day(typed, "_order").drop("_order")


def read_vol_index(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """CSV with date (month/day/year or ISO), open, high, low, close. A missing file raises."""
    return _prices(spark, path, series_id, OHLC, OHLC)


def read_index_bars(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """CSV with ISO date, open, high, low, close, adj_close, volume. A missing file raises."""
    names = (*OHLC, "adj_close", "volume")
    return _prices(spark, path, series_id, names, names)


def read_second_source(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame | None:
    """CSV with whichever of open, high, low, close, volume it has; None if the file is absent."""
    return _prices(spark, path, series_id, (*OHLC, "volume"), ()) if _exists(spark, path) else None


def read_optional_vol_index(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame | None:
    return read_vol_index(spark, path, series_id) if _exists(spark, path) else None


def chart_rows(charts: DataFrame, json: str = "payload") -> DataFrame:
    """Daily rows of chart documents: epoch to date; rows with a missing price skipped, never filled; adjusted close falls back to close, volume to zero."""
    quote = "array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>"
    schema = f"chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<quote:{quote},adjclose:array<struct<adjclose:array<double>>>>>>>"
    r = charts.select(F.explode(F.from_json(json, schema)["chart"]["result"]).alias("r"))
    q = "r.indicators.quote"
    flat = r.select(F.col("r.meta.symbol").alias("series_id"), F.posexplode("r.timestamp").alias("_i", "_t"), F.col(q)[0].alias("_q"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("_a"))
    at = lambda x: F.try_element_at(x, F.col("_i") + 1)
    rows = flat.select("series_id", F.to_date(F.timestamp_seconds("_t")).alias("date"), *[at(F.col(f"_q.{c}")).alias(c) for c in OHLC], at(F.col("_a")).alias("_adj"), at(F.col("_q.volume")).alias("_volume"))
    rows = rows.na.drop(subset=list(OHLC))
    return rows.select("series_id", "date", *OHLC, F.coalesce("_adj", "close").alias("adj_close"), F.coalesce("_volume", F.lit(0.0)).alias("volume"))


def manifest(spark: SparkSession, folder: str, least_bytes: int = 200) -> DataFrame:
    """``file, bytes, sha256, data_rows, first_date, last_date, accepted``; too short files and web pages are not accepted."""
    return manifest_of(spark.read.format("binaryFile").load(os.path.join(folder, "*.csv")), least_bytes)


def manifest_of(files: DataFrame, least_bytes: int = 200) -> DataFrame:
    """The manifest of files given as ``path, length, content``; each file is one row, so files are of a size a task can hold."""
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\r?\n"), lambda x: F.trim(x) != "")
    files = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("_lines"))
    token = lambda i: F.split(F.try_element_at("_lines", F.lit(i)), ",")[0]
    size = F.size("_lines")
    page = F.lower(F.coalesce(F.try_element_at("_lines", F.lit(1)), F.lit(""))).rlike("^\\s*<(!doctype|html)")
    return files.select(
        "file", "bytes", "sha256", F.greatest(size - 1, F.lit(0)).alias("data_rows"), F.when(size > 1, token(2)).alias("first_date"), F.when(size > 1, token(-1)).alias("last_date"),
        ((F.col("bytes") >= least_bytes) & ~page).alias("accepted"),
    )


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """Overwrite ``path``; with partitions only those that ``df`` holds."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache that may not exist yet."""
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, decimals: int = 4, most: int = 100_000) -> None:
    """A small report, rounded, as one CSV file; more than ``most`` rows are refused rather than written by one task."""
    rounded = df.select(*[F.bround(f.name, decimals).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
    if rounded.limit(most + 1).count() > most:
        raise ValueError(f"a report has at most {most} rows")
    rounded.coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_markdown(df: DataFrame, decimals: int = 4, most: int = 1000) -> str:
    """A small report as a Markdown table; more than ``most`` rows are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{round(v, decimals):g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])
