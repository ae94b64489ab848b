import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import source_queries
from tidemark.sources import files
from tidemark.streaming.bars import daily_bars


def test_price_files(spark, tmp_path):
    vol = tmp_path / "vol.csv"
    vol.write_text(" DATE,OPEN,HIGH,LOW,CLOSE\n01/03/1990,17,18,16,17.5\n1990-01-02,16,17,15,16.5\n01/04/1990,18,19,17,18.5\n01/04/1990,9,9,9,9\n")
    got = [(str(r["date"]), r["close"]) for r in files.read_vol_index(spark, str(vol), "v").orderBy("date").collect()]
    assert got == [("1990-01-02", 16.5), ("1990-01-03", 17.5), ("1990-01-04", 18.5)]
    index = tmp_path / "index.csv"
    index.write_text("date,open,high,low,close,adj_close,volume\n2020-01-02,1,2,0.5,1.5,1.4,100\n2020-01-03,x,2,0.5,1.5,,100\n")
    rows = files.read_index_bars(spark, str(index), "i").orderBy("date").collect()
    assert (rows[0]["adj_close"], rows[1]["open"], rows[1]["adj_close"]) == (1.4, None, None)
    second = tmp_path / "second.csv"
    second.write_text("Date,Open,Close\n2020-01-02,1,2\n")
    assert files.read_second_source(spark, str(second), "s").columns == ["series_id", "date", "open", "close"]
    assert files.read_second_source(spark, str(tmp_path / "none.csv"), "s") is None
    assert files.read_optional_vol_index(spark, str(tmp_path / "none.csv"), "s") is None
    with pytest.raises(FileNotFoundError):
        files.read_vol_index(spark, str(tmp_path / "none.csv"), "s")
    with pytest.raises(ValueError):
        files.read_index_bars(spark, str(second), "s")


def test_a_folder_of_series_is_one_scan(spark, tmp_path):
    for name, lines in (("007", "01/03/1990,17,18,16,17.5\n1990-01-02,16,17,15,16.5\n01/03/1990,9,9,9,9\n"), ("2020-01-01", "01/03/1990,1,2,1,x\n"), ("a%2Fb", "1990-01-02,3,4,2,3\n"), ("empty", "")):
        (tmp_path / f"series_id={name}").mkdir()
        (tmp_path / f"series_id={name}" / "v.csv").write_text(f" DATE,OPEN,HIGH,LOW,CLOSE\n{lines}")
    df = files.read_vol_index(spark, str(tmp_path))
    assert {(r["series_id"], str(r["date"]), r["close"]) for r in df.collect()} == {("007", "1990-01-02", 16.5), ("007", "1990-01-03", 17.5), ("2020-01-01", "1990-01-03", None), ("a/b", "1990-01-02", 3.0)}
    with pytest.raises(ValueError):
        files.read_index_bars(spark, str(tmp_path))
    (tmp_path / "series_id=other").mkdir()
    (tmp_path / "series_id=other" / "v.csv").write_text("DATE,CLOSE,HIGH,LOW,OPEN\n1990-01-02,1,2,3,4\n")
    with pytest.raises(Exception, match="header"):
        files.read_vol_index(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        files.read_vol_index(spark, str(tmp_path / "series_id=other"))
    with pytest.raises(ValueError):
        files.read_vol_index(spark, str(tmp_path / "series_id=other" / "v.csv"))
    (tmp_path / "none").mkdir()
    assert files.read_vol_index(spark, str(tmp_path / "none")).collect() == []


def _bar_tables(spark, folder, names):
    bars = [(i, n, f"2020-01-{day:02d}", 4787.46, p, 4760.36, 4797.791086615, 1.0, None) for i, (n, day, p) in enumerate((n, day, p) for n in names for day, p in ((3, 9.5), (2, None), (3, 8.5), (6, float("nan")), (7, -1.0)))]
    df = spark.createDataFrame(bars, "bar_id long, series_id string, date string, open double, high double, low double, close double, adj_close double, volume double").withColumn("date", F.to_date("date"))
    for name, gone in (("gspc", ()), ("vix", ("adj_close", "volume")), ("spx_stooq", ("adj_close",))):
        df.drop(*gone).write.parquet(f"{folder}/{name}.parquet")


def test_the_plan_of_source_bars_does_not_grow_with_the_series(spark, tmp_path):
    _bar_tables(spark, tmp_path, [f"s-{i}" for i in range(8)])
    df = source_queries.source_bars(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert df.count() == 3 * 8 * 4


def test_source_bars_agree_with_their_sql_on_odd_names_and_ties(spark, tmp_path):
    _bar_tables(spark, tmp_path, ["007", "7", "a/b", "x=%41:y", "None", None, "", " padded ", "__HIVE_DEFAULT_PARTITION__"])
    con = duckdb.connect()
    for name in ("gspc", "vix", "spx_stooq"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, source_queries.source_bars(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.execute(source_queries.ORACLES["source_bars"]).fetchall())) and len(got) == 3 * 9 * 4


def test_charts_manifest_and_reports(spark, tmp_path):
    chart = {"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [86400, 172800, 259200], "indicators": {"quote": [{"open": [1, None, 3], "high": [2, 2, 4], "low": [1, 1, 2], "close": [1.5, 1.5, 3.5], "volume": [7, 7, None]}], "adjclose": [{"adjclose": [1.4, 1.4, None]}]}}]}}
    rows = files.chart_rows(spark.createDataFrame([(json.dumps(chart),), (None,), ("{",)], "payload string")).orderBy("date").collect()
    assert [(str(r["date"]), r["adj_close"], r["volume"]) for r in rows] == [("1970-01-02", 1.4, 7.0), ("1970-01-04", 3.5, 0.0)]
    (tmp_path / "a.csv").write_text("date,close\n" + "".join(f"2020-01-{i:02d},1\n" for i in range(1, 29)) + "\n")
    (tmp_path / "b.csv").write_text("<html>" + "x" * 300)
    got = {r["file"]: r for r in files.manifest(spark, str(tmp_path)).collect()}
    assert (got["a.csv"]["data_rows"], got["a.csv"]["first_date"], got["a.csv"]["last_date"], got["a.csv"]["accepted"]) == (28, "2020-01-01", "2020-01-28", True)
    assert not got["b.csv"]["accepted"] and len(got["a.csv"]["sha256"]) == 64
    df = spark.createDataFrame([("a", 1.23456), ("b", None)], "k string, v double")
    assert files.to_markdown(df, 2) == "| k | v |\n|---|---|\n| a | 1.23 |\n| b |  |"
    with pytest.raises(ValueError):
        files.to_markdown(df, most=1)
    files.write_table(df, str(tmp_path / "t"), ("k",))
    files.write_table(df.where("k = 'a'").withColumn("v", F.lit(9.0)), str(tmp_path / "t"), ("k",))
    assert {(r["k"], r["v"]) for r in files.read_table(spark, str(tmp_path / "t")).collect()} == {("a", 9.0), ("b", None)}
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none"))
    files.write_csv(df, str(tmp_path / "c"), 2)
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("k = 'a'").first()["v"] == "1.23"


def test_stream_and_batch_give_the_same_closed_days(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 4:02d} {6 * (i % 4):02d}:00:00", "a", float((i * 7) % 11)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = daily_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    closed = {tuple(r) for r in spark.table("bars").collect()}
    batch = {tuple(r) for r in daily_bars(events).collect()}
    assert closed < batch and len(closed) == 7
