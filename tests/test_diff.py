import datetime as dt

from tidemark.operators.diff import diff_copies

SCHEMA = "bar_id long, series_id string, date date, close double, note string, kind string, differences int"
DAY = [dt.date(2020, 1, d) for d in range(1, 12)]


def row(i, s, d, close, note="n"):
    return (i, s, d, close, note, "k", 0)


def test_all_kinds_of_difference(spark):
    nan, inf = float("nan"), float("inf")
    left = [row(1, "a", DAY[0], 1.0), row(2, "a", DAY[1], 1.0), row(3, "a", DAY[2], None), row(4, "a", DAY[3], None), row(5, "a", DAY[4], 1.0), row(6, None, DAY[0], 1.0), row(7, None, None, 2.0), row(8, "a", DAY[5], nan), row(9, "a", DAY[6], nan), row(10, "a", DAY[7], inf), row(11, "a", DAY[8], 100.0, "N ")]
    left += [row(20, "a", DAY[0], 9.0)] * 3
    right = [row(1, "a", DAY[0], 1.01), row(2, "a", DAY[1], 1.0101), row(3, "a", DAY[2], 5.0), row(4, "a", DAY[3], None), row(6, None, DAY[0], 2.0), row(7, None, None, 2.0), row(8, "a", DAY[5], nan), row(9, "a", DAY[6], 1.0), row(10, "a", DAY[7], inf), row(11, "a", DAY[8], 100.004, "n"), row(12, "b", DAY[0], 1.0)]
    out = diff_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["series_id", "date"], ["close", "note"], tolerance={"close": 0.01}, normalise=lambda n, x: x if n != "note" else __import__("pyspark").sql.functions.lower(__import__("pyspark").sql.functions.trim(x)), tie="bar_id")
    got = {(r["series_id"], r["date"]): (r["kind"], [tuple(d) for d in r["differences"]], r["left_rows"]) for r in out.collect()}
    assert got == {
        ("a", DAY[1]): ("changed", [("close", "1.0", "1.0101")], 1),
        ("a", DAY[2]): ("changed", [("close", None, "5.0")], 1),
        ("a", DAY[4]): ("left_only", [], 1),
        (None, DAY[0]): ("changed", [("close", "1.0", "2.0")], 1),
        ("a", DAY[6]): ("changed", [("close", "NaN", "1.0")], 1),
        ("b", DAY[0]): ("right_only", [], 0),
    }


def test_empty_copies(spark):
    some, none = spark.createDataFrame([row(1, "a", DAY[0], None)] * 2, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert [(r["kind"], r["left_rows"]) for r in diff_copies(some, none, ["series_id", "date"], ["close"]).collect()] == [("left_only", 2)]
    assert [r["kind"] for r in diff_copies(none, some, ["series_id", "date"], ["close"]).collect()] == ["right_only"]
    assert diff_copies(none, none, ["series_id", "date"], ["close"]).count() == 0
    assert diff_copies(some, some, ["series_id", "date"], ["close"]).count() == 0


def test_the_row_with_the_smallest_tie_counts_whole(spark):
    """Of repeated rows one is taken whole, as a hash aggregate where types allow it; without a tie the smallest values."""
    rows = [("a", 3, 1.0, None), ("a", 1, None, 9.0), ("a", 2, 0.5, 0.5), ("b", None, 7.0, 7.0), ("b", 5, 8.0, 8.0)]
    left = spark.createDataFrame(rows, "k string, id long, x double, y double")
    right = spark.createDataFrame([("a", 1, 1.0, 9.0), ("b", 1, 8.0, 8.0)], "k string, id long, x double, y double")
    out = diff_copies(left, right, ["k"], ["x", "y"], tie="id")
    assert [(r["k"], r["left_rows"], [(d["field"], d["left_value"], d["right_value"]) for d in r["differences"]]) for r in out.collect()] == [("a", 3, [("x", None, "1.0")])]
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    none = {r["k"]: [d["left_value"] for d in r["differences"]] for r in diff_copies(left, right, ["k"], ["x", "y"]).collect()}
    assert none == {"a": [None], "b": ["7.0", "7.0"]}
