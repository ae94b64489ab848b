import datetime as dt

from tidemark.operators.rejects import read_lines, typed_rows

HEAD = "date,open,high,low,close,adj_close,volume"
GOOD = "2000-11-27,2107.51,2117.25,2103.40,2115.68,2071.7164,92053700"
CASES = {
    GOOD: None,
    GOOD + "\r": None,
    '"2000-11-27",1,2,3,"2,115.68",5,6': None,
    " 1/2/2000 ,1,2,3, +2115.68 ,5,6": None,
    "01/02/2000,1,2,3,2.1e3,5,6": None,
    "2000-11-27,x,,,-1,,": None,
    '2000-11-27,1,2,3,"-1,234,567.5",5,6': None,
    '2000-11-27,1,2,3," 7 ",5,6': None,
    '2000-11-27,1,2,3,"4,5,6': "quote",
    '2000-11-27,1,2"2,3,4,5,6': "quote",
    '2000-11-27,1,"2"2,3,4,5,6': "quote",
    '2000-11-27,"1,"2",3,4,5,6': "quote",
    "2000-11-27,1,2,3,4,5": "columns",
    "2000-11-27,1,2,3,4,5,6,7": "columns",
    "": "columns",
    "   ": "columns",
    "2000-11-27\t1\t2": "columns",
    "2000-02-30,1,2,3,4,5,6": "date",
    "13/01/2000,1,2,3,4,5,6": "date",
    "2000-1-2,1,2,3,4,5,6": "date",
    "38346,1,2,3,4,5,6": "date",
    ",1,2,3,4,5,6": "date",
    HEAD: "date",
    "2000-11-27,1,2,3,,5,6": "close",
    "2000-11-27,1,2,3,N/A,5,6": "close",
    "2000-11-27,1,2,3,nan,5,6": "close",
    "2000-11-27,1,2,3,1e999,5,6": "close",
    "2000-11-27,1,2,3,12.5 USD,5,6": "close",
    '2000-11-27,1,2,3,"2490,41",5,6': "close",
    '2000-11-27,1,2,3,"1,23,456",5,6': "close",
    "2000-11-27,1,2,3,0x1F,5,6": "close",
    "2000-11-27,1,2,3,1f,5,6": "close",
    "bad,1,2,3,worse,5,6": "date",
}
SCHEMA = "line_id long, file_name string, line_no int, raw_line string, fields string, reason int"


def read(spark, rows):
    return read_lines(spark.createDataFrame(rows, SCHEMA), {"date": "date", "close": "number"})


def test_each_reason_and_each_odd_but_valid_spelling(spark):
    rows = [(0, "f", 1, HEAD, "x", 1)] + [(i, "f", i + 1, line, "x", 1) for i, line in enumerate(CASES, 1)]
    rows += [(500 + a, b, 500 + c, d, e, f) for a, b, c, d, e, f in rows[1:]]
    got = {r["line_id"]: r["reason"] for r in read(spark, rows).collect()}
    want = dict(enumerate(CASES.values(), 1))
    assert got == want | {500 + k: v for k, v in want.items()}


def test_typed_values(spark):
    rows = [(0, "f", 1, HEAD + "\r", "x", 1), (1, "f", 2, '01/02/2000,bad,"1,000",3,"2,115.68",5, 6 ', "x", 1), (2, "f", 3, "oops", "x", 1)]
    out = typed_rows(read(spark, rows), {"date": "date", "open": "number", "high": "number", "close": "number", "volume": "number", "absent": "number"}).collect()
    assert [(r["line_id"], r["date"], r["open"], r["high"], r["close"], r["volume"], r["absent"]) for r in out] == [(1, dt.date(2000, 1, 2), None, 1000.0, 2115.68, 6.0, None)]
    assert [r["invalid"] for r in out] == [["open"]]  # an absent column, like an empty field, lost nothing


def test_nulls_missing_headers_long_lines_and_empty(spark):
    long = "2000-11-27,1,2,3,4,5," + "9" * 300_000
    wide = "2000-11-27" + ",1" * 100_000
    quoted = '2000-11-27,1,2,3,4,5,"' + 'a""b,' * 50_000 + '"'
    rows = [
        (0, "f", 1, HEAD, "x", 1), (1, "f", 2, None, "x", 1), (2, None, 2, GOOD, "x", 1), (3, "f", None, GOOD, "x", 1), (4, "g", 2, GOOD, "x", 1),
        (5, "f", 3, long, "x", 1), (6, "f", 4, wide, "x", 1), (7, "f", 5, quoted, "x", 1), (8, "f", 6, quoted[:-1], "x", 1), (9, "h", 1, "date", "x", 1), (10, "h", 2, "2000-01-01", "x", 1),
    ]
    got = {r["line_id"]: r["reason"] for r in read(spark, rows).collect()}
    assert got == {1: "columns", 2: "columns", 3: None, 4: "columns", 5: None, 6: "columns", 7: None, 8: "quote", 10: "close"}
    assert read(spark, []).count() == 0
