import importlib
import sys

import duckdb
import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("p2_found", "p3_found", "p5_found", "calendar_joint", "vrp_summary_by_period", "drawdown_top5")


def entry_module():
    return importlib.import_module("__spark_entry__")


def normal(rows, columns):
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    show = lambda v: "-" if v is None else repr(round(v, 7) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[sorted(columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_their_sql(spark, name):
    module = entry_module()
    con = duckdb.connect()
    for table in ("gspc", "vix", "spx_stooq", "features", "raw_lines", "lineitem", "orders", "events"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = module.queries()[name](spark, FOLDER)
    cursor = con.execute(module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)


def test_the_whole_calendar_is_joined(spark):
    """As ``calendar_joint``'s SQL, from the start of the sample: earlier bars are there."""
    module, con = entry_module(), duckdb.connect()
    for table in ("gspc", "vix"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = con.execute(module.oracle_sql()["calendar_joint"].replace("2000-01-03", "1990-01-02"))
    columns, want = [c[0] for c in cursor.description], cursor.fetchall()
    df = module.queries()["calendar_joint_whole"](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert min(r[df.columns.index("date")] for r in rows) < "2000-01-03"
    assert normal(rows, df.columns) == normal(want, columns)


def test_every_sql_has_a_query_and_each_problem_its_found_query():
    module = entry_module()
    assert set(module.oracle_sql()) <= set(module.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(module.queries())


def test_the_flagship_runs(spark):
    assert entry_module().entry(spark).columns == ["series_id", "day", "field"]


def test_the_rest_works_without_the_text_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    names = set(entry_module().queries())
    assert "p1_found" in names and not any(n.startswith(("p6", "p7", "p8")) for n in names)
    sys.modules.pop("__spark_entry__")
