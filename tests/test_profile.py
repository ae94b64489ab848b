import datetime as dt
import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.operators.profile import load_shifts, out_of_line, profile_loads
from tidemark.operators.quantiles import counted_medians

SCHEMA = "feature_id long, load_id int, a double, b double, f boolean, t string, n_rows string"


def test_medians_of_counted_values(spark):
    rng = random.Random(3)
    rows = []
    for g in ("x", "y", None):
        rows += [(g, rng.choice([rng.gauss(0, 1), rng.uniform(1e-9, 1e9), 0.0, -5.0]), rng.randrange(1, 5)) for _ in range(rng.randrange(40, 60))]
    rows += [("z", float("nan"), 3), ("z", None, 1), ("w", 2.0, 1), ("w", 4.0, 1), ("w", float("inf"), 9), ("tie", 1.0, 3), ("tie", 1.0, 2)]
    got = {r["g"]: r["median"] for r in counted_medians(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n").collect()}
    want = {}
    for g in ("x", "y", None, "w", "tie"):
        want[g] = median([v for k, v, n in rows if k == g and math.isfinite(v) for _ in range(n)])
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def loads(rng, n=400, k=8):
    rows = []
    for load in range(1, k + 1):
        for i in range(n):
            a, b = math.exp(rng.gauss(-9, 0.8)), rng.gauss(-0.02, 0.05)
            rows.append([load * 10_000 + i, load, a, b, rng.random() < 0.3, "t", "z"])
    return rows


def spoil(rows, load, change):
    for r in rows:
        if r[1] == load:
            change(r)


def test_each_kind_of_spoiled_load_is_found(spark):
    rng = random.Random(11)
    rows = loads(rng)
    spoil(rows, 1, lambda r: r.__setitem__(2, None if rng.random() < 0.2 else r[2]))
    spoil(rows, 2, lambda r: r.__setitem__(2, rng.choice([float("nan"), 0.0, -r[2]]) if rng.random() < 0.06 else r[2]))
    spoil(rows, 3, lambda r: r.__setitem__(2, round(r[2], 4)))
    spoil(rows, 4, lambda r: r.__setitem__(2, r[2] * 1e4))
    spoil(rows, 5, lambda r: r.__setitem__(4, rng.random() < 0.6))
    spoil(rows, 6, lambda r: r.__setitem__(3, -r[3]))
    spoil(rows, 7, lambda r: r.__setitem__(4, None if rng.random() < 0.2 else r[4]))
    out = out_of_line(spark.createDataFrame(rows, SCHEMA), ["a", "b", "f"], unsigned=("a",))
    got = {(r["load_id"], r["column_name"]): r["reasons"] for r in out.collect()}
    assert got.keys() == {(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "f"), (6, "b"), (7, "f")}
    assert got[(1, "a")] == ["nulls"] and "odd" in got[(2, "a")] and "distinct" in got[(3, "a")] and got[(4, "a")] == ["scale"] and got[(5, "f")] == ["share"] and got[(6, "b")] == ["share"]


def test_profile_counts_everything(spark):
    rows = [(1, 1, 1.0, None, True, "ab", "q"), (2, 1, 1.0, float("nan"), None, "b", None), (3, 1, -2.0, 0.0, False, None, "q"), (4, None, None, None, None, None, None)]
    out = {(r["load_id"], r["column_name"]): r for r in profile_loads(spark.createDataFrame(rows, SCHEMA), patterns={"t": "^[a-z]$"}).collect()}
    a, b, f, t = (out[(1, c)] for c in "abft")
    assert (a["n_rows"], a["n_null"], a["n_distinct"], a["n_negative"], a["n_positive"], a["min_value"], a["max_value"], a["median_abs"]) == (3, 0, 2, 1, 2, "-2.0", "1.0", 1.0)
    assert (b["n_null"], b["n_nan"], b["n_zero"], b["n_distinct"], b["median_abs"], b["max_value"]) == (1, 1, 1, 2, 0.0, "0.0")
    assert (f["n_true"], f["n_null"], f["n_distinct"]) == (1, 1, 2)
    assert (t["n_violations"], t["n_distinct"], t["median_abs"], t["max_value"]) == (1, 2, None, "b")
    assert out[(None, "a")]["n_null"] == 1 and out[(None, "a")]["min_value"] is None
    assert len(out) == 2 * 6 and profile_loads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shifts_of_lone_and_empty_loads(spark):
    rows = [(i, 1, float(i), None, None, "", "") for i in range(5)]
    out = load_shifts(spark.createDataFrame(rows, SCHEMA), ["a", "f"]).collect()
    assert {(r["column_name"], r["auc"], r["changed"]) for r in out} == {("a", None, True), ("f", None, True)}
    assert load_shifts(spark.createDataFrame([], SCHEMA), ["a"]).count() == 0
    assert out_of_line(spark.createDataFrame([], SCHEMA), ["a"]).count() == 0


def test_shifts_of_any_number_and_type_of_columns(spark):
    """Each load has one column of another kind changed; the test names that column and hardly any other."""
    rng = np.random.default_rng(4)
    names = [f"x{k}" for k in range(5)]
    rows = []
    for load in range(12):
        for i in range(500):
            x = [float(v) for v in np.exp(rng.normal(size=5))]
            x[4] = 1.1 if load != 4 else 2.8  # a constant column, moved in one load
            if load == 0:
                x[0] *= 1.7
            if load == 1:
                x[1] = x[1] ** 2.2  # same median, another spread
            if load == 2:
                x[2] = round(x[2], 1)
            text = None if rng.random() < 0.05 else "abcdefgh"[int(rng.integers(8) ** 2 // 7)] if load != 3 else "hgfedcba"[int(rng.integers(8) ** 2 // 7)]
            day = dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(300)) + (150 if load == 5 else 0))
            rows.append((None if i < 5 else load * 1000 + i, load if load else None, *x, text, day))
    df = spark.createDataFrame(rows, "feature_id long, load_id int, " + ", ".join(f"{n} double" for n in names) + ", t string, d date")
    got = {(r["load_id"], r["column_name"]): r for r in load_shifts(df, [*names, "t", "d"]).collect()}
    changed = {k for k, r in got.items() if r["changed"]}
    true = {(None, "x0"), (1, "x1"), (2, "x2"), (3, "t"), (4, "x4"), (5, "d")}
    assert len(got) == 12 * 7 and true <= changed and len(changed - true) <= 12, sorted((str(k), round(r["auc_alone"], 3), round(r["z"], 2), round(r["limit"], 2)) for k, r in got.items() if k in true or r["changed"] and k[0])
    for k in true:
        r = got[k]
        assert r["auc_alone"] > 0.55 and r["z"] > 2 * r["limit"] and r["auc"] - r["auc_without"] > 0.03


def test_loads_alike_are_hardly_ever_changed(spark):
    rng = random.Random(17)
    out = load_shifts(spark.createDataFrame(loads(rng, 300, 20), SCHEMA), ["a", "b", "f"]).collect()
    assert len(out) == 60 and sum(r["changed"] for r in out) <= 12 and all(abs(r["auc"] - 0.5) < 0.1 for r in out)


def test_the_test_decides_before_the_figures(spark, monkeypatch):
    """A load the test lets through is not held against the figures, however far they are off."""
    rng = random.Random(11)
    rows = loads(rng)
    spoil(rows, 4, lambda r: r.__setitem__(2, r[2] * 1e4))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r["load_id"], r["column_name"]) for r in out_of_line(df, ["a", "b"], unsigned=("a",)).collect()} == {(4, "a")}
    real = profile.load_shifts
    monkeypatch.setattr(profile, "load_shifts", lambda *a, **k: real(*a, **k).withColumn("changed", F.lit(False)))
    assert out_of_line(df, ["a", "b"], unsigned=("a",)).count() == 0
