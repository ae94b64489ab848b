import datetime as dt
import random

import pytest

from tidemark.operators.rolling import rolling_totals

START = dt.date(2019, 12, 1)
SCHEMA = "series_id string, date date, v double, u double, day string, _e int"


def brute(rows, windows=(7, 30)):
    values, out = {}, {}
    for s, d, v, u, *_ in rows:
        if d is not None:
            for name, x in (("v", v), ("u", u)):
                key = (s, d, name)
                old = values.get(key)
                x = None if x is None or x != x else x
                values[key] = x if old is None else old if x is None else max(old, x)
    for s in {k[0] for k in values}:
        days = [k[1] for k in values if k[0] == s]
        day = min(days)
        while day <= max(days):
            for name in ("v", "u"):
                for w in windows:
                    inside = [values.get((s, day - dt.timedelta(i), name)) for i in range(w)]
                    inside = [x for x in inside if x is not None]
                    out[(s, day, name, w)] = (round(sum(inside), 6), len(inside), round(sum(inside) / len(inside), 6) if inside else None)
            day += dt.timedelta(1)
    return out


def run(spark, rows, **options):
    df = rolling_totals(spark.createDataFrame(rows, SCHEMA), ["v", "u"], **options)
    out = {}
    for r in df.collect():
        for name in ("v", "u"):
            for w in (7, 30):
                avg = r[f"avg_{name}_{w}"]
                out[(r["series_id"], r["day"], name, w)] = (round(r[f"total_{name}_{w}"], 6), r[f"n_{name}_{w}"], None if avg is None else round(avg, 6))
    return out


@pytest.mark.parametrize("bucket", [30, 360])
def test_matches_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for s in ("a", "b", None):
        for _ in range(60):
            v = rng.choice([None, float("nan"), 0.0, rng.uniform(-5, 5), rng.uniform(-5, 5)])
            rows.append((s, START + dt.timedelta(rng.randrange(150)), v, rng.random(), "x", 1))
    rows += rows[:20] + [("a", None, 1.0, 1.0, "x", 1)]
    assert run(spark, rows, bucket_days=bucket) == brute(rows)


def test_sum_of_repeated_rows_and_empty(spark):
    rows = [("a", START, 2.0, None, "x", 1), ("a", START, 3.0, None, "x", 1)]
    assert run(spark, rows, repeated="sum")[("a", START, "v", 7)] == (5.0, 2 - 1, 5.0)
    assert run(spark, rows)[("a", START, "v", 7)] == (3.0, 1, 3.0)
    assert run(spark, rows)[("a", START, "u", 30)] == (0.0, 0, None)
    assert run(spark, []) == {}


def test_parameters_are_checked(spark):
    df = spark.createDataFrame([], SCHEMA)
    for options in ({"repeated": "twice"}, {"windows": ()}, {"windows": (0,)}, {"bucket_days": 5}):
        with pytest.raises(ValueError):
            rolling_totals(df, ["v"], **options)


def test_only_the_calendar_join_moves_totals(spark):
    """Explosion and grouping share one exchange by entity and bucket: nothing exploded is shuffled before it is summed."""
    df = rolling_totals(spark.createDataFrame([("a", START, 2.0, None, "x", 1)], SCHEMA), ["v"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_e" in plan and plan.count("REPARTITION_BY_COL") == 1
