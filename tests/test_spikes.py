import datetime as dt
import math
import random
from dataclasses import replace
from statistics import median

import pytest

from tidemark.operators.spikes import Reading, SpikeRules, flag_spikes, tail_cutoffs

RULES = SpikeRules(fields=(Reading("open"), Reading("low", above=("open", "close"))))
SCHEMA = "bar_id long, series_id string, date date, open double, low double, close double, _value string, field string"


def brute(rows):
    """The rules, read literally, over one series of distinct days."""
    found = set()
    for name in ("open", "low"):
        values = [r[name] for r in rows]
        good = [i for i, v in enumerate(values) if v is not None and math.isfinite(v) and v > 0]
        for i, v in enumerate(values):
            if v is not None and (not math.isfinite(v) or v <= 0):
                found.add((rows[i]["bar_id"], name))
        outside = set()
        if name == "low":
            outside = {i for i in good if all(rows[i][c] is not None and values[i] > 1.03 * rows[i][c] for c in ("open", "close"))}
            found |= {(rows[i]["bar_id"], name) for i in outside}
        i = 0
        while i < len(values):
            j = i
            while values[i] is not None and j + 1 < len(values) and values[j + 1] == values[i]:
                j += 1
            if j - i >= 4:
                found |= {(rows[k]["bar_id"], name) for k in range(i + 1, j + 1)}
            i = j + 1
        steps = [abs(math.log(values[b]) - math.log(values[a])) for a, b in zip(good, good[1:])]
        if not steps:
            continue
        apart = 12 * median(steps)
        seq = [i for i in good if i not in outside]
        x = [math.log(values[i]) for i in seq]
        for a in range(1, len(seq)):
            for k in (1, 2, 3):
                if a + k < len(seq):
                    run, ends = x[a : a + k], (x[a - 1], x[a + k])
                    if min(run) - max(ends) > apart or min(ends) - max(run) > apart:
                        found |= {(rows[i]["bar_id"], name) for i in seq[a : a + k]}
    return found


def series(rng, n, start=0, name="s"):
    price, rows = 100.0, []
    for i in range(n):
        price *= math.exp(rng.gauss(0, 0.01))
        o = price * math.exp(rng.gauss(0, 0.002))
        rows.append({"bar_id": start + i, "series_id": name, "date": dt.date(2020, 1, 1) + dt.timedelta(i + 2 * (i // 5)), "open": round(o, 2), "low": round(min(o, price) * 0.995, 2), "close": round(price, 2)})
    for _ in range(n // 25):
        i, field = rng.randrange(1, n - 6), rng.choice(("open", "low"))
        kind = rng.randrange(6)
        for k in range(rng.randrange(1, 6)):
            factor = (1.6, 0.55)[kind % 2]
            rows[i + k][field] = {2: 0.0, 3: float("nan"), 4: None, 5: rows[i][field]}.get(kind, rows[i + k][field] and rows[i + k][field] * factor)
    return rows


def run(spark, rows, rules=RULES):
    data = [(r["bar_id"], r["series_id"], r["date"], r["open"], r["low"], r["close"], "x", "y") for r in rows]
    return flag_spikes(spark.createDataFrame(data, SCHEMA), rules)


def test_matches_brute_force_with_duplicates(spark):
    rng = random.Random(5)
    rows, want, copies = [], set(), []
    for s in range(6):
        own = series(rng, 160, 1000 * s, f"s{s}")
        rows += own
        want |= brute(own)
    for r in rng.sample(rows, 60):
        copies.append(r | {"bar_id": r["bar_id"] + 500})
        want |= {(r["bar_id"] + 500, f) for f in ("open", "low") if (r["bar_id"], f) in want}
    got = [(r["row_id"], r["field"]) for r in run(spark, rows + copies).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and len(want) > 40


def test_moves_that_persist_are_kept(spark):
    rows = series(random.Random(1), 60)
    rows = [r | {"open": 100.0 + i % 3, "low": 99.0 + i % 4, "close": 100.0} for i, r in enumerate(rows)]
    rows[30:] = [r | {"open": r["open"] * 3, "low": r["low"] * 3, "close": 300.0} for r in rows[30:]]
    assert run(spark, rows).count() == 0


def test_nulls_empty_ties_and_lonely_rows(spark):
    day = dt.date(2020, 1, 1)
    rows = [
        {"bar_id": 1, "series_id": None, "date": None, "open": -1.0, "low": 5.0, "close": None},
        {"bar_id": 2, "series_id": None, "date": day, "open": None, "low": None, "close": None},
        {"bar_id": 3, "series_id": None, "date": day, "open": float("inf"), "low": 110.0, "close": 100.0},
        {"bar_id": 4, "series_id": "a", "date": day, "open": 100.0, "low": 110.0, "close": 100.0},
    ]
    got = {(r["row_id"], r["field"], tuple(r["reasons"])) for r in run(spark, rows).collect()}
    assert got == {(1, "open", ("impossible",)), (3, "open", ("impossible",)), (4, "low", ("outside",))}
    assert run(spark, []).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_stuck_run_needs_five(spark, n):
    rows = [r | {"open": 100.0 + i * 0.7 + (i % 2), "low": 99.0 + i * 0.3, "close": 100.0 + i} for i, r in enumerate(series(random.Random(2), 20))]
    for i in range(6, 6 + n):
        rows[i]["open"] = 107.77
    got = {r["row_id"] for r in run(spark, rows).collect() if "stuck" in r["reasons"]}
    assert got == (set(range(7, 11)) if n == 5 else set())


def test_a_series_full_of_spikes_hides_none(spark):
    """Where a sixth of the readings is wrong, a tail fitted to all residuals would be theirs; gross ones take no part in the fit."""
    rng = random.Random(12)
    rows = series(rng, 100)
    for r in rows:
        r["open"], r["low"], r["close"] = 100 * math.exp(rng.gauss(0, 0.005)), 99 * math.exp(rng.gauss(0, 0.005)), 100.0
    for i in range(3, 97, 6):
        rows[i]["open"] *= 1.5
    got = {(r["row_id"], r["field"]) for r in run(spark, rows).collect()}
    assert got == brute(rows) and len(got) == 16


def test_the_fitted_tail_decides(spark):
    """Without the exact check a spike is what the tail says: other risks find other readings, and a cutoff of nothing finds most."""
    rng = random.Random(9)
    rows = [r for k in range(4) for r in series(rng, 200, 1000 * k, f"s{k}")]
    spikes = lambda **change: {(r["row_id"], r["field"]) for r in run(spark, rows, replace(RULES, **change)).collect() if "spike" in r["reasons"]}
    strict, usual, none = spikes(multiple=None, risk=1e-5), spikes(multiple=None, risk=0.02), spikes(multiple=None, risk=1.0)
    checked = spikes()
    assert checked < usual < none and strict < usual and len(none) > 3 * len(usual) > 3 * len(strict) > 0
    assert spikes(risk=1e-12) < checked  # the check only narrows what the tail lets through


def test_cutoffs_hold_their_risk_on_clean_series(spark):
    rng = random.Random(21)
    rows = []
    for k in range(5):
        x = 100.0
        for i in range(800):
            x *= math.exp(rng.gauss(0.0, 0.01) * (3.0 if rng.random() < 0.05 else 1.0))
            rows.append((10_000 * k + i, f"s{k}", dt.date(2015, 1, 1) + dt.timedelta(i), x, x, x, "", ""))
    scored = tail_cutoffs(spark.createDataFrame(rows, SCHEMA), replace(RULES, risk=0.02))
    for r in scored.where("field = 'open'").groupBy("series_id").agg({"residual": "count", "cutoff": "max"}).collect():
        cutoff = r["max(cutoff)"]
        beyond = scored.where(f"field = 'open' and series_id = '{r['series_id']}' and abs(residual) > {cutoff}").count()
        assert 0.012 < beyond / r["count(residual)"] < 0.03
