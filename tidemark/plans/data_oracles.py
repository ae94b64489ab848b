"""SQL for the general training-data queries, written apart from the operators."""

from __future__ import annotations


def _spikes(table: str, field: str, side: str, reasons: bool = False) -> str:
    """Rules (a) to (d) of the readings ``field``; side compares it with open and close of its bar, or is empty. With ``reasons`` one row for each rule that holds."""
    outside = f"coalesce({side}, false)" if side else "false"
    signs = []
    for k in (1, 2, 3):
        for s in ("1", "-1"):
            inside = " AND ".join(f"{s} * (lead(lv, {j}) OVER w - lag(lv, 1) OVER w) > 12 * m AND {s} * (lead(lv, {j}) OVER w - lead(lv, {k}) OVER w) > 12 * m" for j in range(k))
            signs.append((k, f"({inside})"))
    runs = ", ".join(f"coalesce({' OR '.join(t for kk, t in signs if kk == k)}, false) AS r{k}" for k in (1, 2, 3))
    hit = " OR ".join(f"coalesce(lag(r{k}, {j}) OVER w, false)" for k in (1, 2, 3) for j in range(k))
    impossible = f"(isnan(b.{field}) OR isinf(b.{field}) OR b.{field} <= 0)"
    beyond = outside.replace("{x}", f"b.{field}").replace("{open}", "b.open").replace("{close}", "b.close")
    rules = {"impossible": impossible, "outside": beyond, "stuck": f"coalesce(d.stuck AND d.x = b.{field}, false)", "spike": f"coalesce(d.spike AND d.x = b.{field}, false)"}
    what = f"unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN $${n}$$ END' for n, c in rules.items())}], lambda r: r IS NOT NULL)) AS reason" if reasons else "b.bar_id"
    return f"""
SELECT '{table}' AS table_name, {what}, '{field}' AS field
FROM {table} b
LEFT JOIN (
  WITH days AS (
    SELECT series_id, date, arg_min({{'x': {field}, 'open': open, 'close': close}}, bar_id) AS bar FROM {table} WHERE date IS NOT NULL GROUP BY series_id, date
  ), r AS (
    SELECT series_id, date, bar.x AS x, bar.x IS NOT NULL AND (isnan(bar.x) OR isinf(bar.x) OR bar.x <= 0) AS bad, {outside.replace("{x}", "bar.x").replace("{open}", "bar.open").replace("{close}", "bar.close")} AS outside FROM days
  ), held AS (
    SELECT *, sum(CASE WHEN x IS NULL OR px IS NULL OR x <> px THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY date) AS island, x IS NULL OR px IS NULL OR x <> px AS fresh
    FROM (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY date) AS px FROM r)
  ), stuck AS (
    SELECT series_id, date, NOT fresh AND count(x) OVER (PARTITION BY series_id, island) >= 5 AS stuck FROM held
  ), steps AS (
    SELECT series_id, date, outside, ln(x) AS lv, abs(ln(x) - lag(ln(x)) OVER (PARTITION BY series_id ORDER BY date)) AS step FROM r WHERE x IS NOT NULL AND NOT bad
  ), typical AS (SELECT series_id, median(step) AS m FROM steps GROUP BY series_id
  ), good AS (SELECT steps.*, m FROM steps JOIN typical ON steps.series_id IS NOT DISTINCT FROM typical.series_id WHERE NOT outside
  ), runs AS (SELECT series_id, date, {runs} FROM good WINDOW w AS (PARTITION BY series_id ORDER BY date)
  ), spike AS (SELECT series_id, date, {hit} AS spike FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY date))
  SELECT r.series_id, r.date, r.x, coalesce(stuck, false) AS stuck, coalesce(spike, false) AS spike
  FROM r LEFT JOIN stuck ON r.series_id IS NOT DISTINCT FROM stuck.series_id AND r.date = stuck.date LEFT JOIN spike ON r.series_id IS NOT DISTINCT FROM spike.series_id AND r.date = spike.date
) d ON b.series_id IS NOT DISTINCT FROM d.series_id AND b.date = d.date
WHERE b.{field} IS NOT NULL AND ({" OR ".join(rules.values())})"""


_LOW, _HIGH = "{x} > {open} * 1.03::DOUBLE AND {x} > {close} * 1.03::DOUBLE", "{x} < {open} * 0.97::DOUBLE AND {x} < {close} * 0.97::DOUBLE"
_JUDGED = (("gspc", "open", ""), ("gspc", "low", _LOW), ("vix", "open", ""), ("vix", "high", _HIGH))
P1_FOUND = "\nUNION ALL\n".join(_spikes(*which) for which in _JUDGED)
P1_REASONS = f"SELECT table_name, field, reason, count(*) AS readings FROM ({' UNION ALL '.join(_spikes(*which, reasons=True) for which in _JUDGED)}) GROUP BY ALL"


def _residuals(field: str, side: str, ratio: float) -> str:
    """Seasonal residuals of one gspc field and, by series, the cutoff of a tail ``ratio`` times as heavy as the risk, up to ``cut``."""
    outside = f"coalesce({side.replace('{x}', 'bar.x').replace('{open}', 'bar.open').replace('{close}', 'bar.close')}, false)" if side else "false"
    return f"""WITH days AS (SELECT series_id, date, arg_min({{'x': {field}, 'open': open, 'close': close}}, bar_id) AS bar FROM gspc WHERE date IS NOT NULL GROUP BY series_id, date),
  good AS (SELECT series_id, date, ln(bar.x) AS lv, {outside} AS outside FROM days WHERE bar.x IS NOT NULL AND NOT isnan(bar.x) AND NOT isinf(bar.x) AND bar.x > 0),
  typical AS (SELECT series_id, median(step) AS m FROM (SELECT series_id, abs(lv - lag(lv) OVER (PARTITION BY series_id ORDER BY date)) AS step FROM good) GROUP BY series_id),
  moved AS (SELECT series_id, date, lv, lv - lag(lv) OVER (PARTITION BY series_id ORDER BY date) AS change FROM good WHERE NOT outside),
  season AS (SELECT series_id, isodow(date) AS dow, median(change) AS s FROM moved GROUP BY ALL),
  left_over AS (SELECT moved.series_id, moved.date, lv, change - coalesce(s, 0) AS residual, m FROM moved JOIN typical ON moved.series_id IS NOT DISTINCT FROM typical.series_id LEFT JOIN season ON moved.series_id IS NOT DISTINCT FROM season.series_id AND isodow(moved.date) = dow),
  ends AS (SELECT series_id, quantile_cont(abs(residual), 0.9) AS u, quantile_cont(abs(residual), 0.95) AS mid, quantile_cont(abs(residual), 0.975) AS far FROM left_over WHERE abs(residual) <= 12 * m GROUP BY series_id),
  shaped AS (SELECT *, CASE WHEN mid > u AND far > mid THEN least(greatest(log2((far - mid) / (mid - u)), -1), 2) ELSE 0 END AS shape FROM ends),
  cut AS (SELECT series_id, u + CASE WHEN abs(shape) < 1e-6 THEN (mid - u) / ln(2) * ln({ratio!r}::DOUBLE) ELSE (mid - u) * shape / (pow(2, shape) - 1) * (pow({ratio!r}::DOUBLE, shape) - 1) / shape END AS cutoff FROM shaped),
  scored AS (SELECT left_over.*, cutoff FROM left_over LEFT JOIN cut ON left_over.series_id IS NOT DISTINCT FROM cut.series_id)"""


def _tail(field: str, side: str) -> str:
    """Tail of one gspc field, by series."""
    return f"""
SELECT series_id, '{field}' AS field, count(residual) AS residuals, count(*) FILTER (WHERE abs(residual) > cutoff) AS beyond, round(any_value(cutoff), 8) AS cutoff, round(any_value(m), 8) AS typical_change FROM ({_residuals(field, side, 0.1 / 0.02)} SELECT * FROM scored) GROUP BY series_id"""


def _tail_spikes(field: str, side: str) -> str:
    """Rows of gspc whose reading of the field lies in a run of up to three beyond the cutoff, undone by a move beyond it."""
    runs = []
    for k in (1, 2, 3):
        within = ", ".join(["lv", *(f"lead(lv, {j}) OVER w" for j in range(1, k))])
        low, high = (f"least({within})", f"greatest({within})") if k > 1 else ("lv", "lv")
        there = f"lead(lv, {k}) OVER w IS NOT NULL AND lag(lv) OVER w IS NOT NULL"
        up = f"residual > cutoff AND lead(residual, {k}) OVER w < -cutoff AND {low} > greatest(lag(lv) OVER w, lead(lv, {k}) OVER w)"
        down = f"residual < -cutoff AND lead(residual, {k}) OVER w > cutoff AND {high} < least(lag(lv) OVER w, lead(lv, {k}) OVER w)"
        runs.append(f"coalesce({there} AND (({up}) OR ({down})), false) AS r{k}")
    hit = " OR ".join(f"coalesce(lag(r{k}, {j}) OVER w, false)" if j else f"r{k}" for k in (1, 2, 3) for j in range(k))
    return f"""SELECT b.bar_id, '{field}' AS field FROM gspc b JOIN (
  {_residuals(field, side, 0.1 / 0.0001)}, runs AS (SELECT series_id, date, {", ".join(runs)} FROM scored WINDOW w AS (PARTITION BY series_id ORDER BY date)),
  spikes AS (SELECT * FROM (SELECT series_id, date, {hit} AS spike FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY date)) WHERE spike)
  SELECT spikes.series_id, spikes.date, bar.x AS x FROM spikes JOIN days ON spikes.series_id IS NOT DISTINCT FROM days.series_id AND spikes.date = days.date
) d ON b.series_id IS NOT DISTINCT FROM d.series_id AND b.date = d.date AND b.{field} = d.x"""


P1_TAIL = f"{_tail_spikes('open', '')} UNION ALL {_tail_spikes('low', _LOW)}"
P1_CUTOFFS = f"{_tail('open', '')} UNION ALL {_tail('low', _LOW)}"

_FIELDS = ("dv_cc", "rv_cc_trail_22", "target_rv_22")
_ROLL = f"""
WITH daily AS (SELECT series_id, date, {", ".join(f"max(CASE WHEN NOT isnan({v}) THEN {v} END) AS {v}" for v in _FIELDS)} FROM features WHERE date IS NOT NULL GROUP BY series_id, date),
spans AS (SELECT series_id, min(date) AS first_day, max(date) AS last_day FROM daily GROUP BY series_id),
calendar AS (SELECT series_id, first_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
rolled AS (
  SELECT c.series_id, c.first_day, c.day, {", ".join(f"coalesce(sum({v}) OVER w{w}, 0::DOUBLE) AS total_{v}_{w}, count({v}) OVER w{w} AS n_{v}_{w}, avg({v}) OVER w{w} AS avg_{v}_{w}" for v in _FIELDS for w in (7, 30))}
  FROM calendar c LEFT JOIN daily d ON c.series_id IS NOT DISTINCT FROM d.series_id AND c.day = d.date
  WINDOW w7 AS (PARTITION BY c.series_id ORDER BY c.day ROWS 6 PRECEDING), w30 AS (PARTITION BY c.series_id ORDER BY c.day ROWS 29 PRECEDING)
)"""
P2_ROLLING = f"""{_ROLL}
SELECT series_id, CAST(day AS VARCHAR) AS day, {", ".join(f"round(total_{v}_{w}, 8) AS total_{v}_{w}, n_{v}_{w}, round(avg_{v}_{w}, 8) AS avg_{v}_{w}" for v in _FIELDS for w in (7, 30))} FROM rolled"""
P2_FOUND = f"""{_ROLL}, late AS (SELECT * FROM rolled WHERE day >= first_day + 29)
SELECT series_id, CAST(day AS VARCHAR) AS day, 'dv_cc' AS field FROM late WHERE total_dv_cc_30 > 0 AND total_dv_cc_7 > 0.65::DOUBLE * total_dv_cc_30
""" + "".join(f"UNION ALL SELECT series_id, CAST(day AS VARCHAR), '{v}' FROM late WHERE n_{v}_7 > 0 AND avg_{v}_7 > 1.6::DOUBLE * avg_{v}_30\n" for v in _FIELDS[1:])

_LINES = r"""
WITH body AS (SELECT line_id, file_name, line_no, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS line FROM raw_lines),
headers AS (SELECT file_name, arg_min(line, line_id) AS header, len(string_split(arg_min(line, line_id), ',')) AS wide FROM body WHERE line_no = 1 GROUP BY file_name),
marked AS (
  SELECT b.*, h.wide, regexp_replace(line, '(^|,)"(?:[^"]|"")*"(,|$)', '\1Q\2', 'g') AS once FROM body b LEFT JOIN headers h ON b.file_name IS NOT DISTINCT FROM h.file_name WHERE line_no > 1
), masked AS (SELECT *, regexp_replace(once, '(^|,)"(?:[^"]|"")*"(,|$)', '\1Q\2', 'g') AS plain FROM marked),
shaped AS (
  SELECT *, CASE WHEN contains(plain, '"') THEN 'quote' WHEN wide IS NULL OR trim(line) = '' OR len(string_split(plain, ',')) <> wide THEN 'columns' END AS shape,
    list_transform(regexp_extract_all(line, '(?:^|,)("(?:[^"]|"")*"|[^,"]*)'), lambda f: ltrim(f, ',')) AS fields
  FROM masked
), cells AS (
  SELECT *, fields[1] AS raw_date, fields[5] AS raw_close,
    trim(replace(trim(fields[1], '"'), '""', '"'), E' \t\r\n') AS day_text, trim(replace(trim(fields[5], '"'), '""', '"'), E' \t\r\n') AS close_text
  FROM shaped WHERE shape IS NULL
), judged AS (
  SELECT *,
    CASE WHEN regexp_full_match(day_text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN CAST(try_strptime(day_text, '%m/%d/%Y') AS DATE) WHEN regexp_full_match(day_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(day_text AS DATE) END AS day,
    CASE WHEN regexp_full_match(close_text, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(close_text AS DOUBLE)
         WHEN raw_close[1] = '"' AND regexp_full_match(close_text, '[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]+)?') THEN try_cast(replace(close_text, ',', '') AS DOUBLE) END AS close
  FROM cells
)"""
P3_FOUND = f"""{_LINES}
SELECT line_id, shape AS reason FROM shaped WHERE shape IS NOT NULL
UNION ALL SELECT line_id, CASE WHEN day IS NULL THEN 'date' ELSE 'close' END FROM judged WHERE day IS NULL OR close IS NULL OR isinf(close)"""


def _number(i: int) -> str:
    text = f"trim(trim(fields[{i}], '\"'), E' \\t\\r\\n')"
    return f"""CASE WHEN regexp_full_match({text}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({text} AS DOUBLE)
    WHEN fields[{i}][1] = '"' AND regexp_full_match({text}, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]*)?([eE][+-]?[0-9]+)?') THEN try_cast(replace({text}, ',', '') AS DOUBLE) END"""


def _typed(kind: str, names: tuple[str, ...]) -> str:
    return f"""{_LINES}
SELECT line_id, line_no, day AS date, {", ".join(f"{_number(i)} AS {n}" for i, n in enumerate(names, 2))}, regexp_extract(file_name, '^[a-z]+_(.*)\\.csv$', 1) AS series_id
FROM judged WHERE file_name LIKE '{kind}\\_%' ESCAPE '\\' AND day IS NOT NULL AND close IS NOT NULL AND NOT isinf(close)"""


P3_GSPC = _typed("gspc", ("open", "high", "low", "close", "adj_close", "volume"))
P3_VIX = _typed("vix", ("open", "high", "low", "close"))

P4_FOUND = """
WITH f AS (
  SELECT load_id, 'dv_parkinson' AS column_name, count(*) AS n, count(dv_parkinson) AS full_, count(*) FILTER (WHERE isnan(dv_parkinson) OR dv_parkinson = 0 OR dv_parkinson < 0) AS odd,
    count(DISTINCT dv_parkinson) AS d, median(abs(dv_parkinson)) FILTER (WHERE NOT isnan(dv_parkinson) AND NOT isinf(dv_parkinson)) AS size, CAST(NULL AS DOUBLE) AS share FROM features GROUP BY load_id
  UNION ALL SELECT load_id, 'vrp_expost', count(*), count(vrp_expost), count(*) FILTER (WHERE isnan(vrp_expost) OR vrp_expost = 0), count(DISTINCT vrp_expost), median(abs(vrp_expost)) FILTER (WHERE NOT isnan(vrp_expost) AND NOT isinf(vrp_expost)),
    count(*) FILTER (WHERE vrp_expost > 0 AND NOT isnan(vrp_expost)) / nullif(count(vrp_expost), 0) FROM features GROUP BY load_id
  UNION ALL SELECT load_id, 'spx_open_synthetic', count(*), count(spx_open_synthetic), 0, NULL, NULL, count(*) FILTER (WHERE spx_open_synthetic) / nullif(count(spx_open_synthetic), 0) FROM features GROUP BY load_id
), g AS (SELECT *, 1 - full_ / n AS nulls, odd / nullif(full_, 0) AS odds, d / nullif(full_, 0) AS fresh FROM f),
m AS (SELECT column_name, median(nulls) AS nulls, median(fresh) AS fresh, median(size) AS size, median(share) AS share FROM g GROUP BY column_name)
SELECT g.load_id, g.column_name FROM g JOIN m USING (column_name)
WHERE round(abs(g.nulls - m.nulls), 12) >= 0.12 OR g.odds >= 0.03 OR g.fresh < 0.5 * m.fresh OR g.size >= 10 * m.size OR g.size * 10 <= m.size OR round(abs(g.share - m.share), 12) >= 0.2"""

_NUMBERS = (
    "feature_id spx_open spx_high spx_low spx_close vix_close vix9d_close vix3m_close vix6m_close dv_cc dv_parkinson dv_garman_klass dv_rogers_satchell dv_yang_zhang22 "
    "rv_cc_trail_1 rv_cc_trail_5 rv_cc_trail_22 rv_gk_trail_1 rv_gk_trail_5 rv_gk_trail_22 rv_pk_trail_1 rv_pk_trail_5 rv_pk_trail_22 ret_cc bv_trail_5 bv_trail_22 jump_5 jump_22 target_rv_1 target_rv_5 target_rv_22 iv30 iv9d iv3m iv6m vrp_expost"
).split()


def _profile(c: str) -> str:
    if c in _NUMBERS:
        x = f"CAST({c} AS DOUBLE)"
        real = f"CASE WHEN NOT isnan({x}) THEN {x} END"
        figures = f"count(*) FILTER (WHERE isnan({x})) AS n_nan, count(*) FILTER (WHERE {real} = 0) AS n_zero, count(*) FILTER (WHERE {real} < 0) AS n_negative, count(*) FILTER (WHERE {real} > 0) AS n_positive, 0::BIGINT AS n_true, count(DISTINCT {x}) AS n_distinct, round(median(abs({x})) FILTER (WHERE NOT isnan({x}) AND NOT isinf({x})), 10) AS median_abs"
    else:
        true = f"count(*) FILTER (WHERE {c})" if c == "spx_open_synthetic" else "0::BIGINT"
        figures = f"0::BIGINT AS n_nan, 0::BIGINT AS n_zero, 0::BIGINT AS n_negative, 0::BIGINT AS n_positive, {true} AS n_true, count(DISTINCT {c}) AS n_distinct, CAST(NULL AS DOUBLE) AS median_abs"
    if c in _NUMBERS:
        ends = "CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value, " + ", ".join(f"round({e}({real}), 10) AS {e}_number" for e in ("min", "max"))
    else:
        ends = ", ".join(f"CAST({e}({c}) AS VARCHAR) AS {e}_value" for e in ("min", "max")) + ", CAST(NULL AS DOUBLE) AS min_number, CAST(NULL AS DOUBLE) AS max_number"
    pattern = {"series_id": "[a-z]{3}-[0-9]{8}", "symbol": "[A-Z]{3}"}.get(c)
    violations = f"count(*) FILTER (WHERE NOT regexp_full_match({c}, '{pattern}'))" if pattern else "0::BIGINT"
    return f"SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, {figures}, {ends}, {violations} AS n_violations FROM features GROUP BY load_id"


P4_PROFILE = "\nUNION ALL\n".join(_profile(c) for c in ("series_id", "symbol", "date", "spx_open_synthetic", "loaded_at", *_NUMBERS))


def _pairs(names: tuple[str, ...]) -> str:
    first = "{" + ", ".join(f"'{n}': {n}" for n in names) + "}"
    fold = lambda t: f"SELECT series_id, date, arg_min({first}, bar_id) AS bar FROM {t} GROUP BY series_id, date"
    return f"WITH a AS ({fold('gspc')}), b AS ({fold('spx_stooq')}), j AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, CAST(coalesce(a.date, b.date) AS VARCHAR) AS day, a.bar AS x, b.bar AS y FROM a FULL OUTER JOIN b ON a.series_id IS NOT DISTINCT FROM b.series_id AND a.date IS NOT DISTINCT FROM b.date)"


def _apart(n: str) -> str:
    return f"(x.{n} IS DISTINCT FROM y.{n} AND coalesce(round(abs(x.{n} - y.{n}), 9) > 0.01::DOUBLE, true))"


P5_FOUND = f"""{_pairs(("close",))}
SELECT series_id, day, CASE WHEN y IS NULL THEN 'gspc_only' WHEN x IS NULL THEN 'stooq_only' ELSE 'close' END AS kind FROM j WHERE x IS NULL OR y IS NULL OR {_apart("close")}"""
_P5 = ("open", "high", "low", "close", "volume")
P5_FIELDS = _pairs(_P5) + "\nUNION ALL\n".join(f" SELECT series_id, day, '{n}' AS field, x.{n} AS left_value, y.{n} AS right_value FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND {_apart(n)}" for n in _P5)

ORACLES = {
    "p1_reasons": P1_REASONS,
    "p1_cutoffs": P1_CUTOFFS,
    "p1_tail": P1_TAIL,
    "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_rolling": P2_ROLLING, "p3_found": P3_FOUND, "p3_gspc": P3_GSPC, "p3_vix": P3_VIX, "p4_found": P4_FOUND, "p4_profile": P4_PROFILE, "p5_found": P5_FOUND, "p5_fields": P5_FIELDS}
