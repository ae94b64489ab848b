"""SQL for the analytics queries, over common table expressions that restate bars and features."""

from __future__ import annotations


def _full(agg: str, x: str, frame: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER (w {frame}) = {n} THEN {agg}({x}) OVER (w {frame}) END"


def _back(n: int) -> str:
    return f"ROWS {n - 1} PRECEDING"


_LN2 = "0.6931471805599453::DOUBLE"
_K = repr(0.34 / (1.34 + 23 / 21)) + "::DOUBLE"
_K1 = repr(1 - 0.34 / (1.34 + 23 / 21)) + "::DOUBLE"

_ASSET = """
asset AS (
  SELECT 'asset' AS series_id, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, 1000 + l_extendedprice / 3000 AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE isodow(l_shipdate) < 6)
  GROUP BY date
), asset_iv AS (SELECT 'asset' AS series_id, CAST(o_orderdate AS DATE) AS date, 10 + sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (count(o_totalprice) * 1999993::DOUBLE) AS close FROM orders GROUP BY 2)"""


def _clean(x: str) -> str:
    return f"CASE WHEN NOT isnan({x}) AND NOT isinf({x}) AND {x} > 0 THEN {x} END AS {x}"


def _bars(name: str, table: str) -> str:
    first = ", ".join(f"arg_min({{'v': {c}}}, bar_id).v AS {c}" for c in ("open", "high", "low", "close"))
    return f"{name} AS (SELECT series_id, date, {', '.join(map(_clean, ('open', 'high', 'low', 'close')))} FROM (SELECT series_id, date, {first} FROM {table} WHERE date IS NOT NULL GROUP BY series_id, date))"


_SERIES = _bars("g", "gspc") + ", " + _bars("v", "vix")


def _features(bars: str, implied: str) -> str:
    """Common table expressions up to ``feat``."""
    rolled = [f"{_full('var_samp', 'overnight', _back(22), 22)} + {_K} * {_full('var_samp', 'day', _back(22), 22)} + {_K1} * {_full('avg', 'dv_rogers_satchell', _back(22), 22)} AS dv_yang_zhang22"]
    for n in (1, 5, 22):
        for short, dv in (("cc", "dv_cc"), ("gk", "dv_garman_klass"), ("pk", "dv_parkinson")):
            rolled.append(f"{252 / n!r}::DOUBLE * {_full('sum', dv, _back(n), n)} AS rv_{short}_trail_{n}")
        rolled.append(f"{252 / n!r}::DOUBLE * {_full('sum', 'dv_cc', f'ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING', n)} AS target_rv_{n}")
    for n in (5, 22):
        rolled.append(f"{3.141592653589793 / 2 * 252 / (n - 1)!r}::DOUBLE * {_full('sum', 'pair', _back(n - 1), n - 1)} AS bv_trail_{n}")
    return f"""
joint AS (SELECT a.series_id, a.date, a.open AS spx_open, a.high AS spx_high, a.low AS spx_low, a.close AS spx_close, b.close AS vix_close FROM {bars} a JOIN {implied} b ON a.series_id = b.series_id AND a.date = b.date),
steps AS (SELECT *, lag(spx_close) OVER w AS before, ln(spx_close) - lag(ln(spx_close)) OVER w AS ret_cc FROM joint WINDOW w AS (PARTITION BY series_id ORDER BY date)),
daily AS (
  SELECT *, ret_cc * ret_cc AS dv_cc, ln(spx_high / spx_low) * ln(spx_high / spx_low) / (4 * {_LN2}) AS dv_parkinson,
    0.5::DOUBLE * ln(spx_high / spx_low) * ln(spx_high / spx_low) - (2 * {_LN2} - 1) * ln(spx_close / spx_open) * ln(spx_close / spx_open) AS dv_garman_klass,
    ln(spx_high / spx_close) * ln(spx_high / spx_open) + ln(spx_low / spx_close) * ln(spx_low / spx_open) AS dv_rogers_satchell,
    ln(spx_open / before) AS overnight, ln(spx_close / spx_open) AS day, coalesce(round_even(spx_open, 4) = round_even(before, 4), false) AS spx_open_synthetic,
    abs(ret_cc) * abs(lag(ret_cc) OVER (PARTITION BY series_id ORDER BY date)) AS pair
  FROM steps
), rolled AS (SELECT *, {", ".join(rolled)} FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date)),
feat AS (
  SELECT *, CASE WHEN rv_cc_trail_5 - bv_trail_5 IS NOT NULL THEN greatest(rv_cc_trail_5 - bv_trail_5, 0) END AS jump_5, CASE WHEN rv_cc_trail_22 - bv_trail_22 IS NOT NULL THEN greatest(rv_cc_trail_22 - bv_trail_22, 0) END AS jump_22,
    vix_close / 100 * (vix_close / 100) AS iv30, vix_close / 100 * (vix_close / 100) - target_rv_22 AS vrp_expost
  FROM rolled
)"""


_MARKET = f"WITH {_ASSET}, {_features('asset', 'asset_iv')}"
_WIDE = f"WITH {_SERIES}, {_features('g', 'v')}"
_NUMBERED = f"{_MARKET}, pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n_pos FROM feat), cut AS (SELECT max(pos) AS last FROM pos WHERE date <= DATE '1999-12-31'), dev AS (SELECT pos.*, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM pos, cut WHERE date >= DATE '1998-01-01' AND pos <= last - 22)"
_UNI = f"""{_NUMBERED}, moved AS (
  SELECT date, rv_cc_trail_22 AS x, count(CASE WHEN y IS NOT NULL AND rv_cc_trail_22 IS NOT NULL THEN 1 END) OVER t AS n, regr_slope(y, rv_cc_trail_22) OVER t AS b, regr_intercept(y, rv_cc_trail_22) OVER t AS a
  FROM (SELECT *, target_rv_22 AS y FROM feat) WINDOW t AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 22 PRECEDING)
), refits AS (SELECT d.date, d.ordinal, m.x, CASE WHEN d.ordinal % 22 = 0 AND m.n >= 252 THEN m.a END AS a, CASE WHEN d.ordinal % 22 = 0 AND m.n >= 252 THEN m.b END AS b FROM dev d JOIN moved m ON d.date = m.date),
uni AS (SELECT date, last_value(a IGNORE NULLS) OVER (ORDER BY date) + last_value(b IGNORE NULLS) OVER (ORDER BY date) * x AS forecast FROM refits)"""
_PANEL = f"""{_UNI}, panel AS (
  SELECT date, 'random_walk' AS model, rv_cc_trail_22 AS forecast FROM feat UNION ALL SELECT date, 'vix', iv30 FROM feat
  UNION ALL SELECT date, 'expanding_mean', CASE WHEN count(dv_cc) OVER (ORDER BY date) >= 252 THEN avg(dv_cc * 252) OVER (ORDER BY date) END FROM feat
  UNION ALL SELECT date, 'ols_rv_cc_trail_22', forecast FROM uni
), sample AS (
  SELECT * FROM (SELECT p.date, model, forecast, target_rv_22 AS y, count(*) OVER (PARTITION BY p.date) AS have FROM panel p JOIN dev d ON p.date = d.date WHERE forecast IS NOT NULL AND target_rv_22 IS NOT NULL) WHERE have = 4
), lossed AS (SELECT *, greatest(forecast, 1e-4) AS clipped, greatest(y, 1e-6) / greatest(forecast, 1e-4) - ln(greatest(y, 1e-6) / greatest(forecast, 1e-4)) - 1 AS qlike, (y - greatest(forecast, 1e-4)) * (y - greatest(forecast, 1e-4)) AS se FROM sample)"""
_UNITS = f"{_MARKET}, units AS (SELECT date, vix_close, (lag(iv30) OVER (ORDER BY date) - 252 * dv_cc) / 22 AS carry, -(iv30 - lag(iv30) OVER (ORDER BY date)) * (21::DOUBLE / 22) AS m2m FROM feat), u AS (SELECT date, carry + m2m AS x FROM units WHERE carry + m2m IS NOT NULL)"
def _weights(head: str) -> str:
    """Weights of five strategies for each series of ``feat``."""
    cells = {"always_short": ("1::DOUBLE", 1), "naive_binary": ("CASE WHEN s > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END", 1), "naive_binary_5d": ("CASE WHEN s > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END", 5), "naive_linear": ("linear", 1), "naive_linear_5d": ("linear", 5)}
    rows = " UNION ALL ".join(f"SELECT series_id, date, '{n}' AS strategy, {w} AS base_w, {k} AS rebalance_every FROM lin" for n, (w, k) in cells.items())
    return f"""{head}, sig AS (SELECT series_id, date, rv_cc_trail_22 AS rv, iv30 - rv_cc_trail_22 AS s FROM feat),
normed AS (SELECT *, CASE WHEN count(CASE WHEN s > 0 THEN s END) OVER p >= 252 THEN median(CASE WHEN s > 0 THEN s END) OVER p END AS norm FROM sig WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lin AS (SELECT *, CASE WHEN s / norm IS NOT NULL THEN least(greatest(s / norm, 0), 1.5) END AS linear FROM normed WHERE rv IS NOT NULL),
weights AS ({rows})"""


def _simulation(head: str, spreads: str = "0.5") -> str:
    """The simulation as a recursion over the days of each series, strategy and half spread, up to ``sim``."""
    cost = "(vix_close / 100 + h / 100) * (vix_close / 100 + h / 100) - vix_close / 100 * (vix_close / 100)"
    return f"""{_weights(head.replace("WITH ", "WITH RECURSIVE ", 1))}, raw_units AS (SELECT series_id, date, vix_close, (lag(iv30) OVER w - 252 * dv_cc) / 22 - (iv30 - lag(iv30) OVER w) * (21::DOUBLE / 22) AS unit FROM feat WINDOW w AS (PARTITION BY series_id ORDER BY date)),
scaled AS (
  SELECT series_id, strategy, h, date, base_w, rebalance_every, unit, {cost} AS spread, i, scale FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, strategy ORDER BY date) - 1 AS i, CASE WHEN count(unit) OVER k >= 30 THEN CASE WHEN stddev_samp(unit) OVER k = 0 THEN 1.5 ELSE least(0.1::DOUBLE / (stddev_samp(unit) OVER k * sqrt(252)), 1.5) END END AS scale
    FROM weights JOIN raw_units USING (series_id, date) WINDOW k AS (PARTITION BY series_id, strategy ORDER BY date ROWS 65 PRECEDING)), (SELECT unnest([{spreads}])::DOUBLE AS h)
), run AS (
  SELECT series_id, strategy, h, i, date, 0::DOUBLE AS gross, 0::DOUBLE AS cost, CASE WHEN base_w * scale IS NOT NULL THEN least(greatest(base_w * scale, 0), 1.5) ELSE 0::DOUBLE END AS w, 0::DOUBLE AS mtd, false AS stopped, unit FROM scaled WHERE i = 0
  UNION ALL
  SELECT series_id, strategy, h, i, date, gross, turn * spread, goal, before_cost - turn * spread, halt, unit FROM (
    SELECT *, w0 / 22 + abs(goal - w0) AS turn FROM (
      SELECT *, CASE WHEN halt THEN 0::DOUBLE WHEN i % rebalance_every <> 0 THEN w0 WHEN base_w * scale IS NOT NULL THEN least(greatest(base_w * scale, 0), 1.5) ELSE 0::DOUBLE END AS goal FROM (
        SELECT *, (same_month AND stopped0) OR before_cost < -0.05::DOUBLE AS halt FROM (
          SELECT s.series_id, s.strategy, s.h, s.i, s.date, s.base_w, s.scale, s.rebalance_every, s.spread, s.unit, r.w AS w0, r.stopped AS stopped0, date_trunc('month', s.date) = date_trunc('month', r.date) AS same_month,
            coalesce(r.w * s.unit, 0) AS gross, CASE WHEN date_trunc('month', s.date) = date_trunc('month', r.date) THEN r.mtd ELSE 0::DOUBLE END + coalesce(r.w * s.unit, 0) AS before_cost
          FROM run r JOIN scaled s ON s.series_id = r.series_id AND s.strategy = r.strategy AND s.h = r.h AND s.i = r.i + 1))))
), sim AS (SELECT series_id, strategy, h, date, w, gross, paid AS cost, gross - paid AS net, unit FROM (SELECT run.*, CASE WHEN run.i = 0 THEN run.w * z.spread ELSE run.cost END AS paid FROM run JOIN scaled z USING (series_id, strategy, h, i)))"""


def _phi(x: str) -> str:
    """Normal distribution function by its series about zero, in nested form."""
    z, inner = f"(({x}) * ({x}))", "1.0::DOUBLE"
    for k in range(201, 1, -2):
        inner = f"1 + z / {k} * ({inner})"
    return f"(SELECT CASE WHEN x > 8 THEN 1.0::DOUBLE WHEN x < -8 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + exp(-z / 2) / sqrt(2 * pi()) * x * ({inner}) END FROM (SELECT ({x})::DOUBLE AS x, {z}::DOUBLE AS z))"


def _performance(rows: str, keys: str) -> str:
    """Metrics of ``x`` by group of ``rows`` (a table with keys, date, x)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""present AS (SELECT * FROM {rows} WHERE x IS NOT NULL), cuts AS (SELECT {keys}, quantile_cont(x, 0.05) AS q5, quantile_cont(x, 0.01) AS q1 FROM present GROUP BY {keys}),
eq AS (SELECT {keys}, date, sum(x) OVER (PARTITION BY {keys} ORDER BY date) AS equity FROM present), dd AS (SELECT {keys}, min(equity - peak) AS max_dd FROM (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY date) AS peak FROM eq) GROUP BY {keys}),
tails AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, avg(CASE WHEN x <= q5 THEN x END) AS cvar95, avg(CASE WHEN x <= q1 THEN x END) AS cvar99, any_value(q5) AS var95, any_value(q1) AS var99 FROM present a JOIN cuts b ON {on} GROUP BY ALL),
moments AS (SELECT {keys}, {_MOMENTS}, avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS hit FROM present GROUP BY {keys})"""


def _har(name: str, horizon: int) -> str:
    """One walk-forward regression: per block its training rows are orthogonalised column by column, the asked rows with them."""
    rv = [f"rv_cc_trail_{n}" for n in (1, 5, 22)]
    part = lambda n: f"CASE WHEN bv_trail_{n} IS NULL THEN rv_cc_trail_{n} ELSE least(bv_trail_{n}, rv_cc_trail_{n}) END"
    x = {"har_cj": [rv[0], part(5), "jump_5", part(22), "jump_22"], "har_j": [*rv, "jump_22"]}.get(name, rv + (["iv30"] if name.endswith("iv") else []))
    log, y = "log" in name, f"target_rv_{horizon}"
    if log:
        x, y = ([f"CASE WHEN {c} IS NOT NULL THEN ln(greatest({c}, 1e-5::DOUBLE)) END" for c in cols] for cols in (x, [y]))
        y = y[0]
    k = len(x)
    over = "FILTER (WHERE t) OVER (PARTITION BY b)"
    names = [f"x{i}" for i in range(k)]
    steps, before = [], "u"
    centred = ", ".join([*(f"{n} - avg({n}) {over} AS {n}" for n in names), f"y - avg(y) {over} AS y", f"avg(y) {over} AS level", f"count(*) {over} AS n", "0::DOUBLE AS fit"])
    steps.append(f"c0 AS (SELECT b, t, date, {centred} FROM u)")
    for j in range(k):
        rest = [f"{n} - {names[j]} * (sum({n} * {names[j]}) {over} / sum({names[j]} * {names[j]}) {over}) AS {n}" for n in names[j + 1 :]]
        steps.append(f"c{j + 1} AS (SELECT b, t, date, {', '.join([*rest, 'y', 'level', 'n'])}, fit + {names[j]} * (sum(y * {names[j]}) {over} / sum({names[j]} * {names[j]}) {over}) AS fit FROM c{j})")
    ahead = f"exp(level + fit) * avg(exp(y - fit)) {over}" if log else "level + fit"
    return f"""SELECT 'asset' AS series_id, CAST(date AS VARCHAR) AS date, {horizon} AS horizon, '{name}' AS model, CASE WHEN n >= 252 THEN round(forecast, 8) END AS forecast FROM (
  WITH d AS (SELECT date, pos, {", ".join(f"{c} AS {n}" for c, n in zip(x, names))}, {y} AS y FROM pos), asked AS (SELECT pos.date, pos.pos, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM pos, cut WHERE date >= DATE '1998-01-01' AND pos <= last - {horizon}),
  blocks AS (SELECT ordinal // 22 AS b, min(pos) AS first FROM asked GROUP BY 1),
  u AS (SELECT b, true AS t, date, {", ".join(names)}, y FROM blocks JOIN d ON d.pos <= first - {horizon} WHERE {" AND ".join(f"{n} IS NOT NULL" for n in [*names, "y"])} UNION ALL SELECT ordinal // 22, false, d.date, {", ".join(names)}, NULL FROM asked JOIN d ON asked.pos = d.pos),
  {", ".join(steps)} SELECT t, date, n, {ahead} AS forecast FROM c{k}) WHERE NOT t"""


def _mz(forecast: str, lag: int) -> str:
    """Calibration regression with robust Wald test of the sample's ``forecast``, up to ``mz``."""
    lags = ", ".join(f"lag(u, {k}) OVER w AS u{k}, lag(v, {k}) OVER w AS v{k}" for k in range(1, lag + 1))
    weigh = lambda a, b: f"sum({a} * {b}) + " + " + ".join(f"{1 - k / (lag + 1)!r}::DOUBLE * coalesce(sum({a} * {b}{k} + {a}{k} * {b}), 0)" for k in range(1, lag + 1))
    return f"""cal AS (SELECT model, regr_intercept(y, {forecast}) AS alpha, regr_slope(y, {forecast}) AS beta, regr_r2(y, {forecast}) AS r2, count(*) AS n, avg({forecast}) AS mf, avg({forecast} * {forecast}) AS mff FROM lossed GROUP BY model),
errs AS (SELECT lossed.model, date, y - alpha - beta * {forecast} AS u, (y - alpha - beta * {forecast}) * {forecast} AS v FROM lossed JOIN cal USING (model)), lagged_errs AS (SELECT model, u, v, {lags} FROM errs WINDOW w AS (PARTITION BY model ORDER BY date)),
meat AS (SELECT model, {weigh("u", "u")} AS suu, {weigh("u", "v")} AS suv, {weigh("v", "v")} AS svv FROM lagged_errs GROUP BY model),
mz AS (SELECT model, n, alpha, beta, r2, (svv * g1 * g1 - 2 * suv * g1 * g2 + suu * g2 * g2) / (suu * svv - suv * suv) AS wald FROM (SELECT *, n * (alpha + mf * (beta - 1)) AS g1, n * (mf * alpha + mff * (beta - 1)) AS g2 FROM cal JOIN meat USING (model)))"""


def _rounded(names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names.split())


def _rounded_as(columns: str, digits: int = 6) -> str:
    """``expression AS name, ...`` with each expression rounded."""
    cells = [c.rsplit(" AS ", 1) for c in columns.split(", ")]
    return ", ".join(f"round({x}, {digits}) + 0.0::DOUBLE AS {n}" for x, n in cells)


_TEXT_DATE = "CAST(date AS VARCHAR) AS date"
_EXAMPLES = "array_to_string(list_sort(list(CAST(date AS VARCHAR) ORDER BY date) FILTER (WHERE k <= 3)), ',') AS examples"


def _issues(source: str, rules: list[tuple[str, str, str]]) -> str:
    hits = " UNION ALL ".join(f"SELECT series_id, '{sev}' AS severity, '{code}' AS code, date FROM flagged WHERE {cond}" for code, sev, cond in rules)
    return f"{source}, hits AS (SELECT *, row_number() OVER (PARTITION BY series_id, severity, code ORDER BY date) AS k FROM ({hits})) SELECT series_id, severity, code, count(*) AS n, {_EXAMPLES} FROM hits GROUP BY series_id, severity, code"


def _first(table: str) -> str:
    cols = ", ".join(f"arg_min({{'v': {c}}}, bar_id).v AS {c}" for c in ("open", "high", "low", "close"))
    return f"WITH flagged AS (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY date) AS before FROM (SELECT series_id, date, {cols} FROM {table} WHERE date IS NOT NULL GROUP BY series_id, date))"


_NAN_SAFE_CHANGE = "CASE WHEN close > 0 AND before > 0 THEN abs(ln(close / before)) END"
_LAGS = 22
_NW = ", ".join(f"coalesce(sum(d * l{k}), 0) AS s{k}" for k in range(1, _LAGS + 1))
_NW_LAG = ", ".join(f"lag(d, {k}) OVER (PARTITION BY model ORDER BY date) AS l{k}" for k in range(1, _LAGS + 1))
_NW_SUM = " + ".join(["s0", *(f"CASE WHEN {k} <= least({_LAGS}, n - 1) THEN 2 * (1 - {k} / (least({_LAGS}, n - 1) + 1)) * s{k} ELSE 0 END" for k in range(1, _LAGS + 1))])


def _lrv(values: str) -> str:
    return f"""centred AS (SELECT model, date, x - avg(x) OVER (PARTITION BY model) AS d, avg(x) OVER (PARTITION BY model) AS m FROM ({values})), lagged AS (SELECT *, {_NW_LAG} FROM centred),
sums AS (SELECT model, count(*) AS n, any_value(m) AS mean, sum(d * d) AS s0, {_NW} FROM lagged GROUP BY model), lrv AS (SELECT model, n, mean, greatest(({_NW_SUM}) / n, 1e-300) AS lrv FROM sums)"""


_MOMENTS = "count(*) AS n, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4, stddev_samp(x) AS sd"
_SKEW = "(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5)"
_KURT = "(m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / pow(m2 - m1 * m1, 2)"
_EQUITY = f"{_UNITS}, eq AS (SELECT date, sum(x) OVER (ORDER BY date) AS equity FROM u), dd AS (SELECT date, equity, equity - max(equity) OVER (ORDER BY date) AS drawdown FROM eq)"
_FEATURE_NAMES = "spx_open spx_high spx_low spx_close vix_close ret_cc dv_cc dv_parkinson dv_garman_klass dv_rogers_satchell dv_yang_zhang22 rv_cc_trail_1 rv_gk_trail_1 rv_pk_trail_1 target_rv_1 rv_cc_trail_5 rv_gk_trail_5 rv_pk_trail_5 target_rv_5 rv_cc_trail_22 rv_gk_trail_22 rv_pk_trail_22 target_rv_22 bv_trail_5 bv_trail_22 jump_5 jump_22 iv30 vrp_expost"

_REGISTRY = """SELECT DISTINCT 'orders' AS phase, o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS horizon, '{"status":"' || o_orderstatus || '"}' AS params, 'all' AS eval_window FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_orderpriority = o.o_orderpriority AND year(f.o_orderdate) = year(o.o_orderdate) AND f.o_orderstatus = o.o_orderstatus)"""
_SPREADS = ", ".join(str(x / 4) for x in range(13))
_SHARPES = f"{_simulation(_MARKET, _SPREADS)}, curve AS (SELECT strategy, h, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe FROM sim GROUP BY strategy, h)"
_DM_PAIRS = "SELECT a.model, a.date, a.qlike - b.qlike AS x FROM lossed a JOIN lossed b ON a.date = b.date WHERE a.model <> $$random_walk$$ AND b.model = $$random_walk$$"
_DM = f"{_lrv(_DM_PAIRS)}, dm AS (SELECT model, n, mean, mean / sqrt(lrv / n) AS stat FROM lrv)"


ORACLES = {
    "calendar_joint_whole": f"WITH {_SERIES} SELECT g.series_id, CAST(g.date AS VARCHAR) AS date, round(g.close, 8) AS spx_close, round(v.close, 8) AS vix_close FROM g JOIN v ON g.series_id = v.series_id AND g.date = v.date WHERE g.date >= DATE '1990-01-02'",
    "walkforward_har": f"{_NUMBERED} {' UNION ALL '.join(_har(n, h) for n in ('har', 'har_log', 'har_iv', 'har_log_iv', 'har_j', 'har_cj') for h in (1, 5, 22))}",
    "breakeven_sweep": f"{_SHARPES} SELECT strategy, min(CASE WHEN sharpe <= 0 THEN h END) AS breakeven FROM curve GROUP BY strategy",
    "spread_curve": f"{_SHARPES} SELECT strategy, h AS half_spread, round(sharpe, 6) + 0.0::DOUBLE AS sharpe FROM curve",
    "perf_summary": f"{_simulation(_MARKET)}, {_performance('(SELECT strategy, date, net AS x FROM sim)', 'strategy')} SELECT m.strategy, n, {_rounded_as('m1 * 252 AS ann_return, sd * sqrt(252) AS ann_vol, m1 * 252 / (sd * sqrt(252)) AS sharpe, max_dd AS max_dd')}, round({_SKEW}, 6) + 0.0::DOUBLE AS skew, round({_KURT}, 6) + 0.0::DOUBLE AS kurtosis, {_rounded_as('var95 AS var95, cvar95 AS cvar95, var99 AS var99, cvar99 AS cvar99, hit AS hit_rate')} FROM moments m JOIN tails t ON m.strategy = t.strategy JOIN dd ON m.strategy = dd.strategy",
    "deflated_sharpe": f"""{_simulation(_MARKET)}, tried AS (SELECT count(*) AS trials FROM ({_REGISTRY})), levels AS (SELECT unnest([1 - 1.0::DOUBLE / trials, 1 - 1.0::DOUBLE / (trials * exp(1.0::DOUBLE))]) AS p, unnest([1, 2]) AS which, trials FROM tried),
bisect AS (SELECT which, p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS k FROM levels UNION ALL SELECT which, p, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, k + 1 FROM (SELECT *, {_phi("mid")} < p AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE k < 60))),
found AS (SELECT (1 - 0.5772156649015329::DOUBLE) * max(CASE WHEN which = 1 THEN lo END) + 0.5772156649015329::DOUBLE * max(CASE WHEN which = 2 THEN lo END) AS best FROM bisect WHERE k = 60),
m AS (SELECT strategy, {_MOMENTS} FROM (SELECT strategy, net AS x FROM sim) GROUP BY strategy), g AS (SELECT strategy, n, m1 / sd AS sr, {_SKEW} AS g3, {_KURT} AS g4 FROM m), shaped AS (SELECT *, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr AS shape FROM g),
judged AS (SELECT *, sqrt(greatest(shape / (n - 1), 1e-12)) * best AS bench FROM shaped, found)
SELECT strategy, round(sr * sqrt(252), 6) AS sharpe_ann, round({_phi("(sr - bench) * sqrt(n - 1) / sqrt(shape)")}, 6) + 0.0::DOUBLE AS dsr, round(bench * sqrt(252), 6) AS benchmark_ann, CAST(trials AS INTEGER) AS trials FROM judged, tried""",
    "net_edge": f"{_simulation(_MARKET)}, {_lrv('SELECT a.strategy AS model, a.date, a.net - b.net AS x FROM sim a JOIN sim b ON a.date = b.date WHERE a.strategy <> $$always_short$$ AND b.strategy = $$always_short$$')}, edge AS (SELECT model, n, mean, mean / sqrt(lrv / n) AS stat FROM lrv) SELECT model AS strategy, n, round(mean, 6) + 0.0::DOUBLE AS mean_daily_diff, round(mean * 252, 6) + 0.0::DOUBLE AS ann_diff, round(stat, 6) + 0.0::DOUBLE AS t_stat, round(2 * (1 - {_phi('abs(stat)')}), 6) + 0.0::DOUBLE AS p_value FROM edge",
    "dm_sample": f"{_PANEL}, {_DM} SELECT model, n, round(mean, 6) AS mean_diff, round(stat, 6) AS stat, round(2 * (1 - {_phi('abs(stat)')}), 6) + 0.0::DOUBLE AS p_value FROM dm",
    "mz_sample": f"{_PANEL}, {_mz('forecast', 22)} SELECT model, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, round(wald, 4) AS wald, round(exp(-wald / 2), 6) + 0.0::DOUBLE AS p_joint FROM mz",
    "score_table_sample": f"{_PANEL}, base AS (SELECT sum(se) AS b FROM lossed WHERE model = 'expanding_mean'), scored AS (SELECT model, count(*) AS n, avg(qlike) AS qlike, avg(se) * 1e4 AS mse, 1 - sum(se) / any_value(b) AS r2_oos, count(*) FILTER (WHERE forecast < 1e-4) AS n_clipped FROM lossed, base GROUP BY model), {_mz('clipped', 22)}, {_DM} SELECT s.model, s.n, round(qlike, 6) AS qlike, round(mse, 6) AS mse_x1e4, round(r2_oos, 6) + 0.0::DOUBLE AS oos_r2, n_clipped, round(alpha, 6) AS mz_alpha, round(beta, 6) AS mz_beta, round(r2, 6) AS mz_r2, round(exp(-wald / 2), 6) + 0.0::DOUBLE AS mz_p, round(stat, 6) AS dm_stat, round(2 * (1 - {_phi('abs(stat)')}), 6) + 0.0::DOUBLE AS dm_p FROM scored s JOIN mz ON s.model = mz.model LEFT JOIN dm ON s.model = dm.model",
    "series_sim": f"{_simulation(_WIDE)} SELECT series_id, strategy, h AS half_spread, {_TEXT_DATE}, round(w, 6) AS w, round(gross, 6) + 0.0::DOUBLE AS pnl_gross, round(cost, 6) + 0.0::DOUBLE AS cost, round(net, 6) + 0.0::DOUBLE AS pnl_net, round(unit, 6) + 0.0::DOUBLE AS unit_pnl FROM sim",
    "series_performance": f"{_simulation(_WIDE)}, {_performance('(SELECT series_id, strategy, date, net AS x FROM sim)', 'series_id, strategy')} SELECT m.series_id, m.strategy, n, {_rounded_as('m1 * 252 AS ann_return, max_dd AS max_dd, var95 AS var95, cvar95 AS cvar95, hit AS hit_rate')} FROM moments m JOIN tails t ON m.series_id = t.series_id AND m.strategy = t.strategy JOIN dd ON m.series_id = dd.series_id AND m.strategy = dd.strategy",
    "series_scores": f"""{_WIDE}, panel AS (SELECT series_id, date, target_rv_22 AS y, unnest(['random_walk', 'vix']) AS model, unnest([rv_cc_trail_22, iv30]) AS forecast FROM feat),
sample AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, date) AS have FROM panel WHERE y IS NOT NULL AND forecast IS NOT NULL) WHERE have = 2),
lossed AS (SELECT series_id || '|' || model AS model, series_id, model AS name, date, greatest(y, 1e-6) / greatest(forecast, 1e-4) - ln(greatest(y, 1e-6) / greatest(forecast, 1e-4)) - 1 AS qlike, (y - greatest(forecast, 1e-4)) * (y - greatest(forecast, 1e-4)) AS se FROM sample), {_lrv('SELECT model, date, qlike AS x FROM lossed')}
SELECT split_part(l.model, '|', 1) AS series_id, split_part(l.model, '|', 2) AS model, n, round(mean, 6) AS mean, round(lrv, 6) AS lrv FROM lrv l""",
    "bars_daily": f"WITH {_ASSET} SELECT series_id, {_TEXT_DATE}, {_rounded('open high low close')} FROM asset",
    "iv_daily": f"WITH {_ASSET} SELECT series_id, {_TEXT_DATE}, {_rounded('close', 5)} FROM asset_iv",
    "events_bars": "SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(arg_min(value, row(ts, event_id)), 8) AS open, round(max(value), 8) AS high, round(min(value), 8) AS low, round(arg_max(value, row(ts, event_id)), 8) AS close, count(value) AS n FROM events GROUP BY 1, 2",
    "series_bars_first": f"WITH {_SERIES} SELECT series_id, {_TEXT_DATE}, {_rounded('open high low close')} FROM g",
    "calendar_joint": f"WITH {_SERIES} SELECT g.series_id, CAST(g.date AS VARCHAR) AS date, round(g.close, 8) AS spx_close, round(v.close, 8) AS vix_close FROM g JOIN v ON g.series_id = v.series_id AND g.date = v.date WHERE g.date >= DATE '2000-01-03'",
    "calendar_dropped": f"WITH {_SERIES} SELECT series_id, 'index_only' AS side, count(*) AS days FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.series_id = g.series_id AND v.date = g.date) GROUP BY series_id UNION ALL SELECT series_id, 'implied_only', count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM g WHERE v.series_id = g.series_id AND v.date = g.date) GROUP BY series_id",
    "crosscheck": f"WITH {_bars('g', 'gspc')}, {_bars('o', 'spx_stooq')}, d AS (SELECT g.series_id, abs(o.close / g.close - 1) AS x FROM g JOIN o ON g.series_id = o.series_id AND g.date = o.date) SELECT series_id, count(x) AS days, round(median(x), 8) AS median_diff, round(max(x), 8) AS max_diff, count(*) FILTER (WHERE x > 0.002::DOUBLE) AS days_over_20bp FROM d WHERE x IS NOT NULL GROUP BY series_id",
    "quality_index": f"""WITH counted AS (SELECT series_id, date, count(*) AS copies, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS before FROM gspc WHERE date IS NOT NULL GROUP BY series_id, date),
gaps AS (SELECT *, len(list_filter(generate_series(before, date - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS gap FROM counted), worst AS (SELECT series_id, max(gap) AS most FROM gaps GROUP BY series_id),
back AS (SELECT series_id, date, lag(date) OVER (PARTITION BY series_id ORDER BY bar_id) > date AS unsorted FROM gspc WHERE date IS NOT NULL),
raw AS (SELECT series_id, 'error' AS severity, 'dup_dates' AS code, date FROM gaps WHERE copies > 1 UNION ALL SELECT series_id, 'error', 'weekend', date FROM gaps WHERE isodow(date) >= 6
  UNION ALL SELECT gaps.series_id, CASE WHEN most > 10 THEN 'error' ELSE 'warn' END, 'calendar_gap', date FROM gaps JOIN worst ON gaps.series_id IS NOT DISTINCT FROM worst.series_id WHERE gap > 3 UNION ALL SELECT series_id, 'error', 'unsorted', date FROM back WHERE unsorted),
hits AS (SELECT *, row_number() OVER (PARTITION BY series_id, severity, code ORDER BY date) AS k FROM raw)
SELECT series_id, severity, code, count(*) AS n, {_EXAMPLES} FROM hits GROUP BY series_id, severity, code""",
    "quality_ohlc": _issues(
        _first("gspc"),
        [
            ("nonpositive", "error", "least(open, high, low, close) <= 0"),
            ("high_violated", "error", "high + 1e-9 < open OR high + 1e-9 < close OR high + 1e-9 < low"),
            ("low_violated", "error", "low - 1e-9 > open OR low - 1e-9 > close"),
            ("range", "warn", "close < 100 OR close > 50000"),
            ("wild_return", "warn", f"{_NAN_SAFE_CHANGE} > 0.35::DOUBLE"),
        ],
    ),
    "quality_ohlc_shares": f"""{_first("gspc")}, shares AS (SELECT series_id, avg(CASE WHEN coalesce(round_even(open, 4) = round_even(before, 4), false) THEN 1 ELSE 0 END) AS a, avg(CASE WHEN coalesce(round_even(high, 6) = round_even(low, 6), false) THEN 1 ELSE 0 END) AS b FROM flagged GROUP BY series_id)
SELECT series_id, 'info' AS severity, 'open_eq_prevclose' AS code, CAST(round(a * 10000) AS BIGINT) AS n FROM shares UNION ALL SELECT series_id, 'info', 'zero_range_days', CAST(round(b * 10000) AS BIGINT) FROM shares""",
    "quality_close": _issues(
        _first("vix"),
        [
            ("nonpositive", "error", "close <= 0"),
            ("range", "warn", "close < 4 OR close > 200"),
            ("ohlc_fields_inconsistent", "warn", "high + 1e-9 < open OR high + 1e-9 < close OR high + 1e-9 < low OR low - 1e-9 > open OR low - 1e-9 > close"),
        ],
    ),
    "quality_variance": _issues("WITH flagged AS (SELECT * FROM features)", [(f"negative_{c}", "error", f"{c} < -1e-9") for c in ("dv_cc", "dv_parkinson", "dv_garman_klass", "dv_rogers_satchell")]),
    "dv_estimators": f"{_WIDE} SELECT series_id, {_TEXT_DATE}, {_rounded('ret_cc dv_cc dv_parkinson dv_garman_klass dv_rogers_satchell')} FROM feat",
    "yang_zhang": f"{_WIDE} SELECT series_id, {_TEXT_DATE}, {_rounded('dv_yang_zhang22')} FROM feat",
    "rv_trailing": f"{_WIDE} SELECT series_id, {_TEXT_DATE}, {_rounded(' '.join(f'rv_{k}_trail_{n}' for k in ('cc', 'gk', 'pk') for n in (1, 5, 22)))} FROM feat",
    "rv_forward": f"{_WIDE} SELECT series_id, {_TEXT_DATE}, {_rounded('target_rv_1 target_rv_5 target_rv_22 vrp_expost')} FROM feat",
    "bipower_jump": f"{_WIDE} SELECT series_id, {_TEXT_DATE}, {_rounded('bv_trail_5 bv_trail_22 jump_5 jump_22')} FROM feat",
    "features_full": f"{_MARKET} SELECT series_id, {_TEXT_DATE}, {_rounded(_FEATURE_NAMES, 7)}, spx_open_synthetic, {', '.join(f'CAST(NULL AS DOUBLE) AS {n}' for n in ('vix9d_close', 'vix3m_close', 'vix6m_close', 'iv9d', 'iv3m', 'iv6m'))} FROM feat",
    "open_synthetic_by_year": f"{_WIDE} SELECT CAST(year(date) AS INTEGER) AS year, round(avg(CASE WHEN spx_open_synthetic THEN 1 ELSE 0 END), 8) AS share_synthetic FROM feat GROUP BY 1",
    "vrp_summary_by_period": f"""{_MARKET}, d AS (SELECT *, CAST(year(date) // 10 * 10 AS VARCHAR) || 's' AS decade FROM feat WHERE iv30 IS NOT NULL AND target_rv_22 IS NOT NULL)
SELECT CASE WHEN grouping(decade) = 1 THEN 'full sample' ELSE decade END AS period, count(*) AS days, round(avg(vix_close), 6) AS mean_iv_points, round(avg(sqrt(target_rv_22) * 100), 6) AS mean_fwd_vol_points, round(avg(iv30), 6) AS mean_iv, round(avg(target_rv_22), 6) AS mean_fwd_rv, round(avg(vrp_expost), 6) AS mean_vrp, round(avg(CASE WHEN vrp_expost > 0 THEN 1 ELSE 0 END), 6) AS share_positive FROM d GROUP BY GROUPING SETS ((decade), ())""",
    "estimator_table": f"""{_MARKET}, d AS (SELECT * FROM feat WHERE dv_cc IS NOT NULL AND dv_parkinson IS NOT NULL AND dv_garman_klass IS NOT NULL AND dv_rogers_satchell IS NOT NULL AND dv_yang_zhang22 IS NOT NULL),
late AS (SELECT *, {", ".join(f"{_full('sum', n, _back(22), 22)} AS s_{n}" for n in ("dv_cc", "dv_parkinson", "dv_garman_klass", "dv_rogers_satchell", "dv_yang_zhang22"))} FROM d WHERE date >= DATE '1998-01-01' WINDOW w AS (PARTITION BY series_id ORDER BY date))
{" UNION ALL ".join(f"SELECT '{v}' AS estimator, (SELECT round(sqrt(avg({n}) * 252) * 100, 6) FROM d) AS vol_full, round(sqrt(avg({n}) * 252) * 100, 6) AS vol_since, round(corr(s_{n}, s_dv_cc), 6) AS corr_cc FROM late" for n, v in {"dv_cc": "cc", "dv_parkinson": "parkinson", "dv_garman_klass": "garman_klass", "dv_rogers_satchell": "rogers_satchell", "dv_yang_zhang22": "yang_zhang"}.items())}""",
    "baseline_random_walk": f"{_MARKET} " + " UNION ALL ".join(f"SELECT series_id, {_TEXT_DATE}, {h} AS horizon, 'random_walk' AS model, round(rv_cc_trail_{h}, 8) AS forecast FROM feat" for h in (1, 5, 22)),
    "baseline_expanding_mean": f"{_MARKET} SELECT series_id, {_TEXT_DATE}, h AS horizon, 'expanding_mean' AS model, round(f, 8) AS forecast FROM (SELECT series_id, date, unnest([1, 5, 22]) AS h, f FROM (SELECT series_id, date, CASE WHEN count(dv_cc) OVER (ORDER BY date) >= 252 THEN avg(dv_cc * 252) OVER (ORDER BY date) END AS f FROM feat))",
    "baseline_ewma": f"""{_MARKET.replace("WITH ", "WITH RECURSIVE ", 1)}, n AS (SELECT date, dv_cc, row_number() OVER (ORDER BY date) AS i FROM feat),
e AS (SELECT i, date, dv_cc AS s FROM n WHERE i = 1 UNION ALL SELECT n.i, n.date, CASE WHEN e.s IS NULL THEN n.dv_cc ELSE 0.94::DOUBLE * e.s + 0.06::DOUBLE * n.dv_cc END FROM e JOIN n ON n.i = e.i + 1)
SELECT 'asset' AS series_id, {_TEXT_DATE}, 22 AS horizon, 'ewma_riskmetrics' AS model, round(s * 252, 8) AS forecast FROM e""",
    "eval_index": f"""{_NUMBERED} SELECT 'dev' AS part, {_TEXT_DATE}, pos, ordinal FROM dev UNION ALL SELECT 'holdout', CAST(date AS VARCHAR), pos, row_number() OVER (ORDER BY date) - 1 FROM pos WHERE date > DATE '1999-12-31' AND pos <= n_pos - 1 - 22""",
    "walkforward_uni": f"{_UNI} SELECT 'asset' AS series_id, {_TEXT_DATE}, 22 AS horizon, 'ols_rv_cc_trail_22' AS model, round(forecast, 8) AS forecast FROM uni",
    "common_sample": f"{_PANEL} SELECT 'asset' AS series_id, {_TEXT_DATE}, 22 AS horizon, model, round(forecast, 8) AS forecast, round(y, 8) AS y FROM sample",
    "loss_scores": f"{_PANEL}, base AS (SELECT sum(se) AS b FROM lossed WHERE model = 'expanding_mean') SELECT 22 AS horizon, model, count(*) AS n, round(avg(qlike), 6) AS qlike, round(avg(se) * 1e4, 6) AS mse_x1e4, round(1 - sum(se) / any_value(b), 6) + 0.0::DOUBLE AS oos_r2, count(*) FILTER (WHERE forecast < 1e-4) AS n_clipped FROM lossed, base GROUP BY model",
    "oos_r2": f"{_PANEL} SELECT 22 AS horizon, round(1 - sum((a.y - a.forecast) * (a.y - a.forecast)) / sum((b.y - b.forecast) * (b.y - b.forecast)), 6) AS oos_r2 FROM sample a JOIN sample b ON a.date = b.date WHERE a.model = 'vix' AND b.model = 'expanding_mean'",
    "newey_west_lrv": f"{_PANEL}, {_lrv('SELECT model, date, qlike AS x FROM lossed')} SELECT model, n, round(mean, 6) AS mean, round(lrv, 6) AS lrv FROM lrv",
    "dm_stat": f"{_PANEL}, {_lrv('SELECT a.model, a.date, a.qlike - b.qlike AS x FROM lossed a JOIN lossed b ON a.date = b.date WHERE a.model <> $$random_walk$$ AND b.model = $$random_walk$$')} SELECT model, n, round(mean, 6) AS mean_diff, round(mean / sqrt(lrv / n), 6) AS stat FROM lrv",
    "mz_ols": f"{_PANEL} SELECT model, count(*) AS n, round(regr_intercept(y, forecast), 6) AS alpha, round(regr_slope(y, forecast), 6) AS beta, round(regr_r2(y, forecast), 6) AS r2 FROM sample GROUP BY model",
    "config_registry": _REGISTRY,
    "weights": f"{_weights(_MARKET)} SELECT {_TEXT_DATE}, strategy, round(base_w, 6) AS base_w, rebalance_every FROM weights",
    "unit_pnl": f"{_UNITS} SELECT {_TEXT_DATE}, {_rounded('carry m2m')}, round(carry + m2m, 8) + 0.0::DOUBLE AS unit_pnl, round((vix_close / 100 + 0.005::DOUBLE) * (vix_close / 100 + 0.005::DOUBLE) - vix_close / 100 * (vix_close / 100), 8) AS spread_cost FROM units",
    "turnover": f"{_weights(_MARKET)} SELECT strategy, {_TEXT_DATE}, round(before / 22 + abs(base_w - before), 6) AS turnover FROM (SELECT *, coalesce(lag(base_w) OVER (PARTITION BY strategy ORDER BY date), 0) AS before FROM weights WHERE base_w IS NOT NULL)",
    "strategy_sim": f"{_simulation(_MARKET)} SELECT strategy, h AS half_spread, {_TEXT_DATE}, round(w, 6) AS w, round(gross, 6) + 0.0::DOUBLE AS pnl_gross, round(cost, 6) + 0.0::DOUBLE AS cost, round(net, 6) + 0.0::DOUBLE AS pnl_net, round(unit, 6) + 0.0::DOUBLE AS unit_pnl FROM sim",
    "perf_unit": f"""{_EQUITY}, m AS (SELECT {_MOMENTS}, quantile_cont(x, 0.05) AS q5, quantile_cont(x, 0.01) AS q1, avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS hit FROM u)
SELECT 'unit' AS strategy, n, round(m1 * 252, 6) AS ann_return, round(sd * sqrt(252), 6) AS ann_vol, round(m1 * 252 / (sd * sqrt(252)), 6) AS sharpe, (SELECT round(min(drawdown), 6) FROM dd) AS max_dd, round({_SKEW}, 6) AS skew, round({_KURT}, 6) AS kurtosis,
  round(q5, 6) AS var95, (SELECT round(avg(x), 6) FROM u WHERE x <= q5) AS cvar95, round(q1, 6) AS var99, (SELECT round(avg(x), 6) FROM u WHERE x <= q1) AS cvar99, round(hit, 6) AS hit_rate FROM m""",
    "drawdown_series": f"{_EQUITY} SELECT 'unit' AS strategy, {_TEXT_DATE}, {_rounded('equity drawdown', 6)} FROM dd",
    "drawdown_top5": f"""{_EQUITY}, isl AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (ORDER BY date) AS island, lead(date) OVER (ORDER BY date) AS next FROM dd),
e AS (SELECT island, min(date) AS start, arg_min(date, row(drawdown, date)) AS trough, arg_max(CASE WHEN next IS NULL THEN DATE '0001-01-01' ELSE next END, date) AS stop, min(drawdown) AS depth, count(*) AS n FROM isl WHERE drawdown < 0 GROUP BY island)
SELECT 'unit' AS strategy, rank, CAST(start AS VARCHAR) AS start, CAST(trough AS VARCHAR) AS trough, CASE WHEN stop > DATE '0001-01-01' THEN CAST(stop AS VARCHAR) END AS "end", round(depth, 6) AS depth, n + CASE WHEN stop > DATE '0001-01-01' THEN 1 ELSE 0 END AS days
FROM (SELECT *, row_number() OVER (ORDER BY depth, start) AS rank FROM e) WHERE rank <= 5""",
    "event_windows": f"""{_UNITS}, ev AS (SELECT 'first' AS event, DATE '1996-03-01' AS a, DATE '1996-06-28' AS b UNION ALL SELECT 'second', DATE '1999-09-01', DATE '1999-12-31')
SELECT event, 'unit' AS strategy, {_TEXT_DATE}, round(sum(x) OVER (PARTITION BY event ORDER BY date), 6) + 0.0::DOUBLE AS cumulative FROM u JOIN ev ON date BETWEEN a AND b""",
    "sharpe_moments": f"{_UNITS}, m AS (SELECT {_MOMENTS} FROM u) SELECT 'unit' AS strategy, n, round(m1 / sd, 6) AS sr, round({_SKEW}, 6) AS g3, round({_KURT}, 6) AS g4 FROM m",
    "alignment_report": f"WITH {_SERIES}, j AS (SELECT coalesce(g.series_id, v.series_id) AS series_id, g.date AS a, v.date AS b FROM g FULL OUTER JOIN v ON g.series_id = v.series_id AND g.date = v.date) SELECT series_id, count(a) AS index_days, count(b) AS implied_days, count(CASE WHEN a = b THEN 1 END) AS joint_days, CAST(min(CASE WHEN a = b THEN a END) AS VARCHAR) AS first_day, CAST(max(CASE WHEN a = b THEN a END) AS VARCHAR) AS last_day FROM j GROUP BY series_id",
    "premium_histogram": f"""{_WIDE}, q AS (SELECT quantile_cont(vrp_expost, 0.005) AS lo, quantile_cont(vrp_expost, 0.995) AS hi FROM feat), b AS (SELECT CAST(least(floor((least(greatest(vrp_expost, lo), hi) - lo) / ((hi - lo) / 80)), 79) AS INTEGER) AS bin, lo, (hi - lo) / 80 AS w FROM feat, q WHERE vrp_expost IS NOT NULL)
SELECT bin, round(any_value(lo) + bin * any_value(w), 6) + 0.0::DOUBLE AS low, round(any_value(lo) + (bin + 1) * any_value(w), 6) + 0.0::DOUBLE AS high, count(*) AS days FROM b GROUP BY bin""",
    "implied_and_realised": f"{_MARKET} SELECT series_id, {_TEXT_DATE}, round(vix_close, 6) AS vix_close, round(sqrt(target_rv_22) * 100, 6) AS realised_points FROM feat WHERE iv30 IS NOT NULL AND target_rv_22 IS NOT NULL",
    "forecasts_beside_targets": f"{_PANEL} SELECT 'asset' AS series_id, {_TEXT_DATE}, 22 AS horizon, round(max(CASE WHEN model = 'vix' THEN forecast END), 8) AS vix, round(max(CASE WHEN model = 'random_walk' THEN forecast END), 8) AS random_walk, round(any_value(y), 8) AS y FROM sample GROUP BY date",
    "equity_curves": f"{_simulation(_MARKET)} SELECT strategy, h AS half_spread, {_TEXT_DATE}, round(sum(net) OVER (PARTITION BY strategy ORDER BY date), 6) + 0.0::DOUBLE AS equity FROM sim",
}
