"""Implausible readings: tail cutoffs by peaks over threshold, stuck values, plausibility.

Every series is its own source. Its log changes, less the median of their weekday,
are the seasonal residuals; a generalised Pareto tail fitted to the exceedances over
their 90 % point gives the cutoff that an ordinary residual passes with a fixed risk. A jump
beyond the cutoff that is undone by an opposite jump beyond it within ``max_run`` readings encloses
a spike. An exact check against the nearest good readings may follow.

Rows fold to the distinct days of a series by a partial aggregate before the first exchange, so a
partition never holds more rows than the series' calendar has days, however many copies of a row
there are. The fields of a day are columns: all windows of all fields share one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nullsafe import finite


@dataclass(frozen=True)
class Reading:
    """A measured column; ``above``/``below``: it may not lie over ``tolerance`` above (below) all of these columns."""

    name: str
    above: tuple[str, ...] = ()
    below: tuple[str, ...] = ()
    tolerance: float = 0.03


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of :func:`flag_spikes`.

    risk: chance that an ordinary residual passes the tail cutoff. tail: share of the
    residuals that counts as the tail the distribution is fitted to. gross: residuals of more
    typical changes (medians of the absolute log change) than this take no part in the fit, so that
    the errors looked for do not set the cutoff they are held against. multiple: how many typical
    changes a spike must stand off from its neighbours as well; None leaves the decision to the tail alone.
    max_run: longest spike, in readings. stuck: shortest run of equal values that is stuck.
    """

    risk: float = 0.02
    tail: float = 0.10
    gross: float = 12.0
    multiple: float | None = 12.0
    max_run: int = 3
    stuck: int = 5
    fields: tuple[Reading, ...] = field(default_factory=tuple)


def pareto_cutoff(u: Column, mid: Column, far: Column, tail: float, risk: float) -> Column:
    """Level passed with probability ``risk``, for a tail beyond ``u`` of weight ``tail``.

    ``u``, ``mid`` and ``far`` are the quantiles with upper weights tail, tail/2 and tail/4;
    they determine shape and scale (Pickands' estimator), which a few gross errors in the
    tail cannot move, unlike moments. A shape of zero is the exponential tail.
    """
    near, wide = mid - u, far - mid
    shape = F.when((near > 0) & (wide > 0), F.least(F.greatest(F.log2(wide / near), F.lit(-1.0)), F.lit(2.0))).otherwise(F.lit(0.0))
    flat = F.abs(shape) < 1e-6
    scale = F.when(flat, near / F.lit(0.6931471805599453)).otherwise(near * shape / (F.pow(F.lit(2.0), shape) - 1.0))
    return u + F.when(flat, scale * F.ln(F.lit(tail / risk))).otherwise(scale * (F.pow(F.lit(tail / risk), shape) - 1.0) / F.nullif(shape, F.lit(0.0)))


def _implausible(r: Reading) -> tuple[Column, Column]:
    x = F.col(r.name)
    impossible = x.isNotNull() & (~finite(x) | (x <= 0))
    outside = F.lit(False)
    for refs, bad in ((r.above, lambda ref: x > ref * (1 + r.tolerance)), (r.below, lambda ref: x < ref * (1 - r.tolerance))):
        if refs:
            each = F.lit(True)
            for name in refs:
                each = each & F.coalesce(bad(F.col(name)), F.lit(False))
            outside = outside | each
    return impossible, outside


def _typed(bars: DataFrame, series: str, day: str, row_id: str, rules: SpikeRules) -> DataFrame:
    names = dict.fromkeys(n for r in rules.fields for n in (r.name, *r.above, *r.below))
    return bars.select(
        F.col(row_id).alias("_row"), F.col(series).alias("_series"), F.when(F.col(series).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(series).cast("string"))).alias("_key"), F.col(day).cast("date").alias("_day"), *[F.col(n).cast("double").alias(n) for n in names]
    )


def _daily(rows: DataFrame, rules: SpikeRules) -> DataFrame:
    """One row for each series and day, of the row with the smallest id: of each field its value, log and whether it lies outside its bar."""
    names = [c for c in rows.columns if not c.startswith("_")]
    # Rows without an id come after all others; the fold stays a hash aggregate, as its buffers are numbers.
    order = F.coalesce(F.col("_row"), F.lit(2**63 - 1)) if dict(rows.dtypes)["_row"] == "bigint" else F.coalesce(F.col("_row").cast("string"), F.lit("\U0010ffff"))
    days = rows.where(F.col("_day").isNotNull()).groupBy("_key", "_day").agg(F.first("_series").alias("_series"), *[F.min_by(n, order).alias(n) for n in names])
    cells = []
    for i, r in enumerate(rules.fields):
        impossible, outside = _implausible(r)
        log = F.when(F.col(r.name).isNotNull() & ~impossible, F.ln(r.name))
        cells += [F.col(r.name).alias(f"_v{i}"), log.alias(f"_all{i}"), F.when(~outside, log).alias(f"_log{i}")]
    return days.select("_key", "_series", "_day", *cells)


def _beside(x: str, k: int) -> Column:
    """``x`` of the k-th row ahead (behind, where negative) that has one."""
    which = "lead" if k > 0 else "lag"
    return F.expr(f"{which}({x}, {abs(k)}) IGNORE NULLS OVER (PARTITION BY _key ORDER BY _day)")


def _quantile(ordered: Column, p: float) -> Column:
    """Of an ordered array, with linear interpolation; null if it is empty."""
    place = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    near, far = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return near + (place - low) * (far - near)


def _scored(days: DataFrame, rules: SpikeRules) -> DataFrame:
    """Days with each field's seasonal residual, typical change and tail cutoff.

    The tail is fitted by one aggregate over each series' days and joined to them; both sides have the
    partitioning of the windows already.
    """
    every = range(len(rules.fields))
    days = days.withColumns({f"_before{i}": _beside(f"_log{i}", -1) for i in every} | {"_weekday": F.weekday("_day")})
    # A field no bar can rule out has one sequence of good readings, not two.
    earlier = [_beside(f"_all{i}", -1) if r.above or r.below else F.col(f"_before{i}") for i, r in enumerate(rules.fields)]
    days = days.withColumns({f"_step{i}": F.abs(F.col(f"_all{i}") - earlier[i]) for i in every} | {f"_change{i}": F.col(f"_log{i}") - F.col(f"_before{i}") for i in every})
    middle = lambda x: F.percentile(x, F.lit(0.5))
    seasons = [F.array(*[F.coalesce(middle(F.when(F.col("_weekday") == k, F.col(f"_change{i}"))), F.lit(0.0)) for k in range(7)]).alias(f"_season{i}") for i in every]
    moves = [F.collect_list(F.when(F.col(f"_change{i}").isNotNull(), F.struct("_weekday", F.col(f"_change{i}").alias("change")))).alias(f"_moves{i}") for i in every]
    fit = days.groupBy(F.col("_key").alias("_of")).agg(*[middle(F.col(f"_step{i}")).alias(f"_typical{i}") for i in every], *seasons, *moves)
    for i in every:
        sizes = F.transform(f"_moves{i}", lambda m: F.abs(m["change"] - F.get(F.col(f"_season{i}"), m["_weekday"])))
        fit = fit.withColumn(f"_sizes{i}", F.array_sort(F.filter(sizes, lambda x: x <= rules.gross * F.col(f"_typical{i}"))))
        points = [_quantile(F.col(f"_sizes{i}"), 1 - rules.tail / k) for k in (1, 2, 4)]
        fit = fit.withColumn(f"_cutoff{i}", pareto_cutoff(*points, rules.tail, rules.risk))
    fit = fit.select("_of", *[f"{c}{i}" for c in ("_typical", "_season", "_cutoff") for i in every])
    days = days.join(fit, F.col("_key") == F.col("_of"))
    return days.withColumns({f"_residual{i}": F.col(f"_change{i}") - F.get(F.col(f"_season{i}"), F.col("_weekday")) for i in every})


def tail_cutoffs(bars: DataFrame, rules: SpikeRules, *, series: str = "series_id", day: str = "date", row_id: str = "bar_id") -> DataFrame:
    """``series_id, day, field, residual, typical, cutoff`` of each distinct day with a good reading; the first one of a series has no residual."""
    scored = _scored(_daily(_typed(bars, series, day, row_id, rules), rules), rules)
    cells = [F.struct(F.lit(r.name).alias("field"), F.col(f"_log{i}").alias("_log"), *[F.col(f"_{c}{i}").alias(c) for c in ("residual", "typical", "cutoff")]) for i, r in enumerate(rules.fields)]
    return scored.select(F.col("_series").alias("series_id"), F.col("_day").alias("day"), F.inline(F.array(*cells))).where(F.col("_log").isNotNull()).drop("_log")


def _marked(scored: DataFrame, rules: SpikeRules) -> DataFrame:
    """Days with a spike or a stuck value: ``_key2, _day2`` and of each field ``_v, _spike, _stuck``."""
    reach, every = range(1, rules.max_run + 1), range(len(rules.fields))
    order = Window.partitionBy("_key").orderBy("_day")
    days = scored.withColumns({f"_good{i}": F.when(F.col(f"_log{i}").isNotNull(), F.struct(F.col(f"_log{i}").alias("x"), F.col(f"_residual{i}").alias("r"))) for i in every})
    beside = {"_place": F.row_number().over(order)}
    for i in every:
        held = F.lag(f"_v{i}").over(order)
        beside |= {f"_next{i}_{k}": _beside(f"_good{i}", k) for k in reach}
        beside[f"_way{i}"] = F.signum(f"_residual{i}")
        beside[f"_fresh{i}"] = F.col(f"_v{i}").isNull() | held.isNull() | (F.col(f"_v{i}") != held)
    days = days.withColumns(beside)

    runs = {}
    for i in every:
        apart = F.lit(0.0) if rules.multiple is None else rules.multiple * F.col(f"_typical{i}")
        cutoff, before, now = F.col(f"_cutoff{i}"), F.col(f"_before{i}"), F.col(f"_residual{i}")
        # Seen in the direction of the jump, a fall is a rise.
        way, begun = F.col(f"_way{i}"), F.lit(0)
        for k in reach:
            # How far the nearest reading of the run stands off the nearest good readings on either side.
            inside = [way * F.col(f"_log{i}"), *[way * F.col(f"_next{i}_{j}")["x"] for j in range(1, k)]]
            after, back = F.col(f"_next{i}_{k}")["x"], F.col(f"_next{i}_{k}")["r"]
            off = (F.least(*inside) if k > 1 else inside[0]) - F.greatest(way * before, way * after)
            begun = F.when(after.isNotNull() & (way * back < -cutoff) & (off > apart), F.lit(k)).otherwise(begun)
        begun = F.when(before.isNotNull() & (F.abs(now) > cutoff), begun).otherwise(F.lit(0))
        #: The longest run that begins at the reading; shorter ones that begin there are inside it.
        runs[f"_begun{i}"] = F.when(F.col(f"_log{i}").isNotNull(), begun)
        runs[f"_start{i}"] = F.last(F.when(F.col(f"_fresh{i}"), F.col("_place")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumns(runs)

    out = []
    for i in every:
        spike = (F.col(f"_begun{i}") > 0) | reduce(lambda a, b: a | b, [F.coalesce(_beside(f"_begun{i}", -j) > j, F.lit(False)) for j in range(1, rules.max_run)], F.lit(False))
        spike = F.coalesce(F.col(f"_log{i}").isNotNull() & spike, F.lit(False))
        # Where a run has reached its length by a row not far ahead, all its rows but the first are stuck; a later run cannot have by then.
        long = F.when(F.col("_place") - F.col(f"_start{i}") >= rules.stuck - 1, F.col(f"_start{i}"))
        stuck = F.coalesce(~F.col(f"_fresh{i}") & (F.max(long).over(order.rowsBetween(0, rules.stuck - 1)) == F.col(f"_start{i}")), F.lit(False))
        out += [F.col(f"_v{i}"), spike.alias(f"_spike{i}"), stuck.alias(f"_stuck{i}")]
    days = days.select(F.col("_key").alias("_key2"), F.col("_day").alias("_day2"), *out)
    return days.where(reduce(lambda a, b: a | b, [F.col(f"_{c}{i}") for c in ("spike", "stuck") for i in every]))


def flag_spikes(bars: DataFrame, rules: SpikeRules, *, series: str = "series_id", day: str = "date", row_id: str = "bar_id") -> DataFrame:
    """Readings a series could not have had: ``(row_id, series_id, day, field, value, reasons)``.

    reasons holds, in this order, those that apply: ``impossible`` (not finite or not above
    zero), ``outside`` (beyond its bar by more than the tolerance), ``stuck`` (inside a run of
    equal values, not its first), ``spike``.

    Days are judged once, by the row with the smallest row id (of rows without one, by any); every row that
    holds the judged value is reported. Null readings are never reported and end a stuck run. Rows without a
    day cannot be ordered and are judged by the first two rules only; a null series is a series of
    its own. A series with fewer than two good readings has no spikes. Empty input, empty result.
    Only the named columns are read, so further columns of any name do no harm.
    """
    rows = _typed(bars, series, day, row_id, rules)
    marks = _marked(_scored(_daily(rows, rules), rules), rules)
    joined = rows.join(marks, (F.col("_key") == F.col("_key2")) & (F.col("_day") == F.col("_day2")), "left")
    cells = []
    for i, r in enumerate(rules.fields):
        bad, out = _implausible(r)
        same = F.col(r.name).eqNullSafe(F.col(f"_v{i}"))
        reasons = F.array_compact(
            F.array(
                F.when(bad, F.lit("impossible")),
                F.when(out, F.lit("outside")),
                F.when(same & F.col(f"_stuck{i}"), F.lit("stuck")),
                F.when(same & F.col(f"_spike{i}"), F.lit("spike")),
            )
        )
        cells.append(F.struct(F.lit(r.name).alias("field"), F.col(r.name).alias("value"), reasons.alias("reasons")))
    out = joined.select(F.col("_row").alias("row_id"), F.col("_series").alias("series_id"), F.col("_day").alias("day"), F.inline(F.array(*cells)))
    return out.where(F.col("value").isNotNull() & (F.size("reasons") > 0))
