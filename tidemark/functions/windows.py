"""Positional windows of a series; a window counts only when it is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.nullsafe import clip, positive_log, ratio


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("date")


def full(agg, x: Column, frame: WindowSpec, n: int) -> Column:
    """``agg(x)`` over the frame where it holds n present values, else null."""
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def log_return(close: Column, w: WindowSpec) -> Column:
    return positive_log(close) - F.lag(positive_log(close)).over(w)


def parkinson(high: Column, low: Column) -> Column:
    x = positive_log(ratio(high, low))
    return x * x / F.lit(4 * 0.6931471805599453)


def garman_klass(o: Column, h: Column, lo: Column, c: Column) -> Column:
    x, y = positive_log(ratio(h, lo)), positive_log(ratio(c, o))
    return F.lit(0.5) * x * x - F.lit(2 * 0.6931471805599453 - 1) * y * y


def rogers_satchell(o: Column, h: Column, lo: Column, c: Column) -> Column:
    part = lambda x: positive_log(ratio(x, c)) * positive_log(ratio(x, o))
    return part(h) + part(lo)


def yang_zhang(overnight: Column, open_close: Column, rs: Column, w: WindowSpec, n: int = 22) -> Column:
    """Rolling estimator; arguments are the overnight and open-to-close log returns and the daily range term."""
    if n < 2:
        raise ValueError("the window must hold two days at least")
    frame = w.rowsBetween(-(n - 1), 0)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return full(F.var_samp, overnight, frame, n) + F.lit(k) * full(F.var_samp, open_close, frame, n) + F.lit(1 - k) * full(F.avg, rs, frame, n)


def trailing_rv(dv: Column, w: WindowSpec, h: int) -> Column:
    if h < 1:
        raise ValueError("the horizon is at least one day")
    return F.lit(252 / h) * full(F.sum, dv, w.rowsBetween(-(h - 1), 0), h)


def forward_rv(dv: Column, w: WindowSpec, h: int) -> Column:
    """Over the h rows strictly after this one; null where they are not all there."""
    if h < 1:
        raise ValueError("the horizon is at least one day")
    return F.lit(252 / h) * full(F.sum, dv, w.rowsBetween(1, h), h)


def bipower(r: Column, previous: Column, w: WindowSpec, h: int) -> Column:
    """previous: the return one row before."""
    if h < 2:
        raise ValueError("bipower variation needs two days")
    return F.lit(3.141592653589793 / 2 * 252 / (h - 1)) * full(F.sum, F.abs(r) * F.abs(previous), w.rowsBetween(-(h - 2), 0), h - 1)


def jump(rv: Column, bv: Column) -> Column:
    return clip(rv - bv, low=0.0)
