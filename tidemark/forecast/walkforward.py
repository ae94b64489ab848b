"""Walk-forward regression and models behind an information barrier.

A row at position p may be trained on rows up to p - h only, whose targets are complete at p. Blocks of
evaluation rows between refits are independent of each other; specs, series and stripes of blocks run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol as Shape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import by_date
from tidemark.params import LOG_FLOOR, WalkForward
from tidemark.session import spread_groups

RESULT = "series_id string, date date, horizon int, model string, forecast double"


@dataclass(frozen=True)
class HarSpec:
    """Columns of a heterogeneous autoregression."""

    name: str
    implied: bool = False
    log: bool = False
    jumps: str = "none"

    def __post_init__(self) -> None:
        if self.jumps not in ("none", "j", "cj"):
            raise ValueError(f"unknown jump mode {self.jumps!r}")
        if self.log and self.jumps != "none":
            raise ValueError("jumps may be zero: no logarithms")


#: The named variants.
HAR_SPECS = {s.name: s for s in (HarSpec("har"), HarSpec("har_log", log=True), HarSpec("har_iv", implied=True), HarSpec("har_log_iv", implied=True, log=True), HarSpec("har_j", jumps="j"), HarSpec("har_cj", jumps="cj"))}


def har_design(features: DataFrame, spec: HarSpec, horizon: int) -> DataFrame:
    """``series_id, date, x (array), y``; values are floored before logarithms, missing ones stay missing."""
    rv = [F.col(f"rv_cc_trail_{n}") for n in (1, 5, 22)]
    if spec.jumps == "cj":
        part = lambda n: F.when(F.col(f"bv_trail_{n}").isNull(), F.col(f"rv_cc_trail_{n}")).otherwise(F.least(f"bv_trail_{n}", f"rv_cc_trail_{n}"))
        x = [rv[0], part(5), F.col("jump_5"), part(22), F.col("jump_22")]
    else:
        x = rv + ([F.col("jump_22")] if spec.jumps == "j" else [])
    x += [F.col("iv30")] if spec.implied else []
    y = F.col(f"target_rv_{horizon}")
    if spec.log:
        floor = lambda c: F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(LOG_FLOOR))))
        x, y = [floor(c) for c in x], floor(y)
    return features.select("series_id", "date", F.array(*x).alias("x"), y.alias("y"))


class FitPredict(Shape):
    """What :func:`walkforward_model` asks of a model."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> object: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class LeastSquares:
    """Ordinary least squares with intercept."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> LeastSquares:
        self.coef = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.coef[0] + x @ self.coef[1:]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], float)


def _of_block(x: np.ndarray, y: np.ndarray, known: np.ndarray, asked: np.ndarray, factory: Callable[[], FitPredict], log: bool) -> np.ndarray:
    """Forecasts at the rows ``asked`` by one fit to the rows ``known``."""
    machine = factory()
    machine.fit(x[known], y[known])
    ahead = np.asarray(machine.predict(x[asked]), float)
    if not log:
        return ahead
    # Back from logarithms without bias: times the mean of what the fit leaves, exponentiated.
    return np.exp(ahead) * np.exp(y[known] - np.asarray(machine.predict(x[known]), float)).mean()


def _blocks_of(rows: DataFrame, design: DataFrame, refit_every: int) -> DataFrame:
    """The design with the block of consecutive evaluation rows each row is in, null for rows that are not evaluated.

    An evaluation row the design lacks is an error, raised when the plan runs.
    """
    wanted = rows.select(F.col("series_id").alias("_s"), F.col("date").alias("_d"), F.floor(F.col("ordinal") / refit_every).cast("long").alias("_b"))
    both = design.withColumn("_known", F.lit(True)).join(wanted, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("date") == F.col("_d")), "full")
    block = F.when(F.col("_known").isNull(), F.raise_error(F.lit("evaluation dates that the features lack")).cast("long")).otherwise(F.col("_b"))
    return both.select(*design.columns, block.alias("_block"))


def walkforward_model(design: DataFrame, rows: DataFrame, model: str, factory: Callable[[], FitPredict], spec: WalkForward, log: bool = False, stripes: int = 4) -> DataFrame:
    """Forecasts of ``y`` at the evaluation rows (``series_id, date, ordinal``) by any fit/predict model.

    Every ``refit_every`` evaluation rows form a block. A block is forecast by one fit to the complete rows
    whose targets end at its first row; with fewer than ``min_train`` of them, as for a row with a missing
    input, the forecast is null. Forecasts of logarithms are transformed back with the mean of exp(residual).
    Evaluation rows that the design lacks raise.

    As training rows only grow from block to block, no block needs the fit of another: the blocks of a series
    are dealt to ``stripes`` tasks, each of which holds the series once (its days are bounded by the calendar).
    """
    striped = _blocks_of(rows, design, spec.refit_every).withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    striped = striped.withColumn("_block", F.when(F.pmod("_block", F.lit(stripes)) == F.col("_stripe"), F.col("_block")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        x, y, block = _matrix(pdf["x"]), pdf["y"].to_numpy(float), pdf["_block"].to_numpy(float)
        filled = ~np.isnan(x).any(axis=1)
        complete = np.flatnonzero(filled & ~np.isnan(y))
        evaluated = np.flatnonzero(~np.isnan(block))
        ahead = np.full(len(pdf), np.nan)
        for members in np.split(evaluated, np.flatnonzero(np.diff(block[evaluated])) + 1) if len(evaluated) else []:
            known, asked = complete[complete <= members[0] - spec.horizon], members[filled[members]]
            if len(known) >= max(1, spec.min_train) and len(asked):
                ahead[asked] = _of_block(x, y, known, asked, factory, log)
        out = pdf.iloc[evaluated]
        values = [None if np.isnan(v) else float(v) for v in ahead[evaluated]]
        return pd.DataFrame({"series_id": out["series_id"], "date": out["date"], "horizon": spec.horizon, "model": model, "forecast": pd.array(values, dtype="Float64")})

    return spread_groups(striped, "series_id", "_stripe").groupBy("series_id", "_stripe").applyInPandas(run, RESULT)


def walkforward_ols(features: DataFrame, rows: DataFrame, har: HarSpec, spec: WalkForward) -> DataFrame:
    return walkforward_model(har_design(features, har, spec.horizon), rows, har.name, LeastSquares, spec, har.log)


def walkforward_single(features: DataFrame, rows: DataFrame, regressor: str, spec: WalkForward) -> DataFrame:
    """One regressor, without leaving the engine: running regression moments, taken at the refits and carried forward."""
    target = f"target_rv_{spec.horizon}"
    train = by_date().rowsBetween(Window.unboundedPreceding, -spec.horizon)
    both = F.col(regressor).isNotNull() & F.col(target).isNotNull()
    x, y = F.when(both, F.col(regressor)), F.when(both, F.col(target))
    df = features.select("series_id", "date", F.col(regressor).alias("_x"), F.count(x).over(train).alias("_n"), F.avg(x).over(train).alias("_mx"), F.avg(y).over(train).alias("_my"), F.covar_pop(y, x).over(train).alias("_cov"), F.var_pop(x).over(train).alias("_var"))
    wanted = rows.select(F.col("series_id").alias("_s"), F.col("date").alias("_d"), "ordinal")
    df = wanted.join(df, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("date") == F.col("_d")), "left")
    df = df.withColumn("ordinal", F.when(F.col("date").isNull(), F.raise_error(F.lit("evaluation dates that the features lack")).cast("long")).otherwise(F.col("ordinal")))
    refit = (F.col("ordinal") % spec.refit_every == 0) & (F.col("_n") >= spec.min_train)
    slope = F.col("_cov") / F.nullif("_var", F.lit(0.0))
    fit = F.last(F.when(refit, F.struct(slope.alias("b"), (F.col("_my") - slope * F.col("_mx")).alias("a"))), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_f", fit).select("series_id", "date", F.lit(spec.horizon).alias("horizon"), F.lit(f"ols_{regressor}").alias("model"), (F.col("_f.a") + F.col("_f.b") * F.col("_x")).alias("forecast"))
