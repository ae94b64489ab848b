"""Conditional-variance models by maximum likelihood, refitted in blocks, with a resumable cache."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import HORIZONS, SEED
from tidemark.session import spread_groups
from tidemark.sources.files import read_or_empty

RESULT = "series_id string, block int, date date, horizon int, model string, forecast double"


@dataclass(frozen=True)
class GarchSpec:
    """asymmetric: a term for falls; logs: the variance's logarithm is modelled; student: heavy tails."""

    name: str
    asymmetric: bool = False
    logs: bool = False
    student: bool = False


GARCH_SPECS = {s.name: s for s in (GarchSpec("garch_n"), GarchSpec("gjr_n", asymmetric=True), GarchSpec("gjr_t", asymmetric=True, student=True), GarchSpec("egarch_n", logs=True))}
_ABS_NORMAL = math.sqrt(2 / math.pi)


def _unpack(spec: GarchSpec, free: np.ndarray, level: float) -> tuple[float, ...]:
    """(mean, omega, alpha, gamma, beta, degrees of freedom) from unbounded numbers; stationary by construction."""
    mean = float(free[0])
    if spec.logs:
        beta = math.tanh(float(free[3]))
        return mean, float(free[1]), float(free[2]), 0.0, beta, math.inf
    e = np.exp(np.clip(free[2:5], -20, 20))
    total = 1 + e.sum()
    alpha, gamma, beta = e / total
    if not spec.asymmetric:
        alpha, gamma, beta = e[0] / (1 + e[0] + e[2]), 0.0, e[2] / (1 + e[0] + e[2])
    # A fall adds gamma to alpha half of the time.
    gamma *= 2
    persistence = alpha + gamma / 2 + beta
    omega = level * math.exp(float(np.clip(free[1], -10, 10))) * max(1 - persistence, 1e-6)
    return mean, omega, float(alpha), float(gamma), float(beta), 2.05 + math.exp(float(np.clip(free[5], -5, 6))) if spec.student else math.inf


def variance_path(spec: GarchSpec, params: tuple[float, ...], r: np.ndarray, start: float) -> np.ndarray:
    """Conditional variance of each return and of the next one."""
    mean, omega, alpha, gamma, beta, _ = params
    out = [start]
    if spec.logs:
        log = math.log(start)
        for x in (r - mean).tolist():
            z = x / math.exp(log / 2)
            log = min(max(omega + alpha * (abs(z) - _ABS_NORMAL) + beta * log, -30.0), 30.0)
            out.append(math.exp(log))
    else:
        h = start
        for x in (r - mean).tolist():
            h = omega + (alpha + (gamma if x < 0 else 0.0)) * x * x + beta * h
            out.append(h)
    return np.array(out)


def _loss(spec: GarchSpec, free: np.ndarray, r: np.ndarray, level: float) -> float:
    params = _unpack(spec, free, level)
    h = np.maximum(variance_path(spec, params, r, level)[:-1], 1e-12)
    e2 = (r - params[0]) ** 2 / h
    nu = params[5]
    if math.isinf(nu):
        value = 0.5 * (np.log(2 * math.pi * h) + e2).sum()
    else:
        constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        value = -(constant - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e2 / (nu - 2))).sum()
    return float(value) if np.isfinite(value) else 1e12


def minimise(f, x: np.ndarray, step: float = 0.25, rounds: int = 220, tolerance: float = 1e-5) -> np.ndarray:
    """Downhill simplex."""
    n = len(x)
    points = [x, *[x + step * np.eye(n)[i] for i in range(n)]]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        turned = centre + (centre - points[-1])
        v = f(turned)
        if v < values[0]:
            wide = centre + 2 * (centre - points[-1])
            w = f(wide)
            points[-1], values[-1] = (wide, w) if w < v else (turned, v)
        elif v < values[-2]:
            points[-1], values[-1] = turned, v
        else:
            near = centre + 0.5 * ((turned if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


def fit(spec: GarchSpec, r: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, tuple[float, ...]]:
    """(free parameters, parameters) of the largest likelihood; ``start`` warms the search up."""
    level = float(np.var(r)) or 1e-8
    if start is None:
        start = np.array([r.mean(), 0.05 * math.log(level), 0.15, 1.8]) if spec.logs else np.array([r.mean(), 0.0, -0.5, -0.5, 2.5, 1.5])
    if spec.logs:
        free = minimise(lambda p: _loss(spec, p, r, level), start)
    else:
        used = [0, 1, 2, 4] + ([3] if spec.asymmetric else []) + ([5] if spec.student else [])

        def partial(p: np.ndarray) -> float:
            whole = start.copy()
            whole[used] = p
            return _loss(spec, whole, r, level)

        free = start.copy()
        free[used] = minimise(partial, start[used])
    return free, _unpack(spec, free, level)


def variance_forecast(spec: GarchSpec, params: tuple[float, ...], h: float, horizon: int, seed: int, simulations: int = 200) -> np.ndarray:
    """Expected variance one to ``horizon`` days ahead, given the next day's ``h``."""
    _, omega, alpha, gamma, beta, _ = params
    if not spec.logs:
        persistence = alpha + gamma / 2 + beta
        out = [h]
        for _ in range(horizon - 1):
            out.append(omega + persistence * out[-1])
        return np.array(out)
    z = np.random.default_rng(seed).standard_normal((simulations, horizon))
    log = np.full(simulations, math.log(h))
    out = []
    for k in range(horizon):
        out.append(float(np.exp(log).mean()))
        log = np.clip(omega + alpha * (np.abs(z[:, k]) - _ABS_NORMAL) + beta * log, -30, 30)
    return np.array(out)


def garch_forecasts(features: DataFrame, rows: DataFrame, specs: tuple[str, ...] = tuple(GARCH_SPECS), *, refit_every: int = 22, min_train: int = 1250, horizons: tuple[int, ...] = HORIZONS, skip: DataFrame | None = None, block_offset: int = 0) -> DataFrame:
    """Forecasts of annualised variance at the evaluation rows; one task for each series and spec.

    Parameters are fitted on returns up to and including a block's first day and frozen for the block, the
    variance state moves on daily. Blocks with fewer than ``min_train`` returns, with parameters
    that are not finite, or listed in ``skip`` (``series_id, model, block``) give no rows.
    """
    data = features.select("series_id", "date", "ret_cc").join(rows.select("series_id", "date", "ordinal"), ["series_id", "date"], "left")
    if skip is not None:
        done = skip.select("series_id", "model", "block").distinct().groupBy("series_id", "model").agg(F.collect_set("block").alias("done"))
    keyed = data.withColumn("model", F.explode(F.array(*[F.lit(s) for s in specs])))
    keyed = keyed.join(done, ["series_id", "model"], "left") if skip is not None else keyed.withColumn("done", F.lit(None).cast("array<int>"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        spec = GARCH_SPECS[pdf["model"].iloc[0]]
        finished = set(pdf["done"].iloc[0]) if pdf["done"].iloc[0] is not None else set()
        ordinal = pdf["ordinal"].to_numpy(float)
        r = pdf["ret_cc"].to_numpy(float) * 100
        present = ~np.isnan(r)
        at = np.flatnonzero(~np.isnan(ordinal))
        free, out = None, []
        for b in range(-(-len(at) // refit_every)):
            block = at[b * refit_every : (b + 1) * refit_every]
            number = b + block_offset
            history = r[: block[0] + 1][present[: block[0] + 1]]
            if number in finished or len(history) < min_train:
                continue
            free, params = fit(spec, history, free)
            if not all(math.isfinite(p) or p == math.inf for p in params):
                free = None
                continue
            seen = r[: block[-1] + 1][present[: block[-1] + 1]]
            path = variance_path(spec, params, seen, float(np.var(history)) or 1e-8)
            count = np.cumsum(present)
            for pos in block:
                if present[pos]:
                    ahead = variance_forecast(spec, params, float(path[count[pos]]), max(horizons), SEED + number)
                    out += [(pdf["series_id"].iloc[pos], number, pdf["date"].iloc[pos], h, spec.name, float(ahead[:h].sum() * 252 / h / 1e4)) for h in horizons]
        return pd.DataFrame(out, columns=["series_id", "block", "date", "horizon", "model", "forecast"])

    return spread_groups(keyed, "series_id", "model").groupBy("series_id", "model").applyInPandas(run, RESULT)


def ensure_cached(spark: SparkSession, path: str, features: DataFrame, rows: DataFrame, specs: tuple[str, ...] = tuple(GARCH_SPECS), **options) -> DataFrame:
    """Forecasts from the cache at ``path`` after the blocks it lacks were added."""
    cached = read_or_empty(spark, path, RESULT)
    missing = garch_forecasts(features, rows, specs, skip=cached, **options)
    missing.write.mode("append").partitionBy("model").parquet(path)
    return spark.read.parquet(path).select("series_id", "block", "date", "horizon", "model", "forecast")
