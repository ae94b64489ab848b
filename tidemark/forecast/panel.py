"""Panels of all forecasts at the evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.forecast import baselines, boost, garch, walkforward
from tidemark.params import WalkForward

FAMILIES = ("baseline", "har", "garch", "boosting")


def forecast_panel(features: DataFrame, rows: DataFrame, horizon: int = 22, families: Sequence[str] = FAMILIES, *, spec: WalkForward | None = None, garch_min_train: int = 1250, boosting_min_train: int = 756, rounds: int = 300) -> DataFrame:
    """``series_id, date, horizon, model, forecast``: up to fifteen models at ``rows`` (``series_id, date, ordinal``).

    ``features`` is read by every model: write it, or cut its lineage, before.
    """
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {', '.join(sorted(unknown))}")
    spec = spec or WalkForward(horizon)
    parts = []
    if "baseline" in families:
        flat = [baselines.random_walk(features, (horizon,)), baselines.implied(features, (horizon,)), baselines.expanding_mean(features, horizons=(horizon,)), baselines.ewma(features, horizons=(horizon,))]
        parts.append(baselines.union(flat).join(rows.select("series_id", "date"), ["series_id", "date"]))
    if "har" in families:
        parts += [walkforward.walkforward_ols(features, rows, har, spec) for har in walkforward.HAR_SPECS.values()]
    if "garch" in families:
        parts.append(garch.garch_forecasts(features, rows, min_train=garch_min_train, horizons=(horizon,)).drop("block"))
    if "boosting" in families:
        parts.append(boost.boosting_forecasts(features, rows, horizon, boosting_min_train, rounds))
    return baselines.union([p.select("series_id", "date", "horizon", "model", "forecast") for p in parts])


def common_models(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both panels with the models they share."""
    return tuple(a.join(b.select("model").distinct(), "model", "left_semi").select(*a.columns) for a, b in ((first, second), (second, first)))
