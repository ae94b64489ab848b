"""Leaf-wise histogram gradient boosting, as a model for the walk-forward."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.forecast.walkforward import walkforward_model
from tidemark.params import LOG_FLOOR, SEED, WalkForward

#: Input columns.
FEATURES = ("rv_cc_trail_1", "rv_cc_trail_5", "rv_cc_trail_22", "bv_trail_22", "jump_22", "iv30", "rv_pk_trail_5", "rv_pk_trail_22")


@dataclass
class Boosting:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 15
    least: int = 50
    bagging: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = SEED

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        rng = np.random.default_rng(self.seed)
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        self.base = float(y.mean())
        self.trees: list[list[tuple]] = []
        self.gain = np.zeros(k)
        current = np.full(n, self.base)
        for _ in range(self.rounds):
            rows = rng.permutation(n)[: max(1, int(n * self.bagging))]
            used = np.sort(rng.permutation(k)[: max(1, round(k * self.columns))])
            tree = self._grow(codes, y - current, rows, used)
            self.trees.append(tree)
            current += self.rate * self._leaf(tree, codes)
        return self

    def _best(self, codes: np.ndarray, g: np.ndarray, rows: np.ndarray, used: np.ndarray) -> tuple | None:
        total, n = g[rows].sum(), len(rows)
        if n < 2 * self.least:
            return None
        # All columns in one count; bins are summed in the order of the rows, as one column at a time would.
        flat = (codes[rows][:, used] + np.arange(len(used)) * self.bins).ravel()
        shape = len(used), self.bins
        count = np.cumsum(np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape), 1)[:, :-1]
        left = np.cumsum(np.bincount(flat, weights=np.repeat(g[rows], len(used)), minlength=shape[0] * shape[1]).reshape(shape), 1)[:, :-1]
        ok = (count >= self.least) & (n - count >= self.least)
        gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, -np.inf)
        k, i = divmod(int(gain.argmax()), self.bins - 1)
        return (float(gain[k, i]), int(used[k]), i) if gain[k, i] > 1e-12 else None

    def _grow(self, codes: np.ndarray, g: np.ndarray, rows: np.ndarray, used: np.ndarray) -> list[tuple]:
        """Nodes (column, bin, left, right) or (None, value)."""
        nodes: list[tuple] = [(None, float(g[rows].mean()))]
        open_ = [(self._best(codes, g, rows, used), 0, rows)]
        for _ in range(self.leaves - 1):
            open_ = [x for x in open_ if x[0] is not None]
            if not open_:
                break
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            (gain, j, cut), node, own = open_.pop(k)
            self.gain[j] += gain
            side = codes[own, j] <= cut
            parts = own[side], own[~side]
            nodes[node] = (j, cut, len(nodes), len(nodes) + 1)
            for part in parts:
                nodes.append((None, float(g[part].mean())))
                open_.append((self._best(codes, g, part, used), len(nodes) - 1, part))
        return nodes

    @staticmethod
    def _leaf(tree: list[tuple], codes: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(codes)), [(0, np.arange(len(codes)))]
        while stack:
            node, rows = stack.pop()
            if tree[node][0] is None:
                out[rows] = tree[node][1]
            else:
                j, cut, left, right = tree[node]
                side = codes[rows, j] <= cut
                stack += [(left, rows[side]), (right, rows[~side])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        out = np.full(len(x), self.base)
        if len(x) == 1:
            row = codes[0].tolist()
            for tree in self.trees:
                node = tree[0]
                while node[0] is not None:
                    node = tree[node[2] if row[node[0]] <= node[1] else node[3]]
                out += self.rate * node[1]
            return out
        for tree in self.trees:
            out += self.rate * self._leaf(tree, codes)
        return out


def boost_design(features: DataFrame, horizon: int) -> DataFrame:
    floor = lambda c: F.when(F.col(c).isNotNull(), F.ln(F.greatest(F.col(c), F.lit(LOG_FLOOR))))
    return features.select("series_id", "date", F.array(*[floor(c) for c in FEATURES]).alias("x"), floor(f"target_rv_{horizon}").alias("y"))


def boosting_forecasts(features: DataFrame, rows: DataFrame, horizon: int = 22, min_train: int = 756, rounds: int = 300) -> DataFrame:
    return walkforward_model(boost_design(features, horizon), rows, "boosting", lambda: Boosting(rounds=rounds), WalkForward(horizon, min_train=min_train), log=True)


def feature_importance(features: DataFrame, horizon: int, train_end: str, rounds: int = 300) -> DataFrame:
    """Total gain of each input in one fit on the rows up to a date, by series, largest first."""
    import pandas as pd

    train = boost_design(features.where(F.col("date") <= F.lit(train_end).cast("date")), horizon)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        x = np.array([[np.nan if v is None else v for v in row] for row in pdf["x"]], float)
        y = pdf["y"].to_numpy(float)
        ok = ~(np.isnan(x).any(axis=1) | np.isnan(y))
        gain = Boosting(rounds=rounds).fit(x[ok], y[ok]).gain if ok.sum() > 1 else np.zeros(len(FEATURES))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "feature": FEATURES, "gain": gain})

    return train.groupBy("series_id").applyInPandas(run, "series_id string, feature string, gain double").orderBy("series_id", F.desc("gain"))
