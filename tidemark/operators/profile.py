"""Quality profile of every column for each load, and loads that differ from the others.

Base figures are exact aggregates. Distribution changes are found by classifier two-sample
tests: for each load a logistic regression, trained by sums over all partitions, tells its rows
from those of the other loads. How well it does so on rows it was not trained on is held
against the same in loads permuted at random, so the limit needs no assumption.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import counted_medians
from tidemark.session import cut_lineage

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
_MOST_LOADS = 100_000
_MASKED = 60


def _kind(dtype: str) -> str:
    return "number" if dtype in NUMERIC or dtype.startswith("decimal") else "flag" if dtype == "boolean" else "text"


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """``load, column_name, number, text, times`` of each distinct non-null value (numbers and flags as DOUBLE, the rest as text)."""
    types = dict(df.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col(c).cast("double") if _kind(types[c]) != "text" else F.lit(None).cast("double")).alias("number"),
            (F.col(c).cast("string") if _kind(types[c]) == "text" else F.lit(None).cast("string")).alias("text"),
        )
        for c in columns
    ]
    long = df.select(F.col(load).alias("_load"), F.inline(F.array(*cells)))
    return long.where(F.col("number").isNotNull() | F.col("text").isNotNull()).groupBy("_load", "column_name", "number", "text").agg(F.count(F.lit(1)).alias("times"))


def profile_loads(df: DataFrame, columns: Sequence[str] | None = None, *, load: str = "load_id", patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each load and column, all figures exact.

    ``load_id, column_name, n_rows, n_null, n_nan, n_zero, n_negative, n_positive, n_true, n_distinct,
    min_value, max_value (text), median_abs, n_violations``. Counts of numbers are 0 for other types
    and the reverse; n_distinct leaves null out and counts NaN as one value; extremes and medians leave
    NaN out (null if nothing is left); n_violations counts non-null values that do not match the
    column's pattern (a regular expression over the value as text), 0 without pattern. A null load is a
    load. An empty table has no loads and no rows. Default: all columns but the load; nested ones as text of JSON.

    Distinct counts and medians come from one count by (load, column, value), folded before the exchange;
    no group of values is gathered in a task.
    """
    patterns = dict(patterns or {})
    df = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array") else F.col(f.name) for f in df.schema.fields if columns is None or f.name in (load, *columns)])
    columns = [c for c in df.columns if c != load] if columns is None else list(columns)
    types = dict(df.dtypes)
    counted = lambda cond: F.coalesce(F.count_if(cond), F.lit(0)).cast("long")
    aggs, cells = [], []
    for i, c in enumerate(columns):
        x, kind = F.col(c), _kind(types[c])
        number = x.cast("double") if kind == "number" else F.lit(None).cast("double")
        real = F.when(~F.isnan(number), number)
        shown = real if types[c] in ("double", "float") else x
        figures = {
            "n_rows": F.count(F.lit(1)),
            "n_null": counted(x.isNull()),
            "n_nan": counted(F.isnan(number) if kind == "number" else F.lit(False)),
            "n_zero": counted(real == 0),
            "n_negative": counted(real < 0),
            "n_positive": counted(real > 0),
            "n_true": counted(x if kind == "flag" else F.lit(False)),
            "min_value": F.min(shown).cast("string"),
            "max_value": F.max(shown).cast("string"),
            "n_violations": counted(~x.cast("string").rlike(patterns[c]) if c in patterns else F.lit(False)),
        }
        aggs += [a.alias(f"_{i}_{k}") for k, a in figures.items()]
        cells.append(F.struct(F.lit(c).alias("column_name"), *[F.col(f"_{i}_{k}").alias(k) for k in figures]))
    base = df.groupBy(F.col(load).alias("_load")).agg(*aggs).select("_load", F.inline(F.array(*cells)))
    counts = value_counts(df, load, columns)
    distinct = counts.groupBy("_load", "column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    numeric = [c for c in columns if _kind(types[c]) == "number"]
    medians = counted_medians(counts.where(F.col("column_name").isin(numeric)).withColumn("_size", F.abs("number")), ["_load", "column_name"], "_size", "times", "median_abs")
    for part in (distinct, medians):
        part = part.withColumnsRenamed({"_load": "_load2", "column_name": "_column2"})
        base = base.join(part, F.col("_load").eqNullSafe(F.col("_load2")) & (F.col("column_name") == F.col("_column2")), "left").drop("_load2", "_column2")
    order = ["n_rows", "n_null", "n_nan", "n_zero", "n_negative", "n_positive", "n_true", "n_distinct", "min_value", "max_value", "median_abs", "n_violations"]
    return base.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))).select(F.col("_load").alias(load), "column_name", *order)


#: Hash states of a text column, and width and sharpness of the bins in which scores are counted.
_TEXT_STATES, _FINE, _PER_FOLD = 16, 200.0, 12.0


@dataclass(frozen=True)
class _Frame:
    """What every task needs to turn rows into regression inputs: kinds and scales of the columns, shares of the loads.

    reference: the loads that others are held against.
    """

    kinds: tuple[str, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    upto: np.ndarray
    reference: np.ndarray

    @property
    def loads(self) -> int:
        return len(self.upto)

    def inputs(self, batch: pd.DataFrame) -> list[np.ndarray]:
        """One matrix for each column, its first input constant."""
        blocks = []
        for i, kind in enumerate(self.kinds):
            x = batch[f"_c{i}"].to_numpy(float, na_value=np.nan)
            absent = (batch[f"_m{i // _MASKED}"].to_numpy(np.int64) >> (i % _MASKED)) & 1 == 1
            parts = [np.ones(len(batch)), absent]
            if kind == "flag":
                parts.append(x == 1)
            elif kind == "text":
                parts += [x == k for k in range(1, _TEXT_STATES)]
            else:
                finite = np.isfinite(x) & (x != 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    size = np.where(finite, (np.log(np.abs(x)) - self.centre[i]) / self.spread[i], 0.0)
                size = np.clip(size, -8, 8)
                parts += [~absent & ~np.isfinite(x), x == 0, finite & (x < 0), batch[f"_r{i}"].to_numpy(bool) if f"_r{i}" in batch else np.zeros(len(x), bool), size, np.minimum(size * size, 16.0)]
            blocks.append(np.stack([np.asarray(p, float) for p in parts], 1))
        return blocks

    def _drawn(self, h: np.ndarray, k: int, not_this: np.ndarray | None = None) -> np.ndarray:
        """A load for each row, by its hash, in proportion to the loads' rows."""
        pick = np.minimum(np.searchsorted(self.upto, _uniform(h, k), "right"), self.loads - 1)
        if not_this is not None:
            for again in range(1, 4):
                same = pick == not_this
                pick[same] = np.minimum(np.searchsorted(self.upto, _uniform(h[same], k + again), "right"), self.loads - 1)
            pick = np.where(pick == not_this, (pick + 1) % self.loads, pick)
        return pick

    def uses(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, model, label, fold) of the uses of each row: in its load; of rows of the reference also against another load, and both with permuted loads.

        Models count the loads, then the permuted ones.
        """
        h = batch["_h"].to_numpy(np.int64).view(np.uint64)
        own = batch["_own"].to_numpy(np.int64)
        fold = (_uniform(h, 1) < 0.5).astype(np.int64)
        kept = np.flatnonzero(self.reference[own])
        fake = self._drawn(h[kept], 20)
        row = np.concatenate([np.arange(len(own)), kept, kept, kept])
        model = np.concatenate([own, self._drawn(h[kept], 10, own[kept]), self.loads + fake, self.loads + self._drawn(h[kept], 30, fake)])
        return row, model, np.repeat([1.0, 0.0, 1.0, 0.0], [len(own), *[len(kept)] * 3]), fold[row]


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes, another for each ``k``."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / 2.0**53


def _logits(blocks: list[np.ndarray], weights: list[np.ndarray], fit: np.ndarray) -> np.ndarray:
    """Logit of each column's own regression for each use of a row; two fits a model, one for each held fold."""
    return np.stack([np.einsum("ij,ij->i", x, w[fit]) for x, w in zip(blocks, weights)], 1)


def _moments(x: np.ndarray, logit: np.ndarray, label: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the log likelihood, summed over the uses of each fit."""
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    rows = x[order]
    first = np.add.reduceat(rows * (label - p)[order, None], starts)
    second = np.add.reduceat(rows[:, :, None] * (rows * (p * (1 - p))[order, None])[:, None, :], starts)
    return np.concatenate([first, second.reshape(len(starts), -1)], 1)


def _fits(rows: DataFrame, frame: _Frame, ridge: float, steps: tuple[int, int], known: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights, from ``known`` ones on, of each column's own regression and of the joint one over their logits, for each model and held fold.

    Every step of Newton's method is one distributed sum over all rows; the driver gets gradients and Hessians
    only, whose size is loads x columns.
    """
    spark = rows.sparkSession
    widths = [{"flag": 3, "text": 1 + _TEXT_STATES, "number": 8}[k] for k in frame.kinds]
    fits, joint_width = 4 * frame.loads, len(widths) + 1
    weights, joint = known or [np.zeros((fits, w)) for w in widths], np.zeros((fits, joint_width))
    joint[:, 1:] = 1.0

    for step in range(sum(steps)):
        stage, sizes = (1, widths) if step < steps[0] else (2, [joint_width])
        shared = spark.sparkContext.broadcast((weights, joint))

        def tally(batches: Iterator[pd.DataFrame], stage=stage, shared=shared) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not len(batch):
                    continue
                own, both = shared.value
                row, model, label, fold = frame.uses(batch)
                blocks = [x[row] for x in frame.inputs(batch)]
                fit = 2 * model + 1 - fold
                order = np.argsort(fit, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(fit[order]) != 0])
                logit = _logits(blocks, own, fit)
                if stage == 1:
                    sums = np.concatenate([_moments(x, logit[:, i], label, order, starts) for i, x in enumerate(blocks)], 1)
                else:
                    x = np.concatenate([np.ones((len(fit), 1)), np.clip(logit, -30, 30)], 1)
                    sums = _moments(x, np.einsum("ij,ij->i", x, both[fit]), label, order, starts)
                for k, v in zip(fit[order][starts].tolist(), sums):
                    total[k] = total[k] + v if k in total else v
            if total:
                width = len(next(iter(total.values())))
                yield pd.DataFrame({"fit": np.repeat(np.array(list(total), np.int64), width), "place": np.tile(np.arange(width, dtype=np.int32), len(total)), "part": np.concatenate(list(total.values()))})

        long = rows.mapInPandas(tally, "fit long, place int, part double")
        summed = long.groupBy("fit", "place").agg(F.sum("part").alias("part")).toPandas()
        table = np.zeros((fits, sum(w + w * w for w in sizes)))
        table[summed["fit"].to_numpy(np.int64), summed["place"].to_numpy(np.int64)] = summed["part"].to_numpy(float)
        at = 0
        for i, w in enumerate(sizes):
            beta = weights[i] if stage == 1 else joint
            penalty = np.r_[1e-3, np.full(w - 1, ridge)]
            goal = np.zeros(w) if stage == 1 else np.r_[0.0, np.ones(w - 1)]
            gradient = table[:, at : at + w] - penalty * (beta - goal)
            hessian = table[:, at + w : at + w + w * w].reshape(fits, w, w) + np.diag(penalty)
            beta += np.clip(np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0], -4, 4)
            at += w + w * w
        shared.unpersist()
    return weights, joint


def load_shifts(df: DataFrame, columns: Sequence[str], *, load: str = "load_id", row_id: str = "feature_id", ridge: float = 1.0, steps: tuple[int, int] = (3, 2), repeats: Sequence[str] | None = None) -> DataFrame:
    """Classifier two-sample test of each load against the others, by column.

    ``load_id, column_name, rows, auc, auc_without, auc_alone, z, z_drop, limit, limit_drop, changed``. A logistic regression
    for each load tells its rows from as many of a reference (every row stands once for its own load, and
    once against another one, drawn in proportion to their sizes). The reference is all loads but those
    that a first, coarser fit finds far from the others: at least half of the loads. auc: cross-fitted discrimination of the
    joint regression; auc_without: of the same without the column's part (ablation); auc_alone: of the column's own
    regression. z and z_drop: auc_alone over one half and the loss by ablation, in standard errors. The limits are the
    highest z and z_drop that any of the columns reaches in loads permuted at random within the reference, of the
    same sizes and by the same fits; ``changed`` if either limit is passed.

    Any number of columns of any type: numbers, dates and times by missing, not finite, zero, negative, repeated within
    the load (of the columns ``repeats``, by default all numbers; each costs a join by load and value), and
    standardised log magnitude with its square; flags; texts by hash states. All rows take part in
    the training, by sums over the partitions; neither rows nor groups of them are gathered. What the driver holds
    grows with loads x columns only.

    A lone load has nothing to be compared with: its figures are null and changed is true. A null load is a
    load; rows of equal or null ids go to folds by their values too. An empty table gives no rows.
    """
    types = dict(df.dtypes)
    kinds = tuple("number" if types[c] in ("date", "timestamp", "timestamp_ntz") else _kind(types[c]) for c in columns)
    inputs = [_as_input(F.col(c), types[c], k) for c, k in zip(columns, kinds)]
    # Which values are null, a bit each: in Python a null and a NaN are one.
    masks = [reduce(lambda a, b: a + b, [F.when(x.isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, x in enumerate(inputs[j : j + _MASKED])]).alias(f"_m{j // _MASKED}") for j in range(0, len(inputs), _MASKED)]
    # One struct instead of a name for each column: the optimizer would try every mixture of old and new names in hash and masks.
    picked = df.select(F.col(load).alias("_load"), F.xxhash64(F.col(row_id), *columns).alias("_h"), F.struct(*[x.alias(f"c{i}") for i, x in enumerate(inputs)]).alias("_x"), *masks)
    numbers = [i for i, k in enumerate(kinds) if k == "number"]
    # One pass for the sizes of the loads and the scale of each column.
    logs = {i: F.when((F.abs(f"_x.c{i}") > 0) & (F.abs(f"_x.c{i}") < float("inf")), F.ln(F.abs(f"_x.c{i}"))) for i in numbers}
    sizes = picked.groupBy("_load").agg(F.count(F.lit(1)).alias("_n"), *[a for i, x in logs.items() for a in (F.avg(x).alias(f"_mean{i}"), F.stddev_pop(x).alias(f"_sd{i}"))]).collect()
    if len(sizes) > _MOST_LOADS:
        raise ValueError(f"more than {_MOST_LOADS} loads")
    load_type = types[load]
    schema = f"{load} {load_type}, column_name string, rows long, auc double, auc_without double, auc_alone double, z double, z_drop double, limit double, limit_drop double, changed boolean"
    if len(sizes) < 2:
        return df.sparkSession.createDataFrame([(r["_load"], c, r["_n"], *[None] * 7, True) for r in sizes for c in columns], schema)

    def usual(name: str, i: int, floor: float) -> float:
        found = [r[f"{name}{i}"] for r in sizes if r[f"{name}{i}"] is not None]
        middle = float(np.median(found)) if found else 0.0
        return middle if name == "_mean" or middle > floor else max(float(np.ptp([r[f"_mean{i}"] for r in sizes if r[f"_mean{i}"] is not None])), 1.0) if found else 1.0

    centre = tuple(usual("_mean", i, 0) if i in numbers else 0.0 for i in range(len(kinds)))
    spread = tuple(usual("_sd", i, 1e-9) if i in numbers else 1.0 for i in range(len(kinds)))
    upto = np.cumsum([r["_n"] for r in sizes]) / sum(r["_n"] for r in sizes)
    frame = _Frame(kinds, centre, spread, upto, np.ones(len(sizes), bool))
    places = df.sparkSession.createDataFrame([(r["_load"], i) for i, r in enumerate(sizes)], f"_of {load_type}, _own int")

    rows = picked.join(F.broadcast(places), F.col("_load").eqNullSafe(F.col("_of"))).drop("_of")  # at most _MOST_LOADS rows
    for i in numbers:
        x = F.col(f"_x.c{i}")
        if repeats is not None and columns[i] not in repeats:
            continue
        repeated = picked.where(x.isNotNull() & ~F.isnan(x) & (x != 0)).groupBy(F.col("_load").alias("_rl"), x.alias("_rv")).agg(F.count(F.lit(1)).alias("_times"))
        repeated = repeated.where(F.col("_times") > 1).select("_rl", "_rv", F.lit(True).alias("_again"))
        rows = rows.join(repeated, F.col("_load").eqNullSafe(F.col("_rl")) & (x == F.col("_rv")), "left")
        rows = rows.withColumn(f"_r{i}", F.coalesce("_again", F.lit(False))).drop("_rl", "_rv", "_again")
    rows = cut_lineage(rows.select("_h", "_own", *[F.col(f"_x.c{i}").alias(f"_c{i}") for i in range(len(columns))], *[c for c in rows.columns if c.startswith(("_m", "_r"))]))

    # The others may hold spoiled loads, which would make every sound one differ from them: those that stand out at first sight leave the reference.
    weights, joint = _fits(rows, frame, ridge, (2, 0))
    first = _figures(rows, frame, weights, joint, columns).toPandas()
    frame = replace(frame, reference=_inliers(first, frame.loads))
    weights, joint = _fits(rows, frame, ridge, steps, weights)
    table = _figures(rows, frame, weights, joint, columns)
    permuted = F.col("model") >= frame.loads
    limits = table.where(permuted).agg(F.coalesce(F.max("z"), F.lit(0.0)).alias("limit"), F.coalesce(F.max("z_drop"), F.lit(0.0)).alias("limit_drop")).first()
    out = table.where(~permuted).withColumns({k: F.lit(float(limits[k])) for k in ("limit", "limit_drop")})
    out = out.join(F.broadcast(places), F.col("model") == F.col("_own"))
    changed = (F.col("z") > F.col("limit")) | (F.col("z_drop") > F.col("limit_drop"))
    return out.select(F.col("_of").alias(load), "column_name", "rows", "auc", "auc_without", "auc_alone", "z", "z_drop", "limit", "limit_drop", changed.alias("changed"))


def _inliers(figures: pd.DataFrame, loads: int) -> np.ndarray:
    """The loads of which no column stands out among the others' discrimination, by five median deviations; at least half of them."""
    table = figures[figures["model"] < loads].pivot(index="model", columns="column_name", values="auc_alone")
    table = table.reindex(range(loads)).fillna(0.5)
    off = table - table.median()
    excess = (off / (1.4826 * off.abs().median() + 0.002)).max(axis=1).to_numpy()
    return (excess <= 5.0) | (excess <= np.median(excess))


def _figures(rows: DataFrame, frame: _Frame, weights: list[np.ndarray], joint: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """``model, rows, column_name, auc, auc_without, auc_alone, z, z_drop`` of held-out rows, by counted scores."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, joint))
    variants = 1 + 2 * len(columns)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, both = shared.value
        seen, ones, zeros = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for batch in batches:
            if not len(batch):
                continue
            row, model, label, fold = frame.uses(batch)
            fit = 2 * model + fold
            logit = np.clip(_logits([x[row] for x in frame.inputs(batch)], own, fit), -30, 30)
            parts = logit * both[fit][:, 1:]
            whole = parts.sum(1) + both[fit][:, 0]
            every = np.concatenate([whole[:, None], whole[:, None] - parts, logit], 1)
            bins = np.rint(np.arcsinh(every * _FINE) * _PER_FOLD).astype(np.int64) + 512
            code = (((fit[:, None] * variants) + np.arange(variants)) * 1024 + np.clip(bins, 0, 1023)).ravel()
            which, place = np.unique(np.concatenate([seen, code]), return_inverse=True)
            labels = np.repeat(label, variants)
            ones = np.bincount(place, np.concatenate([ones, labels]), len(which))
            zeros = np.bincount(place, np.concatenate([zeros, 1 - labels]), len(which))
            seen = which
        yield pd.DataFrame({"fit": seen // 1024 // variants, "variant": (seen // 1024 % variants).astype(np.int32), "bin": (seen % 1024).astype(np.int32), "ones": ones.astype(np.int64), "zeros": zeros.astype(np.int64)})

    counted = rows.mapInPandas(score, "fit long, variant int, bin int, ones long, zeros long").groupBy("fit", "variant", "bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    below = F.sum("zeros").over(Window.partitionBy("fit", "variant").orderBy("bin")) - F.col("zeros") / 2
    # Scores of the two fits of a model are not compared: the figure is the mean of the folds', by their rows.
    folds = counted.withColumn("_won", F.col("ones") * below).groupBy("fit", "variant").agg(F.sum("_won").alias("_won"), F.sum("ones").alias("_n1"), F.sum("zeros").alias("_n0"))
    figures = folds.where((F.col("_n1") > 0) & (F.col("_n0") > 0)).groupBy(F.floor(F.col("fit") / 2).alias("model"), "variant").agg((F.sum(F.col("_won") / F.col("_n0")) / F.sum("_n1")).alias("auc"), F.sum("_n1").alias("n1"), F.sum("_n0").alias("n0"))
    wide = figures.groupBy("model").agg(F.max("n1").alias("_n1"), F.max("n0").alias("_n0"), *[F.max(F.when(F.col("variant") == v, F.col("auc"))).alias(f"_a{v}") for v in range(variants)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("_a0").alias("auc"), F.col(f"_a{1 + i}").alias("auc_without"), F.col(f"_a{1 + len(columns) + i}").alias("auc_alone")) for i, c in enumerate(columns)]
    error = F.sqrt((F.col("_n1") + F.col("_n0") + 1) / (12 * F.col("_n1") * F.col("_n0")))
    table = wide.select("model", F.col("_n1").alias("rows"), error.alias("_error"), F.inline(F.array(*cells)))
    return table.select("model", "rows", "column_name", "auc", "auc_without", "auc_alone", ((F.col("auc_alone") - 0.5) / F.col("_error")).alias("z"), ((F.col("auc") - F.col("auc_without")) / F.col("_error")).alias("z_drop"))


def _as_input(x: Column, dtype: str, kind: str) -> Column:
    """A column as one number: itself, days or seconds, 1 or 0, or the hash state of its text."""
    if kind == "text":
        return F.when(x.isNotNull(), F.pmod(F.xxhash64((F.to_json(x) if dtype.startswith(("struct", "map", "array")) else x.cast("string"))), F.lit(_TEXT_STATES))).cast("double")
    if dtype == "date":
        return F.unix_date(x).cast("double")
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(x.cast("timestamp")).cast("double")
    return x.cast("double") if kind == "number" else x.cast("int").cast("double")


def out_of_line(df: DataFrame, columns: Sequence[str], *, load: str = "load_id", row_id: str = "feature_id", unsigned: Sequence[str] = (), nulls: float = 0.12, odd: float = 0.03, distinct: float = 0.5, factor: float = 10.0, share: float = 0.2) -> DataFrame:
    """Loads and columns that are out of line with the other loads: ``load_id, column_name, reasons``.

    Candidates are the loads and columns in which :func:`load_shifts` finds a change; their
    exact figures are then held against the median over all loads of the same figure. Reasons: ``nulls``
    (share of nulls off by at least that much), ``odd`` (NaN, exact zeros and, for ``unsigned`` columns,
    negatives make up that share of the non-null values), ``distinct`` (distinct values for each non-null value
    under that part of the median), ``scale`` (median absolute value off by that factor), ``share`` (share
    of true, or of positive values of a signed column, off by at least that much). A figure that does
    not exist (no non-null value) is no reason.
    """
    types = dict(df.dtypes)
    figures = profile_loads(df.select(load, row_id, *columns), list(columns), load=load)
    full = F.nullif(F.col("n_rows") - F.col("n_null"), F.lit(0))
    flags = [c for c in columns if types[c] == "boolean"]
    is_flag, is_unsigned = F.col("column_name").isin(flags), F.col("column_name").isin(list(unsigned))
    figures = figures.select(
        F.col(load).alias("_load"),
        "column_name",
        (F.col("n_null") / F.col("n_rows")).alias("null_share"),
        F.when(~is_flag, (F.col("n_nan") + F.col("n_zero") + F.when(is_unsigned, F.col("n_negative")).otherwise(0)) / full).alias("odd_share"),
        F.when(~is_flag, F.col("n_distinct") / full).alias("distinct_share"),
        "median_abs",
        F.when(is_flag, F.col("n_true") / full).when(~is_unsigned, F.col("n_positive") / full).alias("true_share"),
    )
    measures = ["null_share", "distinct_share", "median_abs", "true_share"]
    usual = figures.groupBy(F.col("column_name").alias("_column")).agg(*[F.median(m).alias(f"usual_{m}") for m in measures])
    shifts = load_shifts(df, columns, load=load, row_id=row_id).where("changed").select(F.col(load).alias("_load2"), F.col("column_name").alias("_column2"))
    candidates = figures.join(shifts, F.col("_load").eqNullSafe(F.col("_load2")) & (F.col("column_name") == F.col("_column2")), "left_semi")
    held = candidates.join(usual, F.col("column_name") == F.col("_column"))
    off = lambda m: F.round(F.abs(F.col(m) - F.col(f"usual_{m}")), 12)
    size, usual_size = F.col("median_abs"), F.col("usual_median_abs")
    checks = {
        "nulls": off("null_share") >= nulls,
        "odd": F.col("odd_share") >= odd,
        "distinct": F.col("distinct_share") < distinct * F.col("usual_distinct_share"),
        "scale": (size >= factor * usual_size) | (size * factor <= usual_size),
        "share": off("true_share") >= share,
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return held.select(F.col("_load").alias(load), "column_name", reasons.alias("reasons")).where(F.size("reasons") > 0)
