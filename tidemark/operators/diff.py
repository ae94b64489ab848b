"""Field-by-field differences between two copies of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fold import first_values


def _copy(df: DataFrame, key: Sequence[str], fields: Sequence[str], normalise: Callable[[str, Column], Column], side: str, tie: str | None) -> DataFrame:
    named = df.select(
        *[normalise(k, F.col(k)).alias(f"_k{i}") for i, k in enumerate(key)],
        *[normalise(f, F.col(f)).alias(f"_f{i}") for i, f in enumerate(fields)],
        (F.col(tie) if tie else F.lit("")).alias("_tie"),
    )
    keys = [f"_k{i}" for i in range(len(key))]
    first = first_values(named, [f"_f{i}" for i in range(len(fields))], "_tie")
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_rows"), F.struct(*[x.alias(n) for n, x in first.items()]).alias(f"_{side}"))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    *,
    tolerance: dict[str, float] | None = None,
    normalise: Callable[[str, Column], Column] = lambda name, x: x,
    tie: str | None = None,
) -> DataFrame:
    """Keys of only one copy and keys whose fields differ.

    Columns: the key; ``kind`` (``left_only``, ``right_only``, ``changed``); ``left_rows`` and
    ``right_rows``, how often the key occurs; ``differences``, an array of
    ``(field, left_value, right_value)``, empty for one-sided keys, in the order of ``fields``.

    Both copies are folded to one row for each key before the exchange, so repeated rows, however many,
    cost nothing there; of rows with one key but other values the one with the smallest ``tie``
    counts (without ``tie``, or where it is no number, ties go to the smallest values, nulls first). The copies meet in a full outer join that takes
    a null in the key as a value. Numbers differ if they are more than ``tolerance`` apart, judged to
    nine decimals; two nulls, or two NaN, are equal, a null and a value differ. An empty copy makes
    every key one-sided. Only the named columns are read.
    """
    tolerance = tolerance or {}
    types = dict(left.dtypes)
    a, b = _copy(left, key, fields, normalise, "left", tie), _copy(right, key, fields, normalise, "right", tie)
    a = a.withColumnsRenamed({f"_k{i}": f"_l{i}" for i in range(len(key))})
    b = b.withColumnsRenamed({f"_k{i}": f"_r{i}" for i in range(len(key))})
    match = reduce(lambda x, y: x & y, [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(key))])
    both = a.join(b, match, "full_outer")
    changes = []
    for i, name in enumerate(fields):
        x, y = F.col(f"_left._f{i}"), F.col(f"_right._f{i}")
        if types[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[name].startswith("decimal"):
            apart = F.coalesce(F.round(F.abs(x - y), 9) > F.lit(float(tolerance.get(name, 0.0))), F.lit(True))
            changed = ~x.eqNullSafe(y) & apart
        else:
            changed = ~x.eqNullSafe(y)
        changes.append(F.when(changed, F.struct(F.lit(name).alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))))
    kind = F.when(F.col("right_rows").isNull(), "left_only").when(F.col("left_rows").isNull(), "right_only").otherwise("changed")
    none = F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    differences = F.when(kind == "changed", F.array_compact(F.array(*changes))).otherwise(none)
    keys = [F.when(F.col("left_rows").isNull(), F.col(f"_r{i}")).otherwise(F.col(f"_l{i}")).alias(k) for i, k in enumerate(key)]
    out = both.select(*keys, kind.alias("kind"), F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"), differences.alias("differences"))
    return out.where((F.col("kind") != "changed") | (F.size("differences") > 0))
