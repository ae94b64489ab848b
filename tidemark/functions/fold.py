"""Folding rows of one key to one row, as a hash aggregate where the types allow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types whose aggregation buffers are updated in place, so that no sort is needed.
_PLAIN = ("bigint", "int", "smallint", "tinyint", "double", "float", "date", "timestamp", "timestamp_ntz", "boolean")


def first_values(df: DataFrame, names: Sequence[str], order: str | None) -> dict[str, Column]:
    """Aggregates that give ``names`` of the row that is first by ``order``, then by its values.

    Where ``order`` is a whole number and all values are of plain types these are hash aggregates, all taken from the
    same row; of rows that tie in ``order``, which a row id rules out, any one then counts. Rows without order come last.
    """
    types = dict(df.dtypes)
    if order and types[order] in ("bigint", "int") and all(types[n] in _PLAIN for n in names):
        place = F.coalesce(F.col(order).cast("bigint"), F.lit(2**63 - 1))
        return {n: F.min_by(n, place) for n in names}
    row = F.min(F.struct(*([F.col(order)] if order else []), *names))
    return {n: row[n] for n in names}
