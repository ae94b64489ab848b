"""Totals and averages over trailing calendar periods, quiet days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_totals(
    df: DataFrame, values: Sequence[str], windows: Sequence[int] = (7, 30), *, entity: str = "series_id", day: str = "date", repeated: str = "once", bucket_days: int = 360
) -> DataFrame:
    """For each entity and calendar day from its first to its last row: total, count and average over each trailing window.

    Columns: ``entity, day, first_day``, and for each value v and window w ``total_v_w``
    (0.0 without values), ``n_v_w`` and ``avg_v_w`` (null without values). A window of w days
    ends on and includes the day.

    Each daily value is exploded onto the output days it influences and grouped by entity and
    day; calendar rows are then joined for the days nothing influences. Work is split by entity
    and bucket of ``bucket_days`` days: a value is sent to the bucket of each day it influences
    (its own, seldom the next), after which explosion and grouping need no exchange, so neither
    the factor of the explosion nor a hot entity reaches the shuffle.

    repeated: rows of one entity and day count ``once`` (their largest present value) or as a
    ``sum``; both fold before the first exchange. Nulls and NaN are no values. Rows without a day
    are left out: no window holds them. A null entity is an entity. Empty input, empty result.
    """
    if repeated not in ("once", "sum"):
        raise ValueError(f"repeated must be once or sum, not {repeated!r}")
    if not windows or min(windows) < 1:
        raise ValueError("windows must be at least one day long")
    reach = max(windows)
    if bucket_days < reach:
        raise ValueError("a bucket must be at least as long as the longest window")
    fold = F.max if repeated == "once" else F.sum
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.select(F.col(entity).alias("_e"), F.unix_date(F.col(day).cast("date")).alias("_d"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names)])
    rows = rows.where(F.col("_d").isNotNull()).select("_e", "_d", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    daily = rows.groupBy("_e", "_d").agg(*[fold(n).alias(n) for n in names])

    bucket = lambda d: F.floor(d / F.lit(bucket_days)).cast("long")
    sent = daily.withColumn("_b", F.explode(F.sequence(bucket(F.col("_d")), bucket(F.col("_d") + (reach - 1)))))
    placed = sent.repartition("_e", "_b")
    first = F.greatest(F.col("_d").cast("long"), F.col("_b") * bucket_days)
    last = F.least(F.col("_d").cast("long") + (reach - 1), (F.col("_b") + 1) * bucket_days - 1)
    spread = placed.withColumn("_o", F.explode(F.sequence(first, last))).withColumn("_age", F.col("_o") - F.col("_d"))
    sums = []
    for n in names:
        for w in windows:
            x = F.when(F.col("_age") < w, F.col(n)) if w < reach else F.col(n)
            sums += [F.sum(x).alias(f"{n}_s{w}"), F.count(x).alias(f"{n}_c{w}")]
    totals = spread.groupBy("_e", "_b", "_o").agg(*sums)

    spans = daily.groupBy("_e").agg(F.min("_d").cast("long").alias("_first"), F.max("_d").cast("long").alias("_last"))
    calendar = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("_first")), bucket(F.col("_last")))))
    opened = F.greatest(F.col("_first"), F.col("_b") * bucket_days)
    closed = F.least(F.col("_last"), (F.col("_b") + 1) * bucket_days - 1)
    calendar = calendar.select("_e", "_first", F.explode(F.sequence(opened, closed)).alias("_day"))

    match = F.col("_e").eqNullSafe(F.col("_e2")) & (F.col("_day") == F.col("_o"))
    out = calendar.join(totals.withColumnRenamed("_e", "_e2"), match, "left")
    columns = []
    for v, n in zip(values, names):
        for w in windows:
            total, count = F.coalesce(F.col(f"{n}_s{w}"), F.lit(0.0)), F.coalesce(F.col(f"{n}_c{w}"), F.lit(0).cast("long"))
            columns += [total.alias(f"total_{v}_{w}"), count.alias(f"n_{v}_{w}"), (F.when(count > 0, total / count)).alias(f"avg_{v}_{w}")]
    as_date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return out.select(F.col("_e").alias(entity), as_date("_day").alias("day"), as_date("_first").alias("first_day"), *columns)
