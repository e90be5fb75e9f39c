"""Per-mover order without per-mover tasks.

``with_previous`` and ``runs`` give what LAG and gaps-and-islands give over
(key, time), but sort only blocks of time; what crosses a border is carried by one
summary row per block or run. A mover with a third of all rows is spread over its blocks.

Defined results: rows with a null key or time are left out; equal times are ordered by
the tie column; null values form runs of their own; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_S = 86_400


def interval(text: str) -> Column:
    """``'6h'``, ``'15m'``, ``'7d'`` or ``'30s'`` as an interval column."""
    unit = {"d": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}[text[-1]]
    return F.expr(f"INTERVAL '{int(text[:-1])}' {unit}")


def since(df: DataFrame, time: str, as_of: str, lookback: str | None) -> DataFrame:
    """Rows later than ``as_of - lookback`` (strict); all rows without a lookback."""
    if lookback is None:
        return df
    return df.where(F.col(time) > F.lit(as_of).cast("timestamp") - interval(lookback))


def _blocked(df: DataFrame, key: str, time: str, block_s: int) -> DataFrame:
    us = F.unix_micros(time)
    return df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_block", F.floor(us / (block_s * 1_000_000)))


def with_previous(df: DataFrame, key: str, time: str, tie: str, fields: dict[str, str], block_s: int = BLOCK_S) -> DataFrame:
    """Adds, per row, the values that ``fields`` (new name: column) had in the row before.

    A struct ``_before`` tells a missing row from a null value: it is null in the first row."""
    rows = _blocked(df, key, time, block_s)
    packed = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    order = F.struct(time, tie)
    w = Window.partitionBy(key, "_block").orderBy(time, tie)
    lasts = rows.groupBy(key, "_block").agg(F.max_by(packed, order).alias("_last"))
    over_blocks = Window.partitionBy(key).orderBy("_block")  # one row per block of time
    border = lasts.select(key, "_block", F.lag("_last").over(over_blocks).alias("_border"))
    out = rows.withColumn("_own", F.lag(packed).over(w)).join(border, [key, "_block"]).withColumn("_before", F.coalesce("_own", "_border"))
    return out.withColumns({n: F.col(f"_before.{n}") for n in fields}).drop("_own", "_border", "_block")


def runs(df: DataFrame, key: str, time: str, tie: str, value: str, sums: dict[str, Column], block_s: int = BLOCK_S) -> DataFrame:
    """Maximal runs of equal ``value`` per key: (key, value, first_at, last_at, count, ``sums``).

    ``sums`` are aggregates over a run that merge by minimum."""
    rows = _blocked(df, key, time, block_s)
    w = Window.partitionBy(key, "_block").orderBy(time, tie)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    part = (
        rows.withColumn("_fresh", fresh)
        .withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_block", "_run")
        .agg(F.first(value).alias(value), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.min(tie).alias("_tie"), F.count(F.lit(1)).alias("count"), *[c.alias(n) for n, c in sums.items()])
    )
    over = Window.partitionBy(key).orderBy("_block", "_run")  # one row per run and block
    joined = F.when(F.row_number().over(over) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(over)), 0).otherwise(1)
    return (
        part.withColumn("_join", joined)
        .withColumn("_whole", F.sum("_join").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_whole")
        .agg(F.first(value).alias(value), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("count").alias("count"), *[F.min(n).alias(n) for n in sums])
        .drop("_whole")
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
