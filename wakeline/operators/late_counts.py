"""Late and out-of-order events: hourly counts by event time that are amended, not recounted.

A count is the sum of cells keyed by (vessel, hour, source, version). The version is the
sequence of the batch that brought the rows: no two batches share a cell, and a cell only
ever grows, so states merge by the maximum of each cell and a count is the sum over its
cells. Replaying a batch under its sequence, splitting it into batches with sequences of
their own or merging states in another order gives the same count.

An hour is published ``grace`` after its end; rows received from then until ``cutoff``
after its end amend it, later ones are dropped. Defined results: rows without both
times, without a vessel or without an arrival time are not counted; an hour whose
first row arrives after publication counts as amended from nothing; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
CELL = ["mmsi", "hour_start", "source", "version"]


def cells(deliveries: DataFrame, *, batch: int = 0, grace_s: int = 300, cutoff_s: int = 21_600) -> DataFrame:
    """State of a batch of first deliveries: on-time and amending counts per cell.

    ``batch`` is its sequence, which must be its own wherever states are merged."""
    event, received = F.unix_micros(F.coalesce("reported_at", "received_at")), F.unix_micros("received_at")
    rows = deliveries.where(F.col("mmsi").isNotNull() & F.col("received_at").isNotNull()).select(
        "mmsi", F.coalesce("source", F.lit("")).alias("source"), F.lit(batch).cast("long").alias("version"),
        received.alias("received"), (event - F.pmod(event, F.lit(HOUR))).alias("hour"),
    )
    late_by = F.col("received") - F.col("hour") - F.lit(HOUR)
    rows = rows.where(late_by < cutoff_s * 1_000_000)
    on_time = F.when(late_by < grace_s * 1_000_000, 1)
    return rows.groupBy("mmsi", F.expr("hour div 1000000").alias("hour_start"), "source", "version").agg(
        F.count(on_time).alias("on_time"), (F.count(F.lit(1)) - F.count(on_time)).alias("late")
    )


def merge(*states: DataFrame) -> DataFrame:
    """The join of states: each cell's maximum."""
    both = states[0]
    for other in states[1:]:
        both = both.unionByName(other)
    return both.groupBy(*CELL).agg(F.max("on_time").alias("on_time"), F.max("late").alias("late"))


def counts(state: DataFrame) -> DataFrame:
    """(mmsi, hour_start, published, corrected): what was published and what holds now."""
    return state.groupBy("mmsi", "hour_start").agg(
        F.sum("on_time").alias("published"), F.sum(F.col("on_time") + F.col("late")).alias("corrected")
    )


def amended(state: DataFrame) -> DataFrame:
    """(mmsi, hour_start) of the hours whose count changed after publication."""
    return counts(state).where("corrected > published").select("mmsi", "hour_start")
