"""Which movers came near each other: an interval and distance self-join without a nested loop.

1. Space and time are cut into coarse cells, and only fixes in a cell that some other
   mover also touches go on. One small aggregation, and open sea drops out.
2. The rest is cut into finer cells a few times the search distance. Movers, not
   fixes, are paired per fine cell, so a mover with a third of all fixes never meets
   itself; then the fixes of the two movers in that cell are compared exactly.

Every fix has one home cell and is also entered into each cell that lies within the
distance of it, so a pair is found in the home cell of its lower key. Columns of cells
narrow with latitude and are counted modulo the full circle: neither the antimeridian
nor a pole hides a neighbour.

Defined results: bounds are inclusive; fixes with a null time, key or coordinate, or an
impossible coordinate, take no part; repeated fixes count once; a mover is not near
itself; empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_M, haversine_m

def _slot(us: str, length: int) -> Column:
    """Number of the time slot, rounded down for times before the epoch too."""
    return F.expr(f"(({us}) - pmod({us}, {length}L)) div {length}L")


def _columns_in(row: Column, height: float) -> Column:
    """How many cells of at least ``height`` degrees' width a row of cells has."""
    edge = F.least(F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90)), F.lit(90.0))
    return F.greatest(F.lit(1.0), F.floor(360.0 * F.cos(F.radians(edge)) / height)).cast("long")


def in_cells(fixes: DataFrame, *, size_m: float, slot_us: int, distance_m: float, window_us: int) -> DataFrame:
    """Fixes (mmsi, us, lon, lat) entered into their home cell and all cells within reach.

    Adds ``cell``, a hash of row, column and time slot (where two cells collide, the exact
    test still decides), and ``home``."""
    height = math.degrees(size_m / EARTH_M)
    reach = math.degrees(distance_m / EARTH_M) * 1.01  # wider than any figure of the earth makes it
    bands = fixes.withColumn(
        "row", F.explode(F.sequence(F.floor((F.greatest(F.col("lat") - reach, F.lit(-90.0)) + 90) / height), F.floor((F.least(F.col("lat") + reach, F.lit(90.0)) + 90) / height)))
    )
    # the widest turn of longitude that the distance can make from this latitude
    turn = F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-12))))
    turn = F.when(F.abs("lat") + reach >= 90, 180.0).otherwise(F.degrees(turn))
    n = _columns_in(F.col("row"), height)
    low, high = F.floor((F.col("lon") + 180 - F.col("turn")) * F.col("n") / 360.0), F.floor((F.col("lon") + 180 + F.col("turn")) * F.col("n") / 360.0)
    cols = bands.withColumns({"turn": turn, "n": n}).withColumn(
        "col", F.explode(F.array_distinct(F.transform(F.sequence(low, F.least(high, low + F.col("n") - 1)), lambda c: F.pmod(c, F.col("n")))))
    )
    return cols.withColumn(
        "slot", F.explode(F.sequence(_slot(f"us - {window_us}L", slot_us), _slot(f"us + {window_us}L", slot_us)))
    ).withColumn(
        "home",
        (F.col("row") == F.floor((F.col("lat") + 90) / height))
        & (F.col("col") == F.pmod(F.floor((F.col("lon") + 180) * F.col("n") / 360.0), F.col("n")))
        & (F.col("slot") == _slot("us", slot_us)),
    ).withColumn("cell", F.xxhash64("row", "col", "slot")).drop("turn", "n", "row", "col", "slot")


def meetings(positions: DataFrame, *, distance_m: float, window_s: int, metres: Callable[..., Column] = haversine_m) -> DataFrame:
    """Pairs of fixes of two movers within the distance and time of each other:
    (key_a, key_b, us_a, us_b, coordinates, metres), key_a < key_b."""
    window = window_s * 1_000_000
    fixes = positions.where("abs(lat) <= 90 and abs(lon) <= 180").select(
        "mmsi", F.unix_micros("reported_at").alias("us"), "lon", "lat"
    ).where("mmsi is not null and us is not null")
    bounds = {"distance_m": distance_m, "window_us": window}
    coarse = in_cells(fixes, size_m=5 * distance_m, slot_us=3 * window, **bounds)
    shared = coarse.groupBy("cell").agg(F.min("mmsi").alias("lo"), F.max("mmsi").alias("hi")).where("lo < hi").select("cell")
    met = coarse.where("home").join(shared, "cell", "left_semi").select("mmsi", "us", "lon", "lat").distinct()
    fine = in_cells(met, size_m=4 * distance_m, slot_us=4 * window, **bounds)
    members = fine.groupBy("cell", "mmsi").agg(F.max("home").alias("home"))
    lower, upper = members.where("home").select("cell", F.col("mmsi").alias("key_a")), members.select("cell", F.col("mmsi").alias("key_b"))
    movers = lower.join(upper, "cell").where("key_a < key_b")
    side = lambda s: [F.col(c).alias(f"{n}_{s}") for c, n in (("mmsi", "key"), ("us", "us"), ("lon", "lon"), ("lat", "lat"))]
    a, b = fine.where("home").select("cell", *side("a")), fine.select("cell", *side("b"))
    return (
        movers.join(a, ["cell", "key_a"])
        .join(b, ["cell", "key_b"])
        .withColumn("metres", metres(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")))
        .where((F.abs(F.col("us_a") - F.col("us_b")) <= window) & (F.col("metres") <= distance_m))
        .drop("cell")
    )


def near_pairs(positions: DataFrame, *, distance_m: float = 400.0, window_s: int = 300) -> DataFrame:
    """(key_a, key_b), key_a < key_b: movers with fixes within the distance and time of each other."""
    return meetings(positions, distance_m=distance_m, window_s=window_s).select("key_a", "key_b").distinct()
