"""Port calls, geofence crossings, encounters at sea and silences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import local_m
from wakeline.operators.containment import containing, coverage
from wakeline.operators.proximity import meetings
from wakeline.operators.timeline import interval, latest, runs, since, with_previous
from wakeline.workspace import cut


def in_ports(positions: DataFrame, ports: DataFrame, key: str = "position_id") -> DataFrame:
    """(key, port_id): the containing port whose centre is nearest, ties to the lower id.
    A port's boundary belongs to it.

    Only fixes in some port give a row."""
    met = containing(positions, cut(coverage(ports)), key, on_edge=True)
    centres = ports.select(F.col("id").cast("long").alias("region_id"), F.col("lon").alias("port_lon"), F.col("lat").alias("port_lat"))
    near = met.join(centres, "region_id").join(positions.select(key, "lon", "lat"), key)
    away = F.struct(local_m(F.col("lon"), F.col("lat"), F.col("port_lon"), F.col("port_lat")), "region_id")
    return near.groupBy(key).agg(F.min_by("region_id", away).cast("int").alias("port_id"))


def port_calls(positions: DataFrame, ports: DataFrame, open_calls: DataFrame | None = None, *, as_of: str, lookback: str | None = "6h", min_duration: str = "15m") -> DataFrame:
    """(mmsi, port_id, arrived_at, departed_at, min_sog, positions) of visits to ports.

    A visit is a run of a vessel's fixes in one port that lasts at least ``min_duration``;
    it is open (no departure) while the vessel has no later fix. With a ``lookback`` the
    vessels seen since then are scanned from then, or from the arrival of an open call.
    Null speeds are left out of the minimum; fixes without coordinates are in no port."""
    rows = positions.select("position_id", "mmsi", "reported_at", "lon", "lat", "sog").where(F.col("reported_at") <= F.lit(as_of).cast("timestamp"))
    if lookback is not None:
        start = since(rows, "reported_at", as_of, lookback).select("mmsi").distinct().withColumn("start_at", F.lit(as_of).cast("timestamp") - interval(lookback))
        if open_calls is not None:
            start = start.unionByName(open_calls.where("departed_at is null").select("mmsi", F.col("arrived_at").alias("start_at")))
        start = start.groupBy("mmsi").agg(F.min("start_at").alias("start_at"))
        rows = rows.join(start, "mmsi").where("reported_at >= start_at")
    tagged = rows.join(in_ports(rows, ports), "position_id", "left")
    found = runs(tagged, "mmsi", "reported_at", "position_id", "port_id", {"min_sog": F.min("sog")})
    last = found.groupBy("mmsi").agg(F.max("last_at").alias("seen_at"))
    return (
        found.where(F.col("port_id").isNotNull() & (F.col("last_at") - F.col("first_at") >= interval(min_duration)))
        .join(last, "mmsi")
        .select("mmsi", "port_id", F.col("first_at").alias("arrived_at"), F.when(F.col("seen_at") > F.col("last_at"), F.col("last_at")).alias("departed_at"), "min_sog", F.col("count").alias("positions"))
    )


def reconcile_calls(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known calls with newly scanned ones: the same arrival is one call, whose departure and
    count are the new ones and whose minimum speed is the least."""
    keys = ["mmsi", "port_id", "arrived_at"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by("departed_at", "_new").alias("departed_at"), F.min("min_sog").alias("min_sog"), F.max_by("positions", "_new").alias("positions"))


def geofence_crossings(positions: DataFrame, geofences: DataFrame, *, as_of: str, lookback: str | None = "10m") -> DataFrame:
    """(geofence_id, mmsi, event_type, occurred_at, lon, lat) of entries and exits.

    A crossing happens at the fix whose containment differs from the fix before; the first
    fix of a vessel gives none. The fences that hold a fix are compared as sets, so fixes
    far from every fence cost one row, not one per fence."""
    rows = since(positions, "reported_at", as_of, lookback).where(F.col("reported_at") <= F.lit(as_of).cast("timestamp")).where("lon is not null and lat is not null")
    inside = containing(rows, cut(coverage(geofences.where("active"))), "position_id", on_edge=True).groupBy("position_id").agg(F.collect_set("region_id").alias("fences"))
    none = F.array().cast("array<long>")
    held = rows.select("position_id", "mmsi", "reported_at", "lon", "lat").join(inside, "position_id", "left").withColumn("fences", F.coalesce("fences", none))
    step = with_previous(held, "mmsi", "reported_at", "position_id", {"were": "fences"}).where("_before is not null")
    change = F.array(
        F.struct(F.lit("enter").alias("event_type"), F.array_except("fences", "were").alias("ids")),
        F.struct(F.lit("exit").alias("event_type"), F.array_except("were", "fences").alias("ids")),
    )
    each = step.where("fences <> were").withColumn("c", F.explode(change)).withColumn("geofence_id", F.explode("c.ids"))
    return each.select(F.col("geofence_id").cast("int").alias("geofence_id"), "mmsi", F.col("c.event_type").alias("event_type"), F.col("reported_at").alias("occurred_at"), "lon", "lat").distinct()


def sts_events(positions: DataFrame, ports: DataFrame, *, as_of: str, lookback: str | None = "1h", max_distance_m: float = 500.0, max_speed_kn: float = 3.0, min_duration: str = "30m", tolerance_s: int = 300) -> DataFrame:
    """(mmsi_a, mmsi_b, started_at, ended_at, min_distance, centroid_lon, centroid_lat).

    Two slow vessels outside ports with fixes within the distance and time of each other
    over at least ``min_duration`` of the first vessel's fixes. The encounter is open
    while their latest fixes, at any speed, are still that near. Copies count once; null
    speeds are no slow fixes; the middle is the mean of the pairs' middles."""
    scope = since(positions, "reported_at", as_of, lookback).where(F.col("reported_at") <= F.lit(as_of).cast("timestamp"))
    slow = scope.where(F.col("sog") < max_speed_kn)
    away = slow.join(containing(slow, cut(coverage(ports)), "position_id", on_edge=True).select("position_id").distinct(), "position_id", "left_anti")
    met = meetings(away, distance_m=max_distance_m, window_s=tolerance_s, metres=local_m)
    pairs = met.groupBy("key_a", "key_b").agg(
        F.min("us_a").alias("from_us"), F.max("us_a").alias("to_us"), F.min("metres").alias("min_distance"),
        F.avg((F.col("lon_a") + F.col("lon_b")) / 2).alias("centroid_lon"), F.avg((F.col("lat_a") + F.col("lat_b")) / 2).alias("centroid_lat"),
    ).where(F.timestamp_micros("to_us") - F.timestamp_micros("from_us") >= interval(min_duration))
    now = latest(scope.select("mmsi", "reported_at", "position_id", "lon", "lat"), ["mmsi"], ["reported_at", "position_id"])
    side = lambda s: now.select(F.col("mmsi").alias(f"key_{s}"), F.col("lon").alias(f"now_lon_{s}"), F.col("lat").alias(f"now_lat_{s}"))
    still = local_m(F.col("now_lon_a"), F.col("now_lat_a"), F.col("now_lon_b"), F.col("now_lat_b")) <= max_distance_m
    return pairs.join(side("a"), "key_a").join(side("b"), "key_b").select(
        F.col("key_a").alias("mmsi_a"), F.col("key_b").alias("mmsi_b"), F.timestamp_micros("from_us").alias("started_at"),
        F.when(~still, F.timestamp_micros("to_us")).alias("ended_at"), F.col("min_distance").cast("float").alias("min_distance"), "centroid_lon", "centroid_lat",
    )


def detect_gaps(positions: DataFrame, port_calls: DataFrame, open_gaps: DataFrame, *, as_of: str, threshold: str = "6h", max_gap: str = "72h", active: str = "7d") -> DataFrame:
    """(mmsi, last_position, gap_hours, last_lon, last_lat) of vessels that fell silent.

    Silent for more than ``threshold`` and less than ``max_gap`` (both strict), not in an
    open port call and without an open gap. Ties of the last fix go to the later arrival."""
    t = F.lit(as_of).cast("timestamp")
    last = latest(since(positions, "reported_at", as_of, active).where(F.col("reported_at") <= t).select("mmsi", "reported_at", "position_id", "lon", "lat"), ["mmsi"], ["reported_at", "position_id"])
    quiet = last.where((F.col("reported_at") < t - interval(threshold)) & (F.col("reported_at") > t - interval(max_gap)))
    hours = F.floor((F.unix_micros(t) - F.unix_micros("reported_at")) / 3.6e9).cast("int")
    return (
        quiet.join(port_calls.where("departed_at is null").select("mmsi").distinct(), "mmsi", "left_anti")
        .join(open_gaps.where("resolved_at is null").select("mmsi").distinct(), "mmsi", "left_anti")
        .select("mmsi", F.col("reported_at").alias("last_position"), hours.alias("gap_hours"), F.col("lon").alias("last_lon"), F.col("lat").alias("last_lat"))
    )


def resolve_gaps(open_gaps: DataFrame, positions: DataFrame, *, as_of: str, far_m: float = 50_000.0) -> DataFrame:
    """Open gaps whose vessel was heard again: + resolved_at, resolution.

    The first fix after the gap decides; it is far if it lies more than ``far_m`` from the
    last one. A gap without coordinates is resolved in the same area."""
    gaps = open_gaps.where("resolved_at is null").select("mmsi", "last_position", "last_lon", "last_lat")
    later = positions.where(F.col("reported_at") <= F.lit(as_of).cast("timestamp")).select("mmsi", "reported_at", "position_id", "lon", "lat").join(gaps, "mmsi").where("reported_at > last_position")
    first = later.groupBy("mmsi", "last_position", "last_lon", "last_lat").agg(F.min(F.struct("reported_at", "position_id", "lon", "lat")).alias("f"))
    away = local_m(F.col("last_lon"), F.col("last_lat"), F.col("f.lon"), F.col("f.lat"))
    return first.select("mmsi", "last_position", F.col("f.reported_at").alias("resolved_at"), F.when(away > far_m, "reappeared_far").otherwise("reappeared_same_area").alias("resolution"))


def position_gaps(positions: DataFrame, *, as_of: str, lookback: str | None = "24h", min_gap: str = "1h") -> DataFrame:
    """(mmsi, gap_from, gap_to) of consecutive fixes more than ``min_gap`` apart (strict)."""
    rows = since(positions, "reported_at", as_of, lookback).where(F.col("reported_at") <= F.lit(as_of).cast("timestamp"))
    step = with_previous(rows.select("mmsi", "reported_at", "position_id"), "mmsi", "reported_at", "position_id", {"gap_from": "reported_at"})
    return step.where(F.col("reported_at") - F.col("gap_from") > interval(min_gap)).select("mmsi", "gap_from", F.col("reported_at").alias("gap_to"))
