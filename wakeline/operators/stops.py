"""Stops and trips from location pings, in spite of noise, stray fixes and silences.

Stops are density clusters in space and time. A fix is a core fix if the mover spends at
least ``least_stay_s`` within ``radius_m`` of it and within ``reach_s`` before and after;
fixes come at uneven intervals, so the minimum is of time, not of points: legs of the track
count with their length, a silence with at most ``silence_s``, and single stray fixes
are removed first. Core fixes that follow each other within the same distance and
time are density-reachable and make one cluster; what is in no cluster is noise, in order a
trip. Each cluster is then brought to what a stop is: it takes in all fixes along the track
within the radius of its middle (the median), passing over single strays, until cluster and
middle agree.

Blocks of a track (``track_blocks``) are clustered apart. A stop that crosses a border
is seen from both sides and its parts are joined where they overlap, or where a silence
parts them and nothing else does. A single fix at a border is left to the block that has
it in its middle, and passed over where the parts around it meet. Parts per mover are bounded by time, not by rows.

Defined results: fixes with a null or impossible coordinate, time or mover are left out;
copies count once; a mover that never rests has no stop and no trip; a silence belongs
to a stop if the mover is still there after it; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_m
from wakeline.operators.spikes import M_PER_DEG, _shift
from wakeline.operators.track_blocks import in_blocks, map_blocks
from wakeline.workspace import cut

BLOCK_S, HALO_S = 172_800, 7_200
OUT = (
    "kind string, mmsi long, block long, start_us long, end_us long, n long, lon double, lat double,"
    "lon2 double, lat2 double, way_start double, way_end double, opens boolean, closes boolean"
)


def _metres(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float) -> np.ndarray:
    return np.hypot((lon - lon0) * np.cos(np.radians((lat + lat0) / 2)), lat - lat0) * M_PER_DEG


def _without_strays(v: np.ndarray, group: np.ndarray, t: np.ndarray) -> np.ndarray:
    before, after = _shift(v, -1, group, t), _shift(v, 1, group, t)
    m = np.maximum(np.minimum(before, after), np.minimum(np.maximum(before, after), v))
    return np.where(np.isnan(m), v, m)


def _grow(lon: np.ndarray, lat: np.ndarray, a: int, b: int, low: int, high: int, radius: float) -> tuple[int, int, float, float]:
    """The stretch [a, b] of fixes around a seed, within [low, high], and its middle."""
    for _ in range(6):
        x, y = float(np.median(lon[a : b + 1])), float(np.median(lat[a : b + 1]))
        near = _metres(lon[low : high + 1], lat[low : high + 1], x, y) <= radius
        # a fix is passed over if it is single: its follower is near again
        left = np.flatnonzero(~(near[: a - low] | np.r_[near[1 : a - low], True][: a - low]) if a > low else np.array([], bool))
        right_part = near[b - low + 1 :]
        right = np.flatnonzero(~(right_part | np.r_[True, right_part[:-1]])) if len(right_part) else np.array([], int)
        # two fixes away in a row end the stretch
        na = low + (int(left[-1]) + 1 if len(left) else 0)
        nb = b + (int(right[0]) - 1 if len(right) else len(right_part))
        inner = np.flatnonzero(near[na - low : nb - low + 1])
        if not len(inner):
            return a, b, x, y
        # gaps of two or more inside the seed itself
        na, nb = na + int(inner[0]), na + int(inner[-1])
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    return a, b, x, y


def _split(lon: np.ndarray, lat: np.ndarray, a: int, b: int, x: float, y: float, radius: float) -> list[tuple[int, int]]:
    """The stretches of [a, b] without two fixes in a row beyond the radius."""
    near = np.flatnonzero(_metres(lon[a : b + 1], lat[a : b + 1], x, y) <= radius)
    if not len(near):
        return []
    cuts = np.flatnonzero(np.diff(near) > 2)
    return [(a + int(s), a + int(e)) for s, e in zip(near[np.r_[0, cuts + 1]], near[np.r_[cuts, len(near) - 1]])]


def core_fixes(x: np.ndarray, y: np.ndarray, group: np.ndarray, t: np.ndarray, radius: float, reach_s: float, least_stay_s: float, silence_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each fix is a core fix, and the time along the track with silences cut short.

    The k-th following fix is looked at for all fixes at once; a leg counts for a fix if both
    its ends are near."""
    n = len(t)
    leg = np.minimum(np.diff(t, prepend=t[:1]), silence_s)  # the leg that ends at each fix
    leg[np.r_[True, group[1:] != group[:-1]]] = 0
    clock = np.cumsum(leg)
    stay = np.zeros(n)
    at, held, now = np.arange(n), np.ones(n, bool), np.ones(n, bool)  # held: is the k-th following fix near
    for k in range(1, n):
        at = at[at + k < n]
        at = at[(group[at + k] == group[at]) & (clock[at + k] - clock[at] <= reach_s)]
        if not len(at):
            break
        now = np.zeros(n, bool)
        now[at] = _metres(x[at + k], y[at + k], x[at], y[at]) <= radius
        near = at[now[at]]
        ahead = near[held[near]]  # legs from the fix onwards
        stay[ahead] += leg[ahead + k]
        behind = near[held[near + 1]]  # legs up to the fix
        stay[behind + k] += leg[behind + 1]
        held = now
    return stay >= least_stay_s, clock


def cluster(c: dict[str, np.ndarray], group: np.ndarray, radius: float = 500.0, least_s: float = 3600.0, reach_s: float = 2400.0, least_stay_s: float = 1200.0, silence_s: float = 1800.0) -> pa.Table:
    """Parts of stops, and the way made, of whole blocks."""
    t, lon, lat, core = c["us"] / 1e6, c["lon"], c["lat"], c["core"].astype(bool)
    n = len(t)
    x, y = _without_strays(lon, group, t), _without_strays(lat, group, t)
    same = np.r_[False, group[1:] == group[:-1]]
    leg = np.zeros(n)
    leg[1:] = np.where(same[1:], np.hypot((x[1:] - x[:-1]) * np.cos(np.radians((y[1:] + y[:-1]) / 2)), y[1:] - y[:-1]) * M_PER_DEG, 0.0)
    way = np.cumsum(leg)
    first, last = np.flatnonzero(~same), np.r_[np.flatnonzero(~same)[1:] - 1, n - 1]
    dense, clock = core_fixes(x, y, group, t, radius, reach_s, least_stay_s, silence_s)
    rows: list[tuple] = []
    for low, high in zip(first, last):
        mmsi, block = int(c["mmsi"][low]), int(c["block"][low])
        mine = np.flatnonzero(core[low : high + 1]) + low
        if not len(mine):
            continue  # all of it belongs to the neighbouring blocks, which see more
        i, j = mine[0], mine[-1]
        zero = way[i] - leg[i]
        rows.append(("block", mmsi, block, c["us"][i], c["us"][j], len(mine), lon[i], lat[i], lon[j], lat[j], 0.0, way[j] - zero, i > low, False))
        seeds = np.flatnonzero(dense[low : high + 1]) + low
        ranges = [(low, low), (high, high)]  # what goes on in the blocks beside
        if len(seeds):
            apart = (_metres(x[seeds[1:]], y[seeds[1:]], x[seeds[:-1]], y[seeds[:-1]]) > radius) | (np.diff(clock[seeds]) > reach_s)
            cuts = np.flatnonzero(apart)
            ranges += [(int(s), int(e)) for s, e in zip(seeds[np.r_[0, cuts + 1]], seeds[np.r_[cuts, len(seeds) - 1]])]
        found: set[tuple[int, int]] = set()
        for s, e in sorted(ranges, key=lambda r: r[0] - r[1]):
            if any(a <= s and e <= b for a, b in found):
                continue
            a, b, mx, my = _grow(lon, lat, s, e, low, high, radius)
            for a, b in _split(lon, lat, a, b, mx, my, radius):
                mx, my = float(np.median(lon[a : b + 1])), float(np.median(lat[a : b + 1]))
                opens, closes = a <= low + 1, b >= high - 1
                if (a, b) in found or not (opens or closes or t[b] - t[a] >= least_s):
                    continue
                found.add((a, b))
                if a == b and not core[a]:
                    continue
                rows.append(("part", mmsi, block, c["us"][a], c["us"][b], b - a + 1, mx, my, mx, my, way[a] - zero, way[b] - zero, opens, closes))
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 6, pa.bool_(), pa.bool_()]
    names = [f.split()[0] for f in OUT.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({k: pa.array([v.item() if hasattr(v, "item") else v for v in col], kind) for k, col, kind in zip(names, columns, kinds)})


def _parts(positions: DataFrame) -> DataFrame:
    fixes = positions.select("mmsi", F.unix_micros("reported_at").alias("us"), "lon", "lat").where(
        "mmsi is not null and us is not null and abs(lat) <= 90 and abs(lon) <= 180"
    )
    return cut(map_blocks(in_blocks(fixes, block_s=BLOCK_S, halo_s=HALO_S), cluster, OUT))


def _joined(parts: DataFrame, radius_m: float, least_s: int) -> DataFrame:
    """Stops from parts, with the way each mover had made at their start and end."""
    mover = Window.partitionBy("mmsi").orderBy("block")  # as many rows as blocks of time
    gap = haversine_m(F.lag("lon2").over(mover), F.lag("lat2").over(mover), F.col("lon"), F.col("lat"))
    blocks = parts.where("kind = 'block'").withColumn("bridge", F.when(F.col("opens"), 0.0).otherwise(F.coalesce(gap, F.lit(0.0))))
    base = blocks.select(
        "mmsi", "block",
        (F.sum(F.col("way_end") + F.col("bridge")).over(mover) - F.col("way_end")).alias("base"),
    )
    in_order = Window.partitionBy("mmsi").orderBy("start_us", "end_us", "block")
    pieces = parts.where("kind = 'part'")
    # single strays between two parts of one stop
    a, b = ({k: f(k).over(in_order) for k in ("lon", "lat", "start_us", "end_us", "closes", "opens", "block")} for f in (F.lag, F.lead))
    meet = (b["start_us"] <= a["end_us"]) | (a["closes"] & b["opens"] & (a["block"] < b["block"]))
    stray = (F.col("n") == 1) & meet & (haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]) <= radius_m)
    pieces = pieces.withColumn("stray", F.coalesce(stray, F.lit(False))).where("not stray")
    before = {k: F.lag(k).over(in_order) for k in ("lon", "lat", "closes", "block")}
    until = F.max("end_us").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    near = haversine_m(before["lon"], before["lat"], F.col("lon"), F.col("lat")) <= radius_m
    meets = (F.col("start_us") <= until) | (before["closes"] & F.col("opens") & (before["block"] < F.col("block")))
    return (
        pieces.join(base, ["mmsi", "block"], "left")
        .withColumn("fresh", F.when(near & meets, 0).otherwise(1))
        .withColumn("stop", F.sum("fresh").over(in_order))
        .groupBy("mmsi", "stop")
        .agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
            F.max_by("lon", "n").alias("lon"), F.max_by("lat", "n").alias("lat"),
            F.min_by(F.col("base") + F.col("way_start"), "start_us").alias("way_start"),
            F.max_by(F.col("base") + F.col("way_end"), "end_us").alias("way_end"),
        )
        .where(F.col("end_us") - F.col("start_us") >= least_s * 1_000_000)
    )


def stops_and_trips(positions: DataFrame, *, radius_m: float = 500.0, least_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """Stops (mmsi, start_us, end_us, duration_s, lon, lat) and the trips between them
    (mmsi, start_us, end_us, duration_s, distance_m, from and to coordinates)."""
    found = _joined(_parts(positions), radius_m, least_s)
    seconds = ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s")
    w = Window.partitionBy("mmsi").orderBy("start_us")
    legs = found.select(
        "mmsi", F.lag("end_us").over(w).alias("start_us"), F.col("start_us").alias("end_us"),
        F.greatest(F.col("way_start") - F.lag("way_end").over(w), F.lit(0.0)).alias("distance_m"),
        F.lag("lon").over(w).alias("from_lon"), F.lag("lat").over(w).alias("from_lat"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"),
    ).where("start_us is not null")
    return found.select("mmsi", "start_us", "end_us", seconds, "lon", "lat"), legs.select("*", seconds)
