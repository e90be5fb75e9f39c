"""Implausible readings of speed, course and heading, relative to each mover's own normal.

Three rules, each a row (position_id, field):

* plausibility: the value lies outside the field's range, and is no not-available code;
* stuck: it belongs to ``stuck`` or more identical readings in a row while under way;
* spike: it leaves the range spanned by the readings before, the readings after and the
  movement between fixes by more than a cutoff that is fitted, not set. These residuals
  are free of the way made; what is left varies with the voyage's seasons (moored or
  manoeuvring, under way), so a tail is fitted per mover, field and season: peaks over the
  level that a share ``peaks`` of the residuals passes follow a generalised Pareto
  distribution, faults among them a uniform one. The mixture of both is fitted by maximum
  likelihood, and the cutoff is the level that normal residuals pass with probability
  ``risk``. The shape is fitted over all movers of a field and season; threshold and scale
  are the mover's own, with the weight of ``prior`` residuals of all movers, so that a
  mover with few rows takes the cutoff of all.

The work is done per block of a track with a halo (``track_blocks``), in numpy. Residuals
reach the fit as counts per bin, so nothing grows with the rows of a mover. Runs of equal
readings are counted in the block's own rows; those that touch a border are summed over
the blocks, so a border cuts no run.

Defined results: copies of a delivery share their verdict; fixes with a null mover or
time are judged by plausibility alone; an impossible position leaves its readings to be
judged like all others; null readings and codes are never reported and do
not end a run, nor does a silence; a silence longer than the halo separates neighbours;
residuals within ``RESOLUTION`` are rounding, no spikes; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.track_blocks import in_blocks, map_blocks
from wakeline.workspace import cut

BLOCK_S, HALO_S = 172_800, 10_800
HOUR_US, SALTS = 3_600_000_000, 16
#: Ranges and not-available codes of the fields.
RANGE = {"sog": (0.0, 102.3), "cog": (0.0, 360.0), "heading": (0.0, 360.0)}
CODE = {"sog": 102.3, "cog": 360.0, "heading": 511.0}
FIELDS = ("sog", "cog", "heading")

#: Bin edges of residuals: log-spaced, per field in knots or degrees.
EDGES = {"sog": np.geomspace(0.04, 110, 64), "cog": np.geomspace(0.2, 180, 64), "heading": np.geomspace(0.2, 180, 64)}
#: Three steps of each sensor's scale.
RESOLUTION = {"sog": 0.2, "cog": 0.3, "heading": 3.0}
#: Grids of the fit - scale against the threshold, share of faults, shape.
SCALES, FAULTS, SHAPES = np.geomspace(1 / 64, 4, 56), np.array([0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5]), (-0.2, -0.1, 0.0, 0.1, 0.2, 0.3)
UNDER_WAY_KN = 1.5
KNOT = 0.514444
M_PER_DEG = 111_194.9


def _shift(a: np.ndarray, k: int, group: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The k-th following value (preceding for negative k) in the block and within the halo."""
    out = np.full(len(a), np.nan)
    if abs(k) >= len(a):
        return out
    here, there = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k))
    ok = (group[here] == group[there]) & (np.abs(t[here] - t[there]) <= HALO_S)
    out[here] = np.where(ok, a[there], np.nan)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest angle between directions."""
    return np.abs((a - b + 180) % 360 - 180)


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray, circular: bool) -> np.ndarray:
    """Median of the first valid readings: of three the middle one, of two or one the nearest."""
    if not circular:
        mid = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    else:
        ab, ac, bc = _apart(a, b), _apart(a, c), _apart(b, c)
        mid = np.where((ab + ac <= ab + bc) & (ab + ac <= ac + bc), a, np.where(ab + bc <= ac + bc, b, c))
    return np.where(np.isnan(c), a, mid)


def _at(x: np.ndarray, y: np.ndarray, group: np.ndarray, t: np.ndarray, gap: float) -> tuple[np.ndarray, ...]:
    """Index of the nearest fix with a position at least ``gap`` seconds earlier and later, -1 where none."""
    order = group * 1e9 + (t - t.min())
    held = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    n = len(held)
    if not n:
        return np.full(len(t), -1), np.full(len(t), -1)
    early = np.searchsorted(order[held], order - gap, side="right") - 1
    late = np.searchsorted(order[held], order + gap, side="left")
    i, j = held[np.maximum(early, 0)], held[np.minimum(late, n - 1)]
    return np.where((early >= 0) & (group[i] == group), i, -1), np.where((late < n) & (group[j] == group), j, -1)


def movement(c: dict[str, np.ndarray], group: np.ndarray, gap: float = 75.0) -> tuple[np.ndarray, np.ndarray]:
    """Speed in knots and bearing over the ground around each fix, from fixes alone.

    Positions pass a median of three first, which removes single stray fixes; a base of
    ``gap`` seconds on either side keeps receiver noise small against the way made. Fixes
    without a position (NaN) are no base of others; they lie on the line between the fixes
    around them, or move as the last fix beside them does."""
    t = c["us"] / 1e6
    lon, lat = c["lon"], c["lat"]
    held = ~(np.isnan(lon) | np.isnan(lat))
    x, y = np.full(len(t), np.nan), np.full(len(t), np.nan)
    for v, smooth in ((lon[held], x), (lat[held], y)):
        before, after = _shift(v, -1, group[held], t[held]), _shift(v, 1, group[held], t[held])
        m = np.maximum(np.minimum(before, after), np.minimum(np.maximum(before, after), v))
        smooth[held] = np.where(np.isnan(m), v, m)
    early, late = _at(x, y, group, t, gap)
    here, lost = np.arange(len(t)), np.flatnonzero(~held)
    beside = np.full(len(lost), -1)
    if len(lost):
        p, q = (a[lost] for a in _at(x, y, group, t, 0.0))
        p, q = (np.where((k >= 0) & (np.abs(t[k] - t[lost]) <= HALO_S), k, -1) for k in (p, q))
        part = (t[lost] - t[p]) / np.maximum(t[q] - t[p], 1e-6)
        both = (p >= 0) & (q >= 0)
        for v in (x, y):
            v[lost] = np.where(both, v[p] + part * (v[q] - v[p]), np.nan)
        beside = np.where(both, -1, np.maximum(p, q))
    speeds, ways = [], []
    for i, j in ((early, late), (early, here), (here, late)):
        ok = (i >= 0) & (j >= 0)
        i, j = np.maximum(i, 0), np.maximum(j, 0)
        dt = t[j] - t[i]
        dx = (x[j] - x[i]) * np.cos(np.radians((y[i] + y[j]) / 2)) * M_PER_DEG
        dy = (y[j] - y[i]) * M_PER_DEG
        ok &= (dt > 0) & (dt <= 2 * HALO_S)
        with np.errstate(divide="ignore", invalid="ignore"):
            speeds.append(np.where(ok, np.hypot(dx, dy) / dt / KNOT, np.nan))
        ways.append(np.where(ok, np.degrees(np.arctan2(dx, dy)) % 360, np.nan))
    whole, before, after = speeds
    speed = _middle(np.where(np.isnan(whole), np.where(np.isnan(before), after, before), whole), before, after, False)
    speed = np.where(np.isnan(speed), whole, speed)
    way = np.where(np.isnan(ways[0]), np.where(np.isnan(ways[1]), ways[2], ways[1]), ways[0])
    slow = np.fmin(np.fmin(before, after), whole)
    alone = beside >= 0
    for v in (speed, way, slow):
        v[lost[alone]] = v[beside[alone]]
    return speed, way, np.where(np.isnan(slow), 0, slow)


def residuals(value: np.ndarray, speed: np.ndarray, way: np.ndarray, group: np.ndarray, t: np.ndarray, field: str) -> np.ndarray:
    """How far each valid reading lies outside what its neighbours and the movement span."""
    circular = field != "sog"
    sides = []
    for sign in (-1, 1):
        near = [_shift(value, sign * k, group, t) for k in (1, 2, 3)]
        sides.append(_middle(*near, circular))
    moved = way if circular else speed
    expect = [*sides, moved]
    if not circular:
        low, high = np.fmin.reduce(expect), np.fmax.reduce(expect)
        r = np.fmax(np.fmax(low - value, value - high), 0)
    else:
        r = np.fmin.reduce([_apart(value, e) for e in expect])
        turn = (sides[1] - sides[0] + 180) % 360 - 180
        part = (value - sides[0] + 180) % 360 - 180
        between = (part * turn >= 0) & (np.abs(part) <= np.abs(turn)) & (np.abs(turn) < 120)
        r = np.where(between, 0.0, r)
    known = np.sum([~np.isnan(e) for e in expect], axis=0)
    return np.where(known >= 2, r, np.nan)


OUT = "kind string, mmsi long, us long, field int, season int, amount double, until long, n long, moving long"


def _runs(value: np.ndarray, moving: np.ndarray, group: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of equal readings within blocks: first and last row, rows, rows under way, and
    whether they touch the block's first (1) or last (2) reading."""
    fresh = np.r_[True, group[1:] != group[:-1]]
    new = fresh | np.r_[True, value[1:] != value[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(value) - 1]
    touches = fresh[first] + 2 * np.r_[fresh[1:], True][last]
    return first, last, last - first + 1, np.add.reduceat(moving.astype(np.int64), first), touches


def assess(c: dict[str, np.ndarray], group: np.ndarray, stuck: int = 10) -> pa.Table:
    """Per block: counts of residuals per bin, residuals beyond the sensor's resolution, and
    runs of equal readings that are long enough or go on in the next block."""
    t = c["us"] / 1e6
    core = c["core"].astype(bool)
    speed, way, slow = movement(c, group)
    moving = speed > UNDER_WAY_KN
    parts: list[tuple] = []

    def add(kind: str, mmsi, us, f, season, amount, until=0, n=0, under=0) -> None:
        size = len(mmsi)
        parts.append((np.full(size, kind), mmsi, us, np.full(size, f), season, amount, *(np.broadcast_to(x, size) for x in (until, n, under))))

    for f, field in enumerate(FIELDS):
        raw = np.round(c[field], 3)
        valid = (raw >= RANGE[field][0]) & (raw <= RANGE[field][1]) & (raw != CODE[field])
        i = np.flatnonzero(valid)
        if not len(i):
            continue
        # a vessel that is just leaving or has just stopped is not under way on both sides
        r = residuals(raw[i], speed[i], way[i], group[i], t[i], field)
        season = np.where(moving[i] & (slow[i] > UNDER_WAY_KN), 1, 0)
        mine = core[i] & ~np.isnan(r)
        if field != "sog":
            mine &= season == 1
        k = i[mine]
        bins = np.searchsorted(EDGES[field], r[mine])
        keys, n = np.unique(np.stack([c["mmsi"][k].astype(np.int64), season[mine], bins]), axis=1, return_counts=True)
        add("bin", keys[0], keys[2], f, keys[1], n.astype(float))
        far = r[mine] > RESOLUTION[field]
        add("far", c["mmsi"][k][far], c["us"][k][far], f, season[mine][far], r[mine][far])
        own = np.flatnonzero(valid & core)
        if len(own):
            a, z, n, under, touches = _runs(raw[own], moving[own], group[own], t[own])
            keep = (touches > 0) | (under >= stuck)
            a, z = own[a[keep]], own[z[keep]]
            add("run", c["mmsi"][a], c["us"][a], f, touches[keep], raw[a], c["us"][z], n[keep], under[keep])
    names = [x.split()[0] for x in OUT.split(", ")]
    whole = [np.concatenate(x) for x in zip(*parts)] if parts else [np.array([])] * len(names)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(v.astype(object) if n == "kind" else v).cast(k) for n, v, k in zip(names, whole, kinds)})


def _tail(excess: np.ndarray, scale: np.ndarray, shape: float) -> np.ndarray:
    """Probability that a Pareto excess is at most each value: scales x values."""
    z = excess / scale[:, None]
    return 1 - np.exp(-z) if shape == 0 else 1 - np.maximum(1 + shape * z, 0) ** (-1 / shape)


def fit_tail(counts: np.ndarray, edges: np.ndarray, shape: float, *, risk: float, peaks: float, prior: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(cutoff, log likelihoods) per row of ``counts``, residuals counted by bin.

    The threshold is the bin edge that at most ``peaks`` of the residuals pass. Above it the
    likelihood of a Pareto tail mixed with uniform faults is taken over the grids of scale
    and share of faults, for all rows with one threshold at once. Scales are in thresholds,
    so that ``prior``, log likelihoods of the same grids, may come from other movers."""
    total = np.maximum(counts.sum(1), 1)
    at = np.minimum((np.cumsum(counts, 1) >= (1 - peaks) * total[:, None]).argmax(1), len(edges) - 2)
    cutoff, likely = np.zeros(len(counts)), np.zeros((len(counts), len(SCALES) * len(FAULTS)))
    for k in np.unique(at):
        rows, start = at == k, edges[k]
        excess = np.r_[edges[k:], 1.5 * edges[-1]] - start
        scale = SCALES * start
        normal, fault = np.diff(_tail(excess, scale, shape), axis=1), np.diff(excess) / excess[-1]
        mix = (1 - FAULTS)[None, :, None] * normal[:, None, :] + FAULTS[None, :, None] * fault
        over = counts[rows][:, k + 1 :]
        chance = over @ np.log(np.maximum(mix, 1e-300)).reshape(-1, mix.shape[-1]).T
        likely[rows] = chance
        best = (chance + (prior[rows] if isinstance(prior, np.ndarray) else prior)).argmax(1)
        s, e = scale[best // len(FAULTS)], FAULTS[best % len(FAULTS)]
        ratio = np.maximum(over.sum(1) * (1 - e) / total[rows] / risk, 1)
        cutoff[rows] = start + (s * np.log(ratio) if shape == 0 else s / shape * (ratio**shape - 1))
    return cutoff, likely


def cutoffs(bins: DataFrame, *, risk: float = 1e-6, peaks: float = 0.05, prior: float = 20.0) -> DataFrame:
    """(mmsi, field, season, cutoff) from residuals counted by bin (``us``).

    A mover's threshold takes in ``prior`` residuals of all movers, its scale and share of
    faults the likelihood of as many of their peaks."""
    size = len(EDGES["sog"]) + 1
    fit = partial(fit_tail, risk=risk, peaks=peaks)

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), size))
        for row, levels in enumerate(column.to_pylist()):
            for x in levels:
                out[row, x["us"]] += x["n"]
        return out

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, usual, likely = [], [], []
            for row, f in zip(dense(batch.column(2)), batch.column(0).to_pylist()):
                grids = {x: fit(row[None], EDGES[FIELDS[f]], x)[1][0] for x in SHAPES}
                out.append(max(SHAPES, key=lambda x: grids[x].max()))
                usual.append((row / max(row.sum(), 1)).tolist())
                likely.append((grids[out[-1]] / max(peaks * row.sum(), 1)).tolist())
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64()), pa.array(usual, many), pa.array(likely, many)], names=["field", "season", "shape", "usual", "likely"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field, shape = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            usual, likely = (np.array(batch.column(k).to_pylist()).reshape(batch.num_rows, -1) for k in (5, 6))
            counts = dense(batch.column(3)) + prior * usual
            cutoff = np.zeros(len(counts))
            for f, x in {*zip(field.tolist(), shape.tolist())}:
                rows = (field == f) & (shape == x)
                cutoff[rows] = fit(counts[rows], EDGES[FIELDS[f]], x, prior=prior * likely[rows])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cutoff)], names=["mmsi", "field", "season", "cutoff"])

    levels = F.collect_list(F.struct("us", "n")).alias("levels")  # one entry per bin
    counted = bins.groupBy("mmsi", "field", "season", "us").agg(F.sum("amount").alias("n"))
    fleet = counted.groupBy("field", "season", "us").agg(F.sum("n").alias("n")).groupBy("field", "season").agg(levels)
    fleet = fleet.mapInArrow(shapes, "field int, season int, shape double, usual array<double>, likely array<double>")  # six rows at most
    mine = counted.groupBy("mmsi", "field", "season").agg(levels).join(F.broadcast(fleet), ["field", "season"])
    return mine.select("mmsi", "field", "season", "levels", "shape", "usual", "likely").mapInArrow(own, "mmsi long, field int, season int, cutoff double")


def whole_runs(runs: DataFrame, *, stuck: int = 10) -> DataFrame:
    """(mmsi, field, value, since, until) of runs with ``stuck`` readings under way, of which
    at least four fifths are; parts of neighbouring blocks are summed first."""
    closed = runs.where("season = 0").select("mmsi", "field", F.col("amount").alias("value"), F.col("us").alias("since"), "until", "n", "moving")
    order = Window.partitionBy("mmsi", "field").orderBy("us", "until")  # at most two rows per block of time
    goes_on = (F.lag("amount").over(order) == F.col("amount")) & (F.lag("season").over(order).bitwiseAND(2) > 0) & (F.col("season").bitwiseAND(1) > 0)
    parts = runs.where("season > 0").withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    joined = parts.groupBy("mmsi", "field", "run").agg(
        F.first("amount").alias("value"), F.min("us").alias("since"), F.max("until").alias("until"), F.sum("n").alias("n"), F.sum("moving").alias("moving")
    )
    both = closed.unionByName(joined.drop("run")).where((F.col("moving") >= stuck) & (F.col("moving") >= 0.8 * F.col("n")))
    return both.select("mmsi", "field", "value", "since", "until")


def out_of_range(positions: DataFrame) -> DataFrame:
    """(position_id, field) of readings outside their range; codes are no cases."""
    tests = []
    for field in FIELDS:
        v = F.round(F.col(field).cast("double"), 3)
        bad = (v < RANGE[field][0]) | ((v > RANGE[field][1]) & (v != CODE[field]))
        tests.append(F.when(bad & ~F.isnan(v), F.lit(field)))
    return positions.select("position_id", F.explode(F.array_compact(F.array(*tests))).alias("field"))


def bad_readings(positions: DataFrame, *, risk: float = 1e-6, stuck: int = 10) -> DataFrame:
    """(position_id, field) of every bad reading, all delivered copies included."""
    us = F.unix_micros("reported_at").alias("us")
    possible = F.expr("abs(lat) <= 90 and abs(lon) <= 180")
    place = [F.when(possible, F.col(c)).cast("double").alias(c) for c in ("lon", "lat")]
    values = [F.col(f).cast("double").alias(f) for f in FIELDS]
    fixes = positions.select("mmsi", us, *place, *values).where("mmsi is not null and us is not null")
    found = cut(map_blocks(in_blocks(fixes, block_s=BLOCK_S, halo_s=HALO_S), partial(assess, stuck=stuck), OUT))
    # salted: a mover with a third of all rows has as many residuals
    salt = F.pmod(F.xxhash64("us"), F.lit(SALTS))
    limits = cutoffs(found.where("kind = 'bin'"), risk=risk).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    far = found.where("kind = 'far'").withColumn("salt", salt).join(limits, ["mmsi", "field", "season", "salt"]).where("amount > cutoff")
    none = F.lit(None).cast("double").alias("value")
    judged = far.select("mmsi", "field", none, F.col("us").alias("since"), F.col("us").alias("until")).unionByName(whole_runs(found.where("kind = 'run'"), stuck=stuck))
    hour = lambda c: F.expr(f"({c} - pmod({c}, {HOUR_US}L)) div {HOUR_US}L")
    judged = judged.distinct().withColumn("hour", F.explode(F.sequence(hour("since"), hour("until"))))
    rows = positions.select("position_id", "mmsi", us, *values).withColumn("hour", hour("us"))
    read = F.element_at(F.array(*[F.round(F.col(f), 3) for f in FIELDS]), F.col("field") + 1)
    met = rows.join(judged, ["mmsi", "hour"]).where(F.col("us").between(F.col("since"), F.col("until")) & F.coalesce(read == F.col("value"), F.col("value").isNull()))
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1)
    return out_of_range(positions).unionByName(met.select("position_id", name.alias("field"))).distinct()
