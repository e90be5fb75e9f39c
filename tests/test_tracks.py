import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import POSITIONS, got
from wakeline.operators import spikes, stops
from wakeline.operators.timeline import latest, runs, with_previous

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def frame(spark, rows):
    return spark.createDataFrame([(i + 1, m, START + timedelta(seconds=t), START, "s", lon, lat, sog, cog, head, None, None) for i, (m, t, lon, lat, sog, cog, head) in enumerate(rows)], POSITIONS)


def voyage(m=1, hours=30, step=180, seed=0):
    """Due east at 10 knots with sensor noise."""
    rng = random.Random(seed)
    v = 10 * 0.514444 / 111_194.9
    return [(m, k * step, v * k * step, 0.0, 10 + rng.gauss(0, 0.3), 90 + rng.gauss(0, 3), int(90 + rng.gauss(0, 2))) for k in range(hours * 3600 // step)]


def test_spikes_are_named_with_their_field(spark):
    rows = voyage()
    at = lambda k, **f: rows.__setitem__(k, (*rows[k][:4], f.get("sog", rows[k][4]), f.get("cog", rows[k][5]), f.get("heading", rows[k][6])))
    at(50, sog=35.0), at(80, cog=250.0), at(81, cog=255.0), at(120, heading=270), at(200, sog=-3.0), at(201, cog=400.0), at(202, heading=400)
    at(210, sog=102.3), at(211, cog=360.0), at(212, heading=511), at(213, sog=None), at(214, cog=None), at(215, heading=None)
    for k in range(300, 312):
        at(k, sog=9.9)
    rows[400] = (*rows[400][:2], rows[400][2] + 0.5, 0.3, *rows[400][4:])  # a stray fix, its readings are right
    rows.append(rows[50])  # a second delivery
    found = got(spikes.bad_readings(frame(spark, rows)))
    want = {(51, "sog"), (len(rows), "sog"), (81, "cog"), (82, "cog"), (121, "heading"), (201, "sog"), (202, "cog"), (203, "heading")} | {(k + 1, "sog") for k in range(300, 312)}
    assert set(found) == want and len(found) == len(want)


def test_impossible_positions_leave_their_readings_to_be_judged(spark):
    rows = voyage()
    lost = {50: (181.0, 91.0), 105: (181.0, 91.0), 106: (None, None), 200: (0.0, 91.0), 201: (181.0, 0.0), 300: (float("nan"), 0.0), len(rows) - 1: (181.0, 91.0)}
    for k in range(100, 110):  # a run of exactly ten
        rows[k] = (*rows[k][:6], 97)
    rows[50] = (*rows[50][:4], 35.0, *rows[50][5:])
    rows[200] = (*rows[200][:5], 250.0, rows[200][6])
    rows[len(rows) - 1] = (*rows[-1][:6], 270)
    for k, (lon, lat) in lost.items():
        rows[k] = (*rows[k][:2], lon, lat, *rows[k][4:])
    want = {(51, "sog"), (201, "cog"), (len(rows), "heading")} | {(k + 1, "heading") for k in range(100, 110)}
    assert set(got(spikes.bad_readings(frame(spark, rows)))) == want
    nowhere = [(*r[:2], None, None, *r[4:]) for r in voyage()]
    assert got(spikes.bad_readings(frame(spark, nowhere))) == []


def test_still_vessels_may_turn(spark):
    rng = random.Random(1)
    rows = [(1, k * 180, rng.gauss(0, 5e-5), rng.gauss(0, 5e-5), abs(rng.gauss(0, 0.1)), rng.uniform(0, 359), 40) for k in range(300)]
    rows[100] = (*rows[100][:4], 25.0, 10.0, 200)
    assert got(spikes.bad_readings(frame(spark, rows))) == [(101, "sog")]


def noisy(m, sd, seed):
    return [(m, t, x, y, max(10 + random.Random(seed * 10_000 + i).gauss(0, sd), 0.0), cog, None) for i, (_, t, x, y, _, cog, _) in enumerate(voyage(m, hours=60))]


def test_cutoffs_are_each_movers_own(spark):
    """A reading that is normal for one mover is a spike for another: no constant names both right."""
    quiet, wild = noisy(1, 0.1, 3), noisy(2, 2.5, 4)
    rows = quiet + wild
    for at in (300, len(quiet) + 300):
        rows[at] = (*rows[at][:4], 17.0, *rows[at][5:])
    assert got(spikes.bad_readings(frame(spark, rows))) == [(301, "sog")]


def test_the_fit_finds_the_level_of_a_risk_in_spite_of_faults():
    rng = np.random.default_rng(1)
    edges = spikes.EDGES["sog"]
    normal = rng.exponential(0.5, 200_000)
    for faults in (0, 800):
        r = np.r_[normal, rng.uniform(5, 60, faults)]
        counts = np.bincount(np.searchsorted(edges, r), minlength=len(edges) + 1)[None].astype(float)
        cutoff, _ = spikes.fit_tail(counts, edges, 0.0, risk=1e-6, peaks=0.05)
        assert abs(cutoff[0] / (0.5 * np.log(1e6)) - 1) < 0.15


@pytest.mark.parametrize("minutes", [10, 25, 40, 60, 240])
def test_stuck_runs_cross_the_borders_of_blocks(spark, minutes):
    size = spikes.BLOCK_S
    offset = size - int(START.timestamp()) % size  # the border after the start
    rows = voyage(hours=200, step=minutes * 60)
    border = next(k for k, r in enumerate(rows) if r[1] >= offset)
    for first in (border - 6, border + 30):
        stuck = [(*r[:6], 97) if first <= k < first + 12 else r for k, r in enumerate(rows)]
        assert {i for i, f in got(spikes.bad_readings(frame(spark, stuck))) if f == "heading"} == {k + 1 for k in range(first, first + 12)}
        short = [(*r[:6], 97) if first <= k < first + 9 else r for k, r in enumerate(rows)]
        assert not [i for i, f in got(spikes.bad_readings(frame(spark, short))) if f == "heading"]


def test_spikes_of_nothing_and_nulls(spark):
    assert got(spikes.bad_readings(frame(spark, []))) == []
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, -1.0, None, None, None, None), (2, 5, None, None, None, 1.0, 1.0, None, 500.0, None, None, None)], POSITIONS)
    assert got(spikes.bad_readings(rows)) == [(1, "sog"), (2, "cog")]


def track(m, legs, step=180):
    """(seconds, lon, lat) moves: stays and straight ways."""
    rows, t, rng = [], 0.0, random.Random(m)
    for kind, seconds, x0, x1 in legs:
        for k in range(int(seconds // step)):
            x = x0 + (x1 - x0) * k * step / seconds
            jitter = (rng.gauss(0, 2e-4), rng.gauss(0, 2e-4)) if kind == "stay" else (0.0, 0.0)
            rows.append((m, t, float(x + jitter[0]), float(jitter[1]), 0.0 if kind == "stay" else 10.0, 90.0, 90))
            t += step
        t += step
    return rows


def test_stops_and_trips(spark):
    rows = track(1, [("stay", 4 * 3600, 0, 0), ("go", 6 * 3600, 0, 1), ("stay", 3000, 1, 1), ("go", 3600, 1, 1.2), ("stay", 70 * 3600, 1.2, 1.2)])
    rows[20] = (1, rows[20][1], 5.0, 5.0, 0.0, 0.0, 0)  # a stray fix within a stop
    rows = [r for i, r in enumerate(rows) if not 400 < i < 700]  # a silence; the vessel is still there after it
    rows += [rows[3], rows[3]]
    found, trips = stops.stops_and_trips(frame(spark, rows))
    out = found.orderBy("start_us").collect()
    assert [(round(r.lon, 2), round(r.lat, 2)) for r in out] == [(0, 0), (1.2, 0)]
    assert out[0].duration_s > 3.9 * 3600 and out[1].duration_s > 69 * 3600
    (trip,) = trips.collect()
    assert abs(trip.distance_m - 1.2 * 111_194.9) < 3000 and trip.start_us == out[0].end_us and trip.end_us == out[1].start_us


def test_stops_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for m in range(1, 5):
        x, legs = 0.0, []
        for _ in range(8):
            legs.append(("stay", rng.randrange(1800, 40_000), x, x))
            legs.append(("go", rng.randrange(7200, 30_000), x, x + 1))
            x += 1
        rows += track(m, legs, rng.choice([120, 300, 700]))
    whole = got(stops.stops_and_trips(frame(spark, rows))[0].select("mmsi", "start_us", "end_us"))
    monkeypatch.setattr(stops, "BLOCK_S", 21_600)
    assert got(stops.stops_and_trips(frame(spark, rows))[0].select("mmsi", "start_us", "end_us")) == whole
    assert len(whole) > 15


def test_strays_at_borders_of_blocks_do_not_end_a_stop(spark):
    start = int(START.timestamp())
    for silence in (False, True):  # without and with a silence over a border
        rows = track(1, [("stay", 10 * 86_400, 0, 0)])
        border = next(k for k in range(len(rows)) if (start + k * 180) % stops.BLOCK_S == 0) + 960
        halo = stops.HALO_S // 180
        far = [border - halo, border + halo - 1, border + 960 - halo, border + 1920 + halo - 1]
        gone = (border - 200, border + 60) if silence else (0, 0)
        far = [gone[1]] if silence else far
        for k in far:
            rows[k] = (*rows[k][:2], 3.0, 3.0, *rows[k][4:])
        kept = [r for k, r in enumerate(rows) if not gone[0] < k < gone[1]]
        found, trips = stops.stops_and_trips(frame(spark, kept))
        (stop,) = found.collect()
        assert stop.duration_s == rows[-1][1] and trips.count() == 0


def test_core_fixes_equal_brute_force():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([20, 200, 900, 7000], 400).astype(float))
    group = np.repeat([1, 2], 200)
    x, y = np.cumsum(rng.choice([0, 0.004, 0.004, 0.004], 400)), rng.normal(0, 5e-4, 400)
    dense, clock = stops.core_fixes(x, y, group, t, 500.0, 2400.0, 1200.0, 1800.0)
    for i in range(400):
        stay = 0.0
        for j in range(399):
            ends = [k for k in (j, j + 1) if group[k] == group[i] and abs(clock[k] - clock[i]) <= 2400 and stops._metres(x[k], y[k], x[i], y[i]) <= 500]
            stay += min(t[j + 1] - t[j], 1800) if len(ends) == 2 else 0
        assert dense[i] == (stay >= 1200), i
    assert 20 < dense.sum() < 390


def test_no_cluster_no_stop(spark, monkeypatch):
    """Stops come from core fixes: without them none is found."""
    rows = track(1, [("stay", 9 * 3600, 0, 0), ("go", 6 * 3600, 0, 1), ("stay", 9 * 3600, 1, 1), ("go", 6 * 3600, 1, 2)])
    assert stops.stops_and_trips(frame(spark, rows))[0].count() == 2
    c = {k: np.array([r[i] for r in rows], float) for k, i in (("lon", 2), ("lat", 3))} | {"us": np.array([int(r[1] * 1e6) for r in rows]), "core": np.ones(len(rows)), "mmsi": np.ones(len(rows), int), "block": np.zeros(len(rows), int)}
    group = np.zeros(len(rows), int)
    long = lambda out: sum(k == "part" and z - a > 3.6e9 for k, a, z in zip(*(out.column(n).to_pylist() for n in ("kind", "start_us", "end_us"))))
    assert long(stops.cluster(c, group)) == 2 and long(stops.cluster(c, group, least_stay_s=1e9)) == 1  # what touches the border


def test_no_stops(spark):
    found, trips = stops.stops_and_trips(frame(spark, []))
    assert got(found) == [] and got(trips) == []
    assert got(stops.stops_and_trips(frame(spark, voyage(hours=5)))[0]) == []


def events(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4) if i % 9 else 0, START + timedelta(seconds=rng.randrange(400_000)), i, rng.choice([1, 1, 2, None]), rng.random()) for i in range(600)]
    return spark.createDataFrame([*rows, (None, START, 900, 1, 0.0), (1, None, 901, 1, 0.0)], "k long, t timestamp, tie long, v int, x double")


def test_previous_row_equals_lag(spark):
    df = events(spark)
    w = Window.partitionBy("k").orderBy("t", "tie")
    want = df.where("k is not null and t is not null").withColumns({"pt": F.lag("t").over(w), "pv": F.lag("v").over(w)})
    for size in (3600, 86_400, 10_000_000):
        out = with_previous(df, "k", "t", "tie", {"pt": "t", "pv": "v"}, size)
        assert got(out.select("tie", "pt", "pv")) == got(want.select("tie", "pt", "pv"))


def test_runs_equal_two_row_numbers(spark):
    df = events(spark).where("k is not null and t is not null")
    a, b = Window.partitionBy("k").orderBy("t", "tie"), Window.partitionBy("k", "v").orderBy("t", "tie")
    g = df.withColumn("g", F.row_number().over(a) - F.row_number().over(b)).groupBy("k", "v", "g").agg(F.min("t"), F.max("t"), F.count("*"), F.min("x")).drop("g")
    for size in (3600, 86_400):
        out = runs(df, "k", "t", "tie", "v", {"x": F.min("x")}, size)
        assert got(out.select("k", "v", "first_at", "last_at", "count", "x")) == got(g)


def test_latest_takes_the_last_of_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], "k int, t int, v string")
    assert got(latest(df, ["k"], ["t", "v"])) == [(1, 5, "b"), (2, 1, None)]
