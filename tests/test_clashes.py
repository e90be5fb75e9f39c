"""Inputs with more columns than asked for, named like the library's own working columns."""

from pyspark.sql import functions as F

from tests.conftest import AS_OF, got
from tests.test_messages import payload, raw
from tests.test_analytics import ports
from wakeline.operators import containment, feeds, ingest, late_counts, message_store, profile, proximity, spikes, stops, visits

EXTRA = "row col cell slot home us block core kind field season amount level salt interior edges region_id port_id run key_hi key_lo hour version late n lo hi at by size cx cy start_at stop base fingerprint turn root text ids g p grams".split()


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA if c not in df.columns])


def same(f, *dfs):
    assert got(f(*map(wide, dfs))) == got(f(*dfs))


def test_positions(spark, fixes, square):
    p = fixes([(m, ago, 0.001 + m * 1e-4, 0.001, 0.5, 10.0, 20) for m in (1, 2) for ago in range(300, -1, -5)] + [(1, 400, 3.0, 3.0, 200.0, 10.0, 20)])
    q = ports(spark, [(1, 0, 0)])
    fences = spark.createDataFrame([(1, square(-0.5, -0.5, 0.5, 0.5), True)], "id int, polygon string, active boolean")
    same(spikes.bad_readings, p)
    same(lambda x: stops.stops_and_trips(x)[0], p)
    same(proximity.near_pairs, p)
    same(containment.positions_in_regions, p, fences)
    same(lambda a, b: visits.port_calls(a, b, as_of=AS_OF, lookback=None), p, q)
    same(lambda a, b: visits.geofence_crossings(a, b, as_of=AS_OF, lookback=None), p, fences)
    same(lambda a, b: visits.sts_events(a, b, as_of=AS_OF, lookback=None), p, q.limit(0))
    same(lambda a: visits.position_gaps(a, as_of=AS_OF), p)
    same(ingest.last_positions, p)
    same(lambda a: profile.voyage_hourly(a), p)
    subs = spark.createDataFrame([("s", -1.0, -1.0, 1.0, 1.0)], "subscriber string, lon1 double, lat1 double, lon2 double, lat2 double")
    same(lambda a, b: feeds.live_feed(a, b).select("subscriber", "position_id"), p, subs)


def test_messages(spark, at):
    m = raw(spark, at, [(i, "s", 1, 7, payload({"MessageID": 1, "x": i // 2, "UserID": 7})) for i in range(6)])
    same(message_store.further_copies, m)
    same(lambda x: late_counts.counts(late_counts.cells(x)), m)
    decoded = ingest.decode_messages(m.drop("message_type", "mmsi", "reported_at"), keep=["id", "source", "received_at"])
    same(lambda x: ingest.dedup_messages(x).select("id", "is_duplicate"), decoded)
