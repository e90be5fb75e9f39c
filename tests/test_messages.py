import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import got
from wakeline.operators import ingest, late_counts, message_store

RAW = "id long, source string, message_type short, mmsi long, received_at timestamp, reported_at timestamp, payload string, is_duplicate boolean"


def payload(body, time="2024-06-01 10:00:00.5 +0000 UTC", kind="PositionReport", **meta):
    return json.dumps({"MessageType": kind, "MetaData": {"time_utc": time, **meta}, "Message": {kind: body}})


def raw(spark, at, rows):
    return spark.createDataFrame([(i, s, t, m, at(60), None, p, False) for i, s, t, m, p in rows], RAW)


def test_copies_agree_whatever_the_spelling(spark, at):
    rows = [
        (1, "a", 1, 7, '{"MessageType":"P","MetaData":{"time_utc":"2024-06-01 10:00:00.5 +0000 UTC"},"Message":{"P":{"x":5.0,"y":15e-1,"d":{"a":1,"b":[1,2.50]}}}}'),
        (2, "b", 1, 7, '{"Message": {"P": {"d": {"b": [1, 2.5], "a": 1}, "y": 1.5, "x": 5}}, "MessageType": "P", "MetaData": {"ShipName": "  Z ", "time_utc": "2024-06-01T10:00:00.500000000Z"}}'),
        (3, "a", 1, 8, '{"MessageType":"P","MetaData":{"time_utc":"2024-06-01 10:00:00.5 +0000 UTC"},"Message":{"P":{"x":5.0,"y":1.5,"d":{"a":1,"b":[1,2.50]}}}}'),
        (4, "a", 1, 7, '{"MessageType":"P","MetaData":{"time_utc":"2024-06-01 10:00:01 +0000 UTC"},"Message":{"P":{"x":5,"y":1.5,"d":{"a":1,"b":[1,2.5]}}}}'),
        (5, "a", 1, 7, '{"MessageType":"P","MetaData":{"time_utc":"2024-06-01 11:00:00.5 +0100 CET"},"Message":{"P":{"x":5,"y":1.5,"d":{"a":1,"b":[1,2.5]}}}}'),
        (6, "a", 1, 7, '{"MessageType":"P","MetaData":{"time_utc":"n/a"},"Message":{"P":{"x":1}}}'),
        (7, "c", 1, 7, '{"MessageType":"P","MetaData":{},"Message":{"P":{"x":1.00}}}'),
        (8, None, None, None, None),
        (9, "z", None, None, None),
        (10, "a", 1, 7, "no envelope"),
    ]
    assert got(message_store.further_copies(raw(spark, at, rows))) == [(2,), (5,), (7,), (9,)]
    assert len(got(message_store.deduplicated(raw(spark, at, rows)))) == 6


def test_store_is_idempotent(spark, at):
    a = raw(spark, at, [(5, "a", 1, 7, payload({"x": 1})), (6, "a", 1, 7, payload({"x": 2}))])
    b = raw(spark, at, [(1, "b", 1, 7, payload({"x": 1})), (9, "b", 1, 7, payload({"x": 3}))])
    store = message_store.MessageStore(spark, buckets=3)
    for run, batch in ((1, a), (2, b), (1, a), (2, b)):
        store.upsert(message_store.identified(batch, F.lit(run)))
    assert got(store.compact().select("id")) == [(1,), (6,), (9,)]
    assert "Exchange" not in store.spark.table(store.name).groupBy(*message_store.KEY).agg({"id": "min"})._jdf.queryExecution().executedPlan().toString()
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]


def test_no_messages(spark, at):
    assert got(message_store.further_copies(raw(spark, at, []))) == []


def test_late_rows_amend_until_the_cutoff(spark, at):
    day = "2024-06-01 "
    rows = [
        (1, "a", 7, day + "10:10:00", day + "10:11:00"),
        (2, "a", 7, day + "10:20:00", day + "11:04:59.999999"),  # before publication
        (3, "b", 7, day + "10:30:00", day + "11:05:00"),  # amends
        (4, "b", 7, day + "10:30:00", day + "17:00:00"),  # too late
        (5, "b", 8, None, day + "10:59:00"),  # timed by receipt
        (6, "b", 9, day + "10:00:00", day + "16:59:59"),  # amends from nothing
        (7, "b", None, day + "10:00:00", day + "16:59:59"),
        (8, "b", 9, day + "10:00:00", None),
    ]
    df = spark.createDataFrame(rows, "id long, source string, mmsi long, reported_at string, received_at string").selectExpr(
        "id", "source", "mmsi", "cast(reported_at as timestamp) reported_at", "cast(received_at as timestamp) received_at"
    )
    state = late_counts.cells(df)
    hour = 1717236000
    assert got(late_counts.amended(state)) == [(7, hour), (9, hour)]
    assert got(late_counts.counts(state).where("mmsi = 7")) == [(7, hour, 2, 3)]
    again = late_counts.merge(state, late_counts.merge(state, state.where("mmsi = 7")))
    assert got(late_counts.counts(again)) == got(late_counts.counts(state))


def test_batches_of_neighbouring_ids_add_up(spark):
    rows = [(i, "a", 7, "2024-06-01 10:10:00", f"2024-06-01 {'11:30' if i <= 5 else '10:20'}:00") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, source string, mmsi long, reported_at string, received_at string").selectExpr(
        "id", "source", "mmsi", "cast(reported_at as timestamp) reported_at", "cast(received_at as timestamp) received_at"
    )
    a, b, c = (late_counts.cells(df.where(w), batch=k) for k, w in enumerate(("id <= 3", "id in (4, 5, 6)", "id > 6")))
    want = [(7, 1717236000, 3, 8)]
    assert got(late_counts.counts(late_counts.cells(df))) == want
    for states in ((a, b, c), (c, a, b), (a, b, a, c, b)):  # replays too
        assert got(late_counts.counts(late_counts.merge(*states))) == want
    assert got(late_counts.counts(late_counts.merge(late_counts.merge(a, b), late_counts.merge(b, c)))) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_hold_for_any_split_replay_and_order(spark, seed):
    """A grow-only state: random disjoint batches, replayed and merged in any order and grouping."""
    rng = random.Random(seed)
    at = lambda m: datetime(2024, 6, 1, 8, tzinfo=timezone.utc) + timedelta(minutes=m)
    rows = [(i, rng.choice("ab"), rng.choice([7, 7, 7, 8, 9]), at(m := rng.uniform(0, 300)), at(m + rng.choice([0.1, 1, 40, 200, 600]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, source string, mmsi long, reported_at timestamp, received_at timestamp")
    want = got(late_counts.counts(late_counts.cells(df)))
    of = {i: rng.randrange(4) for i in range(300)}
    states = [late_counts.cells(df.where(F.col("id").isin([i for i, b in of.items() if b == k])), batch=k).persist() for k in range(4)]
    order = [0, 1, 2, 3] + [rng.randrange(4) for _ in range(2)]
    rng.shuffle(order)
    held = states[order[0]]
    for k in order[1:]:
        held = late_counts.merge(held, states[k])
    assert got(late_counts.counts(held)) == want
    assert got(late_counts.counts(late_counts.merge(late_counts.merge(states[3], states[1]), late_counts.merge(states[0], states[1], states[2])))) == want


def test_decoding(spark, at):
    rows = [
        (1, "s", 0, 0, payload({"MessageID": 1, "UserID": 222, "Latitude": 1.29, "Longitude": 103.85, "TrueHeading": 511}, MMSI=636, ShipName=" TEST ")),
        (2, "s", 0, 0, payload({"MessageID": 5, "UserID": 222}, kind="ShipStaticData")),
        (3, "s", 0, 0, "{broken"),
        (4, "s", 0, 0, payload({"MessageID": 1, "UserID": 5, "Latitude": 1.0, "TrueHeading": 99999999}, time="never")),
        (5, "s", 0, 0, None),
    ]
    out = {r.id: r for r in ingest.decode_messages(raw(spark, at, rows).select("id", "payload"), keep=["id"]).collect()}
    assert set(out) == {1, 2, 4}
    assert (out[1].mmsi, out[1].name, out[1].has_position, out[1].lat, out[1].heading) == (636, "TEST", True, 1.29, 511)
    assert (out[2].mmsi, out[2].has_position, out[2].message_type) == (222, False, 5)
    assert (out[4].has_reported, out[4].has_position, out[4].lat) == (False, False, None)


def test_duplicates_within_the_window(spark, at):
    rows = [(1, 7, 20.0), (2, 7, 16.0), (3, 7, 11.0), (4, 7, 5.0), (5, 8, 16.0), (6, 7, 5.0)]
    df = spark.createDataFrame([(i, m, 1, None, None, None, at(ago)) for i, m, ago in rows], "id long, mmsi long, message_type int, reported_at timestamp, lon double, lat double, received_at timestamp")
    flags = {r.id: r.is_duplicate for r in ingest.dedup_messages(df).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}  # 2 does not prolong what 1 opened
    seen = df.where("id = 1").select(ingest.fingerprint(df).alias("fingerprint"), df.received_at.alias("first_seen"))
    flags = {r.id: r.is_duplicate for r in ingest.dedup_messages(df.where("id in (2, 5)"), seen).collect()}
    assert flags == {2: True, 5: False}


def test_last_positions_and_vessels(spark, at, fixes):
    p = fixes([(100, 1, 103.0, 1.0, 1.0), (100, 0, 104.0, 2.0, 2.0), (200, 0, 120.0, 5.0, None), (200, 0, 121.0, 5.0, None), (None, 0, 1.0, 1.0, 1.0), (300, None, 1.0, 1.0, 1.0)])
    last = ingest.last_positions(p)
    assert [(r.mmsi, r.lon) for r in last.orderBy("mmsi").collect()] == [(100, 104.0), (200, 121.0)]
    assert got(ingest.last_positions(p, last)) == got(last)
    old = spark.createDataFrame([(100, "ALPHA", at(99), at(98))], "mmsi long, name string, first_seen_at timestamp, last_seen_at timestamp")
    batch = spark.createDataFrame([(1, 100, "", at(5)), (2, 200, "BETA", at(4)), (3, 200, "", at(3))], "id long, mmsi long, name string, received_at timestamp")
    out = [(r.mmsi, r.name, r.is_new) for r in ingest.upsert_vessels(old, batch).orderBy("mmsi").collect()]
    assert out == [(100, "ALPHA", False), (200, "BETA", True)]


def test_enrichment(spark, at):
    vessels = spark.createDataFrame([(100, None, "OLD", "EVER", 0, 5, 6, "{}"), (300, 1, "X", "Y", 1, 2, 3, "{}")], "mmsi long, imo long, call_sign string, name string, ship_type int, length_m int, beam_m int, metadata string")
    body = {"MessageID": 5, "ImoNumber": 9811000, "CallSign": "", "Name": "EVER GIVEN", "Type": 70, "Dimension": {"A": 200, "B": 100, "C": 25, "D": 25}, "Destination": "ROTTERDAM"}
    rows = raw(spark, at, [(1, "s", 5, 100, payload(body, kind="ShipStaticData")), (2, "s", 5, 300, payload("not-an-object", kind="ShipStaticData"))])
    out = {r.mmsi: r for r in ingest.enrich_vessels(vessels, rows, as_of="2024-06-01 12:00:00").collect()}
    r = out[100]
    assert (r.imo, r.call_sign, r.name, r.ship_type, r.length_m, r.beam_m, r.destination) == (9811000, "OLD", "EVER GIVEN", 70, 300, 50, "ROTTERDAM")
    assert out[300].destination is None and out[300].name == "Y"
