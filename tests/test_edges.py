"""Feeds, loaders, streams, and the shape of plans."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import AS_OF, got
from wakeline.operators import containment, feeds
from wakeline.sources import loaders
from wakeline.streaming import ingest as stream


def test_pages():
    assert [feeds.page(x, 50) for x in (None, 10, "7", "x", 0, -3, 9999)] == [50, 10, 7, 50, 50, 50, 500]


def test_live_feed(spark):
    subs = spark.createDataFrame([("west", -10.0, -10.0, 0.0, 10.0), ("east", 10.0, 10.0, -1.0, -10.0), ("all", -180.0, -90.0, 180.0, 90.0)], "subscriber string, lon1 double, lat1 double, lon2 double, lat2 double")
    f = spark.createDataFrame([(1, -5.0, 0.0), (2, 5.0, 0.0), (3, -0.5, 0.0), (4, 0.0, 10.0), (5, None, 1.0)], "position_id long, lon double, lat double")
    out = got(feeds.live_feed(f, subs).select("subscriber", "position_id").where("subscriber <> 'all'"))
    assert out == [("east", 2), ("east", 3), ("east", 4), ("west", 1), ("west", 3), ("west", 4)]
    assert feeds.live_feed(f, subs).where("subscriber = 'all'").count() == 4


def test_routing_and_delivery(spark):
    events = spark.createDataFrame([("gap", 100, "a"), ("gap", 200, "b"), ("sts", None, "c")], "channel string, mmsi long, payload string")
    subs = spark.createDataFrame([("all", [], []), ("one", [], [100]), ("bad", ["gap"], [])], "adapter string, channels array<string>, mmsis array<long>")
    routed = feeds.route_alerts(events, subs)
    assert got(routed.select("adapter", "payload")) == [("all", "a"), ("all", "b"), ("all", "c"), ("bad", "a"), ("bad", "b"), ("one", "a")]

    def send(row):
        if row["adapter"] == "bad":
            raise RuntimeError("down")

    dead = stream.deliver(routed, send, pause_s=0.0)
    assert got(dead.select("adapter", "payload", "error")) == [("bad", "a", "down"), ("bad", "b", "down")]


def test_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "id long, v string")
    out = [(r.action, json.loads(r.data)) for r in feeds.change_feed(a, b, ["id"], table="t").collect()]
    assert sorted(out, key=str) == [("D", {"id": 3, "v": "z"}), ("I", {"id": 4, "v": None}), ("U", {"id": 2, "v": "y"})]
    log = spark.createDataFrame([('{"action":"B"}',), ('{"action":"I","schema":"public","table":"geofence_events","columns":[{"name":"id","value":"7"},{"name":"mmsi","value":"636"}]}',), ('{"action":"I","schema":"public","table":"other","columns":[]}',), ("broken",), (None,)], "value string")
    (r,) = feeds.decode_changes(log, ["geofence_events"]).collect()
    assert (r.action, r.table, r.data) == ("I", "geofence_events", {"id": "7", "mmsi": "636"})


def test_alert_feed(spark, at):
    g = spark.createDataFrame([(1, 5, "enter", at(10))], "geofence_id int, mmsi long, event_type string, occurred_at timestamp")
    gaps = spark.createDataFrame([(5, at(600), 10, None), (6, at(9000), 10, at(1))], "mmsi long, last_position timestamp, gap_hours int, resolved_at timestamp")
    sts = spark.createDataFrame([(1, 2, at(30), 100.0)], "mmsi_a long, mmsi_b long, started_at timestamp, min_distance float")
    s = spark.createDataFrame([(9, "OFAC", "1", at(5))], "mmsi long, program string, reference string, matched_at timestamp")
    out = [(r.type, r.mmsi) for r in feeds.alerts(g, gaps, sts, s, since="2024-05-31 12:00:00").collect()]
    assert out == [("sanctions", 9), ("geofence", 5), ("sts", 1), ("gap", 5)]
    assert [r.type for r in feeds.alerts(g, gaps, sts, s, since="2024-05-31 12:00:00", type="gap").collect()] == ["gap"]
    with pytest.raises(ValueError):
        feeds.alerts(g, gaps, sts, s, since=AS_OF, type="nothing")
    assert [r.mmsi for r in feeds.gap_feed(gaps, since="2024-01-01 00:00:00", resolved=True).collect()] == [6]
    assert [r.mmsi for r in feeds.gap_feed(gaps, since="2024-01-01 00:00:00", resolved=False).collect()] == [5]
    assert [r.mmsi for r in feeds.gap_feed(gaps, since="2024-01-01 00:00:00").collect()] == [5, 6]
    assert feeds.sts_feed(sts, since="2024-01-01 00:00:00").count() == 1


def test_fences(spark, square):
    g = spark.createDataFrame([(7, "a", None, square(0, 0, 1, 1), None, True)], "id int, name string, description string, polygon string, created_at timestamp, active boolean")
    out = feeds.create_geofence(g, "b", square(0, 0, 2, 2), created_at=AS_OF)
    assert [(r.id, r.name) for r in feeds.list_geofences(out).collect()] == [(7, "a"), (8, "b")]
    for bad in ("", "{}", '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,1],[2,2],[3,3]]]}', '{"type":"Polygon","coordinates":[[[0,0],[999,1],[2,2],[0,0]]]}'):
        with pytest.raises(ValueError):
            feeds.create_geofence(g, "b", bad, created_at=AS_OF)
    with pytest.raises(ValueError):
        feeds.create_geofence(g, "", square(0, 0, 2, 2), created_at=AS_OF)


def test_port_file(spark, tmp_path):
    f = tmp_path / "ports.csv"
    f.write_text("Index Number,Main Port Name,Country Code,UN/LOCODE,Latitude,Longitude\n1,ALPHA,AA,AAAAA,10,20\n,NOID,AA,,1,2\n3,BAD,AA,,x,2\n4,BETA,BB,,-5.5,7\n")
    df, skipped = loaders.load_ports(spark, str(f))
    assert skipped == 2 and got(df.select("wpi_id", "name", "lon", "lat")) == [("1", "ALPHA", 20.0, 10.0), ("4", "BETA", 7.0, -5.5)]
    ring = json.loads(df.where("wpi_id = '1'").first().polygon)["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 33
    f.write_text("Index Number,Main Port Name,Country Code,Latitude\n1,ALPHA,AA,10\n")
    with pytest.raises(ValueError):
        loaders.load_ports(spark, str(f))


def test_zone_file(spark, tmp_path):
    box = lambda a, b: [[[a, a], [b, a], [b, b], [a, b], [a, a]]]
    features = [
        {"properties": {"MRGID": 8371, "GEONAME": "Alpha"}, "geometry": {"type": "Polygon", "coordinates": box(-1, 1)}},
        {"properties": {"mrgid": "8372", "name": "Beta"}, "geometry": {"type": "MultiPolygon", "coordinates": [box(10, 12), box(20, 21)]}},
        {"properties": {"name": "no id"}, "geometry": {"type": "Polygon", "coordinates": box(-1, 1)}},
        {"properties": {"mrgid": 5, "name": "null"}, "geometry": None},
    ]
    f = tmp_path / "zones.json"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    zones, skipped = loaders.load_zones(spark, str(f))
    assert skipped == 2 and got(zones.select("mrgid", "name")) == [(8371, "Alpha"), (8372, "Beta")]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 11.0, 11.0), (3, 20.5, 20.5), (4, 50.0, 50.0)], "position_id long, lon double, lat double")
    from wakeline.workspace import cut

    out = containment.containing(pts, cut(containment.coverage(loaders.zone_polygons(zones))), "position_id")
    assert got(out) == [(1, 8371), (2, 8372), (3, 8372)]


def test_watch_list_file(spark, tmp_path):
    f = tmp_path / "sdn.csv"
    f.write_text('101,"SONATA, THE",vessel,"SYRIA",-0- ,EPRS3,Cargo,-0- ,-0-,Iran,-0- ,-0-\n102,MAN,individual,X,-0-,-0-,-0-,-0-,-0-,-0-,-0-,-0-\n103,short\n')
    df, skipped = loaders.load_watch_list(spark, str(f))
    assert skipped == 1 and df.count() == 2
    (r,) = loaders.listed_vessels(df).collect()
    assert (r.ent_num, r.sdn_name, r.call_sign, r.vess_owner) == ("101", "SONATA, THE", "EPRS3", "")


def _lines(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _row(i, minute, lon, second=0):
    p = {"MessageType": "PositionReport", "MetaData": {"MMSI": 7, "ShipName": "A", "time_utc": f"2024-06-01 10:{minute:02d}:{second:02d} +0000 UTC"}, "Message": {"PositionReport": {"MessageID": 1, "UserID": 7, "Latitude": 1.0, "Longitude": lon, "Sog": 5.0}}}
    return {"id": i, "source": "s", "received_at": f"2024-06-01T10:{minute:02d}:30Z", "payload": json.dumps(p)}


def test_continuous_ingest(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _lines(src, "a.json", [_row(1, 1, 10.0), _row(2, 1, 10.0), _row(3, 2, 11.0)])
    for k in range(2):
        stream.start_ingest(stream.read_messages(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination()
        if not k:
            _lines(src, "b.json", [_row(4, 0, 9.0)])  # late
    raw = spark.read.parquet(str(out / "raw"))
    assert raw.count() == 4 and raw.where("is_duplicate").count() == 1
    assert spark.read.parquet(str(out / "positions")).count() == 3
    assert [r.lon for r in spark.read.parquet(str(out / "last/v=1")).collect()] == [11.0]
    before = got(spark.read.parquet(str(out / "positions")))
    stream.write_epoch(str(out), str(out / "last"))(stream.decoded(spark.read.schema(stream.RAW).json(str(src / "b.json"))), 1)  # the epoch again
    assert got(spark.read.parquet(str(out / "positions"))) == before


def test_duplicates_of_earlier_batches(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    same = lambda i, minute: _row(i, 1, 10.0) | {"received_at": f"2024-06-01T10:{minute:02d}:30Z"}
    batches = [[same(1, 1)], [_row(2, 30, 12.0)], [same(3, 5)], [same(4, 9), same(5, 20)]]
    for k, rows in enumerate(batches):
        _lines(src, f"{k}.json", rows)
        stream.start_ingest(stream.read_messages(spark, str(src)), str(out), str(tmp_path / "cp")).awaitTermination()
    want = [(1, False), (2, False), (3, True), (4, False), (5, False)]  # 3 does not prolong what 1 opened
    flags = lambda: got(spark.read.parquet(str(out / "raw")).select("id", "is_duplicate"))
    assert flags() == want and spark.read.parquet(str(out / "positions")).count() == 4
    for k in (3,):  # the last epoch again doesn't see its own receipts or later ones
        stream.write_epoch(str(out), str(out / "last"))(stream.decoded(spark.read.schema(stream.RAW).json(str(src / f"{k}.json"))), k)
    assert flags() == want


def test_a_lost_version_is_an_error(spark, tmp_path):
    write = stream.write_epoch(str(tmp_path), str(tmp_path / "last"))
    batch = spark.createDataFrame([_row(1, 1, 10.0)]).selectExpr("id", "source", "cast(received_at as timestamp) received_at", "payload")
    decoded = stream.decoded(batch.selectExpr("*", "null message_type", "null mmsi", "null reported_at", "null is_duplicate"))
    with pytest.raises(RuntimeError):
        write(decoded, 5)
    write(decoded, 0)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "vessels/v=0")).select("mmsi", "name", "is_new").collect()] == [(7, "A", True)]
    assert stream.expire(spark, str(tmp_path / "raw"), "date", as_of="2024-07-01", keep_days=10) == ["date=2024-06-01"]
    assert stream.only(decoded, mmsis=[8]).count() == 0 and stream.only(decoded, mmsis=[7], types=[1]).count() == 1


def test_streaming_rollup_and_dedup(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _lines(src, "a.json", [_row(1, 1, 10.0), _row(2, 1, 10.0), _row(3, 2, 11.0)])
    messages = stream.decoded(stream.read_messages(spark, str(src)))
    q = stream.first_receipts(messages).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    q = stream.hourly_stream(messages).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.position_count for r in spark.table("hours").collect()] == [3]
    assert stream.within_boxes(spark.createDataFrame([(1.0, 1.0), (9.0, 9.0)], "lon double, lat double"), [(2.0, 2.0, 0.0, 0.0)]).count() == 1


def test_retention(spark, tmp_path):
    for day in ("2024-05-01", "2024-05-31"):
        (tmp_path / f"date={day}").mkdir()
    assert stream.expire(spark, str(tmp_path), "date", as_of="2024-06-01", keep_days=10) == ["date=2024-05-01"]
