"""Scenarios of the detectors, profiles, matching and ownership."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import AS_OF, got
from wakeline.functions import text as T
from wakeline.functions import vector as V
from wakeline.operators import graph, hints, profile, resolution, similar_text, visits
from wakeline.sources.loaders import circle

PORTS = "id int, lon double, lat double"


def ports(spark, rows):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], PORTS)
    return df.withColumn("polygon", circle(F.col("lon"), F.col("lat"), 2000.0))


def test_port_calls(spark, fixes):
    rows = [(1001, m, 0.001, 0.001, 0.5) for m in range(40, -1, -5)]
    rows += [(1002, m, 0.001, 0.001, 0.4) for m in range(90, 49, -5)] + [(1002, m, 5.0, 5.0, 12.0) for m in range(40, -1, -5)]
    rows += [(1003, 35, 0.001, 0.001, 8.0), (1003, 33, 0.001, 0.0011, 8.0), (1003, 31, 0.001, 0.0012, 8.0), (1003, 20, 5.0, 5.0, 12.0)]
    rows += [(1004, m, None, None, None) for m in (50, 40)]
    p, q = fixes(rows), ports(spark, [(1, 0, 0), (2, 0.001, 0)])
    for lookback in (None, "6h"):
        out = {r.mmsi: r for r in visits.port_calls(p, q, as_of=AS_OF, lookback=lookback).collect()}
        assert set(out) == {1001, 1002}
        assert out[1001].departed_at is None and out[1001].positions == 9 and out[1001].port_id == 2
        assert out[1002].departed_at is not None and out[1002].min_sog == pytest.approx(0.4)
    new = visits.port_calls(p, q, as_of=AS_OF, lookback=None)
    assert got(visits.reconcile_calls(new, new)) == got(new.select("mmsi", "port_id", "arrived_at", "departed_at", "min_sog", "positions"))
    assert got(visits.port_calls(p.limit(0), q, as_of=AS_OF)) == []
    assert got(visits.port_calls(p, q.limit(0), as_of=AS_OF)) == []


def test_crossings(spark, fixes, square):
    fences = spark.createDataFrame([(1, square(-0.5, -0.5, 0.5, 0.5), True), (2, square(-0.5, -0.5, 0.5, 0.5), False)], "id int, polygon string, active boolean")
    p = fixes([(3001, 20, 2.0, 2.0, 1.0), (3001, 15, 0.0, 0.0, 1.0), (3001, 10, 0.1, 0.1, 1.0), (3001, 5, 2.0, 2.0, 1.0), (3002, 20, 0.45, 0.45, 1.0), (3002, 15, 0.451, 0.451, 1.0), (3003, 9, 0.0, 0.0, 1.0)])
    out = [(r.geofence_id, r.mmsi, r.event_type, r.lon) for r in visits.geofence_crossings(p, fences, as_of=AS_OF, lookback="30m").orderBy("occurred_at").collect()]
    assert out == [(1, 3001, "enter", 0.0), (1, 3001, "exit", 2.0)]


def test_encounters(spark, fixes):
    rows = [(5001, m, 10.0, 10.0, 1.0) for m in range(40, -1, -5)] + [(5002, m, 10.001, 10.0, 0.8) for m in range(40, 4, -5)] + [(5002, 0, 10.5, 10.0, 9.0)]
    rows += [(6001, m, 20.0, 20.0, 0.5) for m in range(40, -1, -5)] + [(6002, m, 20.001, 20.0, 0.5) for m in range(40, -1, -5)]
    rows += [(7001, m, 30.0, 30.0, 1.0) for m in (10, 5, 0)] + [(7002, m, 30.001, 30.0, 1.0) for m in (10, 5, 0)] + [(8001, 3, 30.0, 30.0, None)]
    (e,) = visits.sts_events(fixes(rows), ports(spark, [(1, 20, 20)]), as_of=AS_OF, lookback=None).collect()
    assert (e.mmsi_a, e.mmsi_b) == (5001, 5002) and e.ended_at is not None and 90 < e.min_distance < 200


def test_silences(spark, fixes, at):
    day = 24 * 60
    p = fixes([(801, 3 * day, 49.0, 10.0, 1.0), (801, 600, 50.0, 10.0, 1.0), (802, 120, 1.0, 1.0, 1.0), (803, 5 * day, 1.0, 1.0, 1.0), (804, 600, 20.0, 20.0, 0.1)])
    calls = spark.createDataFrame([(804, None)], "mmsi long, departed_at timestamp")
    none = spark.createDataFrame([], "mmsi long, resolved_at timestamp")
    gaps = visits.detect_gaps(p, calls, none, as_of=AS_OF)
    assert [(r.mmsi, r.gap_hours, r.last_lon) for r in gaps.collect()] == [(801, 10, 50.0)]
    opened = gaps.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    assert got(visits.detect_gaps(p, calls, opened, as_of=AS_OF)) == []
    later = p.unionByName(fixes([(801, 0, 55.0, 12.0, 1.0)]).withColumn("position_id", F.lit(99).cast("long")))
    assert [r.resolution for r in visits.resolve_gaps(opened, later, as_of=AS_OF).collect()] == ["reappeared_far"]
    assert got(visits.resolve_gaps(opened, p, as_of=AS_OF)) == []
    q = fixes([(555, 180, 1.0, 1.0, 1.0), (555, 30, 1.0, 1.0, 1.0), (666, 20, 1.0, 1.0, 1.0)])
    assert [r.mmsi for r in visits.position_gaps(q, as_of=AS_OF).collect()] == [555]


def test_vectors(spark, fixes, at):
    rows = []
    for m, lon, lat, n in ((1001, 10, 10, 60), (1002, 10, 10, 60), (1003, -120, -40, 60), (1004, 50, 50, 10)):
        rows += [(m, g * 60, lon + (g % 3) * 0.1, lat + (g % 3) * 0.1, 1.0) for g in range(1, n + 1)]
    e = profile.trajectory_embeddings(fixes([(m, t, float(x), float(y), s) for m, t, x, y, s in rows]), as_of=AS_OF)
    assert {r.mmsi for r in e.collect()} == {1001, 1002, 1003}
    names = spark.createDataFrame([(m, f"v{m}") for m in (1001, 1002, 1003)], "mmsi long, name string")
    near = profile.similar_vessels(e, names, 1001).collect()
    assert near[0].mmsi == 1002 and near[0].similarity > 0.99 and near[1].similarity < 0.1
    assert profile.similar_vessels(e, names, 1004).count() == 0


def test_bucket_is_a_hash_of_the_cell(spark):
    pts = [(-180.0, -90.0), (179.9999, 89.9999), (200.0, 95.0), (0.5, 0.5), (-0.5, -0.5)]
    df = spark.createDataFrame(pts, "x double, y double")
    want = []
    for x, y in pts:
        cell = math.floor(max(-90, min(y, 89.999)) + 90) * 360 + math.floor(max(-180, min(x, 179.999)) + 180)
        want.append((cell * 2654435761 % 2**32) % 64)
    assert [r[0] for r in df.select(V.grid_bucket(F.col("x"), F.col("y"))).collect()] == want


def unit(*at):
    v = [0.0] * 64
    for i, w in at:
        v[i] = w
    return v


def test_anomalies_and_exact_neighbours(spark, at):
    a, b = unit((5, 1.0)), unit((40, 1.0))
    rows = [(10, 3, a), (10, 2, a), (10, 0, a), (20, 3, a), (20, 2, a), (20, 0, b), (30, 0, a), (40, 1, unit()), (40, 0, a)]
    e = spark.createDataFrame([(m, at(d * 1440), v, "gridcell_v1") for m, d, v in rows], "mmsi long, window_start timestamp, embedding array<float>, method string")
    out = {r.mmsi: r for r in profile.anomaly_scores(e, as_of=AS_OF).collect()}
    assert out[10].score < 0.1 and out[20].score > 0.9 and out[20].history_windows == 2 and 30 not in out and out[40].score is None or out[40].score == 1.0
    rng = random.Random(0)
    vec = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    df = spark.createDataFrame(vec, "id long, v array<float>")
    found = got(profile.nearest(df.where("id % 20 = 0"), df, key="id", vector="v", k=3, block=16).select("query", "rank", "key"))
    cos = lambda p, q: sum(x * y for x, y in zip(p, q)) / math.hypot(*p) / math.hypot(*q)
    want = []
    for i, v in vec[::20]:
        best = sorted(((-cos(v, w), j) for j, w in vec if j != i))[:3]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(best)]
    assert found == sorted(want)


def trgm(s):
    import re

    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for i in range(len(w) + 1)}


def test_similarity_values(spark):
    df = spark.createDataFrame([("Maersk Line", "Maersk Tankers"), ("Mediterranean Shipping Co", "MEDITERRANEAN SHIPPING COMPANY"), ("", ""), (None, "x")], "a string, b string")
    out = [r[0] for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()]
    assert out[0] == pytest.approx(0.3684, abs=1e-4) and out[1] == pytest.approx(0.7812, abs=1e-4) and out[2] == 0


def test_similar_join_loses_nothing(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 9))) for _ in range(60)] + [None, "abc", "abc"]
    left = spark.createDataFrame(list(enumerate(names)), "i long, n string")
    right = left.selectExpr("i as j", "n as m")
    for bound in (0.3, 0.7, 1.0):
        want = sorted((i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and trgm(a) and trgm(b) and len(trgm(a) & trgm(b)) / len(trgm(a) | trgm(b)) >= bound)
        out = similar_text.similar(left, right, left_key="i", left_text="n", right_key="j", right_text="m", at_least=bound)
        assert got(out.select("i", "j")) == want


def test_watch_list(spark):
    v = spark.createDataFrame([(701, "SONATA", "ZZZ1"), (702, "MYSTERY SHIP", "EPRS3"), (703, "HAPPY BOAT", "QQQ9"), (704, None, "")], "mmsi long, name string, call_sign string")
    s = spark.createDataFrame([("101", "SONATA", "EPRS3"), ("102", "ADRIAN DARYA", "9HA5119"), ("103", None, "")], "ent_num string, sdn_name string, call_sign string")
    out = similar_text.watch_list_matches(v, s, as_of=AS_OF)
    assert got(out.select("mmsi", "reference")) == [(701, "101"), (702, "101")]


def test_destinations(spark):
    p = spark.createDataFrame([(1, "SINGAPORE", "SGSIN"), (2, "ROTTERDAM", "NLRTM"), (3, "HAMBURG", "DEHAM"), (4, "PORT SAID", "EGPSD"), (5, None, None)], "id int, name string, un_locode string")
    want = {"SINGAPORE": (1, 0.9), "SGSIN": (1, 0.9), "SNGP": (1, 0.7), "SG SIN": (1, 0.9), "TO ROTTERDAM VIA HAM": (2, 0.5), "ROTTRDAM": (2, 0.5), "HAM": (3, 0.7), "XXXXX": (None, 0), "AT SEA": (None, 0), "": (None, 0)}
    texts = spark.createDataFrame([(t,) for t in want], "destination string")
    out = {r.destination: (r.port_id, r.confidence) for r in hints.resolve_destinations(texts, p).collect()}
    for text, (port, least) in want.items():
        assert out[text][0] == port and out[text][1] >= least - 1e-6, text


def test_operator_names(spark):
    known = spark.createDataFrame([(1, "Mediterranean Shipping Co", ["MSC Line"])], "id int, canonical string, aliases array<string>")
    names = spark.createDataFrame([("MEDITERRANEAN SHIPPING COMPANY", 1), ("MOL", 2), ("Maersk Line", 3), ("msc line", 4), ("MOL", 5), (" ", 6), (None, 7), ("Maersk Lines", 8)], "name string, seq long")
    out = {r.name: r for r in resolution.resolve_operators(names, known).collect()}
    assert {k: r.decision for k, r in out.items()} == {"MEDITERRANEAN SHIPPING COMPANY": "fold", "MOL": "create", "Maersk Line": "create", "msc line": "exact", "Maersk Lines": "join"}
    assert out["Maersk Lines"].canonical == "Maersk Line"
    again = resolution.with_aliases(known, resolution.resolve_operators(names, known))
    assert again.first().aliases == ["MSC Line", "MEDITERRANEAN SHIPPING COMPANY"]
    more = spark.createDataFrame([(1, "Maersk Line", None)], "id int, canonical string, aliases array<string>")
    assert [r.candidate_id for r in resolution.review_queue(spark.createDataFrame([("Maersk Tankers", 1)], "name string, seq long"), more).collect()] == [1]


def test_ownership(spark):
    ops = spark.createDataFrame([(1, "Maersk", None), (2, "Hamburg Sud", 1), (3, "Sealand", 2)], "id int, canonical string, parent_id int")
    edges = spark.createDataFrame([(91, 2, "owner"), (92, 3, "owner")], "mmsi long, operator_id int, role string")
    vessels = spark.createDataFrame([(91, "a"), (92, "b")], "mmsi long, name string")
    root = lambda i: spark.createDataFrame([(i,)], "id int")
    assert got(graph.vessels_by_group(ops, edges, vessels, root(1)).select("mmsi", "depth")) == [(91, 1), (92, 2)]
    assert got(graph.vessels_by_group(ops, edges, vessels, root(3)).select("mmsi")) == [(92,)]
    assert got(graph.ancestor_chain(ops, root(3)).select("depth", "canonical")) == [(0, "Maersk"), (1, "Hamburg Sud"), (2, "Sealand")]
    graph.assert_acyclic(ops)
    for bad in ([(1, "a", 1)], [(1, "a", 3), (2, "b", 1), (3, "c", 2), (4, "d", 3)]):
        with pytest.raises(ValueError):
            graph.assert_acyclic(spark.createDataFrame(bad, "id int, canonical string, parent_id int"))


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 140)] + [tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)] + [(7, 7)]
    parent = {i: i for i in range(150)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = graph.components(spark.range(150), spark.createDataFrame(links, "x long, y long"))
    assert got(out) == [(i, find(i)) for i in range(150)]


def test_search(spark):
    v = spark.createDataFrame([(1, "MAERSK SEALAND", "OWNM1", "DK"), (2, "EVER GIVEN", "H3RC", "PA"), (3, "MSC OSCAR", "MAERSK", "PA"), (4, "SEALAND QUEEN", "ZZZZ1", "US"), (5, None, None, None)], "mmsi long, name string, call_sign string, flag_country string")
    ids = lambda q: [r.mmsi for r in profile.vessel_search(v, q).collect()]
    assert ids("maersk") == [1, 3] and ids("sealand queen") == [4] and ids("  ") == [] and ids("!@#$") == [] and set(ids("seal")) == {1, 4} and ids("h3rc") == [2]
    assert profile.query_terms("seal & (evil)") == ["seal", "evil"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=6))
def test_cover_rank(words):
    rank = profile._cover_rank(words, [1.0] * len(words), ["a", "b"])
    assert (rank > 0) == ({"a", "b"} <= set(words)) and rank <= len(words)
    assert profile._cover_rank(["a", "b"], [1.0, 1.0], ["a", "b"]) > profile._cover_rank(["a", "c", "b"], [1.0] * 3, ["a", "b"])


def test_estimates_do_not_grow_with_the_rounds(spark):
    ids = list(range(300))
    random.Random(3).shuffle(ids)
    out = graph.components(spark.range(300), spark.createDataFrame(list(zip(ids, ids[1:])), "x long, y long"))
    assert {r.root for r in out.collect()} == {0}
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**400


def test_expanded_trigrams_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "NORD STAR"), (2, "NORTH STAR")], "i long, n string").write.parquet(f"{tmp_path}/names")  # only a file has an estimate
    left = spark.read.parquet(f"{tmp_path}/names")
    out = similar_text.similar(left, left.selectExpr("i as j", "n as m"), left_key="i", left_text="n", right_key="j", right_text="m", at_least=0.5)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert got(out.select("i", "j")) == [(1, 1), (1, 2), (2, 1), (2, 2)]
