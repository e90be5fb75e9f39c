"""Names, destinations, packing, leaks and subjects."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import got
from wakeline.llm import destinations, leaks, names, packing, subjects
from wakeline.llm.typos import DeleteIndex, deletes, distance, plain


def edits(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
def test_distance(a, b, most):
    assert distance(a, b, most) == min(edits(a, b), most + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcd", min_size=6, max_size=9), max_size=15), st.text("abcd", min_size=6, max_size=9))
def test_delete_index_finds_all(words, probe):
    assert DeleteIndex(words).near(probe, 2) == {w: edits(w, probe) for w in words if edits(w, probe) <= 2}


def test_plain():
    assert plain("Sängixlåm Ørk") == "SANGIXLAM ORK" and deletes("ab", 1) == {"ab", "a", "b"}


NAMES = [
    (1, "Kanbexnem Pixfekbur Towage Ltd", '{"country":"XA"}'),
    (2, "KANBEXNEM PIXFEKBUR TOWAGE", None),
    (3, "Pixfekbur Kanbexnem Tow. Limited", "{}"),
    (4, "Kanbexnempixfekbur Towing", "broken"),
    (5, "Kanb. Pixfekbur Towage Co.", '["a"]'),
    (6, "Kaanbexnem Pixfelbur Towage", None),
    (7, "M/S Kánbexnem Pixfekbur Towage (QS)", None),
    (8, "Kanbexnem Pixfekbur, Towage Co. of", None),
    (10, "Kanbexnem Pixfekbur Ferries", None),  # another line
    (11, "Kanbexnem Ruszolnel Towage", None),  # another name
    (12, "Kanbexnem Pixfekbur Towage B.V.", '{"country":"ZZ"}'),  # another country
    (20, "Theodore Daxgaxsekbom", '{"office":"O"}'),
    (21, "Capt. Theo Daxgaxsekvom", None),
    (22, "DAXGAXSEKBOM, T.", None),
    (23, "Margaret Daxgaxsekbom", None),
    (24, "Mr/Ms Peggy Daxgaxsekbom", None),
    (30, "", None),
    (31, None, None),
    (32, "Ltd", None),
]


def operators(spark, rows):
    return spark.createDataFrame([(i, n, [], m, None) for i, n, m in rows], "id int, canonical string, aliases array<string>, metadata string, parent_id int")


def pairs_of(groups):
    return sorted((a, b) for g in groups for a in g for b in g if a < b)


@pytest.mark.parametrize("hot", [200, 2])
def test_same_operator(spark, monkeypatch, hot):
    monkeypatch.setattr(names, "HOT", hot)
    out = got(names.same_operator(operators(spark, NAMES)))
    joined = {p for p in out if 12 not in p}
    assert joined == set(pairs_of([[1, 2, 3, 4, 5, 6, 7, 8], [20, 21, 22], [23, 24]]))
    assert (1, 12) not in out
    assert got(names.same_operator(operators(spark, NAMES).limit(0))) == []


def test_general_names(spark):
    rows = [
        (1, "Michael Brandt", None), (2, "Brandt, Michael", None), (3, "Mike Brandt", None), (4, "Capt. M. Brandt", None), (5, "Thomas Weber", None), (6, "Tom Weber", None), (7, "Weber, T.", None),
        (8, "Acme Delta Trading Ltd", None), (9, "ACME DELTA TRADERS", None), (10, "Acme Delta Holdings", None), (11, "Kowalczyk, Zbyszko", None), (12, "Zbyszko Kowalczyk", None), (13, "Susan Brandt", None),
    ]
    out = got(names.same_operator(operators(spark, rows)))
    assert set(out) == set(pairs_of([[1, 2, 3, 4], [5, 6, 7], [8, 9], [11, 12]]))
    links = {i: n for i, _, n in got(names.classes(operators(spark, rows)))}
    assert links == {i: sum(i in p for p in out) for i in range(1, 14)}


def test_classes_count_no_links_between_countries(spark):
    rows = [(k, "Kanbexnem Pixfekbur Towage", c) for k, c in enumerate([None, '{"country":"XA"}', '{"country":"XA"}', '{"country":"XB"}', None], 1)]
    out = got(names.same_operator(operators(spark, rows)))
    assert {i: n for i, _, n in got(names.classes(operators(spark, rows)))} == {i: sum(i in p for p in out) for i in range(1, 6)}


def linked(spark, rows):
    reps = names.cut(names.readings(operators(spark, rows)))
    return {(r.x, r.y) for r in names._judged(reps, names._candidates(reps)).collect()}


def test_expanded_names_are_not_broadcast(spark, tmp_path):
    operators(spark, NAMES).write.parquet(f"{tmp_path}/operators")  # only a file has an estimate
    reps = names.cut(names.readings(spark.read.parquet(f"{tmp_path}/operators")))
    met = names._candidates(reps)
    for df in (met, names._judged(reps, met)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_splitting_hot_names_loses_no_pair(spark, monkeypatch):
    partners = "HORIZON HORYZEN HORIZN HOR. HO. RUSZOLNEL RUSZ. RUZSOLMEL TIPEMHAL TIPEMAHL TIBEMHOL".split()
    given = "Theodore Theo Ted T. Edward Ed E. Margaret Peggy M. Anna".split()
    rows = [(k + 1, f"Kanbexnem {p} Towage", None) for k, p in enumerate(partners)] + [(50 + k, f"{g} Daxgaxsekbom", None) for k, g in enumerate(given)]
    rows += [(80, "Kanbexnemhorizon Towage", None), (81, "Tipemhalkanbexnem Towage", None), (90, "Daxgaxsekbom", None)]
    whole = linked(spark, rows)
    assert {(1, 2), (1, 4), (1, 5), (6, 7), (6, 8), (9, 11), (1, 80), (9, 81), (50, 53), (51, 53)} <= whole
    monkeypatch.setattr(names, "HOT", 2)
    assert linked(spark, rows) == whole


@pytest.mark.parametrize("hot", [200, 3])
def test_all_pairs_meet_that_mean_the_same(spark, monkeypatch, hot):
    monkeypatch.setattr(names, "HOT", hot)
    rng = random.Random(11)

    def typed(word):
        for _ in range(rng.choice([0, 1, 2, 2])):
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("AEKN") + word[i:], word[:i] + rng.choice("AEKN") + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]]) or word
        return word

    words = [("NORD", "STAR"), ("KANBEXNEM", "PIXFEKBUR"), ("SOL", "RUSZOLNEL"), ("OX", "TIPEMHAL")]
    rows = [(1, "Nord Star Lines", '{"country":"XA"}'), (2, "Nord Star Lines", None)]
    for k in range(60):
        a, b = (typed(w) for w in words[k % 4])
        a = rng.choice([a, a, a[:4] + "."]) if len(a) > 7 else a
        rows.append((10 + k, rng.choice([f"{a} {b} Lines", f"{b} {a} Lines", f"{a}{b} Lines", typed(a + b) + " Lines"]), None))
    rows += [(100 + k, f"{rng.choice(['Theodore', 'Ted', 'T.', 'E.', 'Edward', 'Peggy'])} {typed('DAXGAXSEK')}", None) for k in range(30)]
    reps = names.readings(operators(spark, rows)).toPandas().sort_values("id")
    reps = list(reps.itertuples(index=False))
    want = {(x.id, y.id) for x in reps for y in reps if x.id < y.id and names.same(x, y)}
    assert (1, 2) in want and len(want) > 200
    assert linked(spark, rows) == want


def test_readings():
    assert names.read("Salmelnes Tipemhal, Bulk Carriers Co. of")["line"] == "BULK CARRIERS"
    assert names.read("Maritime Dantardar Saxmokbur")["line"] == "MARITIME"
    assert names.read("A & B Mar. Serv. S.A.")["line"] == "MARINE SERVICES"
    r = names.read("Besnoxbedak Ellie")
    assert (r["kind"], r["a"], r["given"]) == ("person", "BESNOXBEDAK", ["ELEANOR"])


PORTS = [(1, "Hiromsux Haven", "XC", "XCHIE"), (2, "Selfampuk", "QN", "QNSKL"), (3, "West Sidafel", "QT", "QTWID"), (4, "Sidafel", "QP", "QPSAF"), (5, "Lonpulon", "QR", "QRLON"), (6, "Lonpulon", "QS", "QSLON"), (7, "Dåmrexras", "XG", None), (8, None, "XG", "XGAAA"), (9, "Zixgurvas", "XF", "XFZIX")]
TYPED = {
    "HIROMSUX HAVEN@@@@@@": 1, "Hiromsux": 1, "HIRMSUX HAEN": 1, "XCHIE": 1, "xc hie": 1, "XC-HIE": 1, "QNSKL > XCHIE": 1, "QNSKL-XCHIE": 1, "XCHIE>>QPSAF": 4,
    "SEFLAMPUK": 2, "S E L F A M P U K": 2, "SELFAM PUK": 2, "SLFMP": 2, "S.L.F.M.P": 2, "SLFMP ETA 2604": 2, "S3LFAMPUK ANCH": 2, "TO SELFAMPUK VIA SDFL": 2, "EX LNPLN TO SELFAMPUK": 2, "SELFAMPUK EX LNPLN": 2, "SELFAMPUK V LNPLN": 2,
    "WEST SIDAFEL": 3, "SIDAFEL": 4, "W3ST S1DAFEL": 3, "QT/WEST SIDAFEL": 3, "PORT OF SIDAFEL": 4, "SIDAFEL BERTH 3": 4, "LONPULON (QS)": 6, "LONPULON,QR": 5, "LONPULON": 5, "DAMREXRAS": 7, "XGAAA PS": 8,
    "Z I X G U R V A S": 9, "BEMPAKGU": -1, "TO KANDARKAK": -1, "FOR ORDERS": -1, "At Sea": -1, "N/A": -1, "12345": -1, "QXZZZ": -1, "WEST": -1, "HAVEN": -1,
}


def messages(spark, at, texts):
    rows = []
    for i, t in enumerate(texts):
        body = {"MessageID": 5} if t is None else {"MessageID": 5, "Destination": t}
        rows.append((i, 7, json.dumps({"MessageType": "ShipStaticData", "MetaData": {}, "Message": {"ShipStaticData": body}})))
    rows += [(9000, 7, None), (9001, 7, '{"MessageType":"X","Message":{"X":"Destination"}}'), (9002, 7, "Destination")]
    return spark.createDataFrame(rows, "id long, mmsi long, payload string")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_destinations(spark, at, monkeypatch, limit):
    monkeypatch.setattr(destinations, "BROADCAST_TEXTS", limit)
    ports = spark.createDataFrame([(*p, 10.0 * p[0], 0.0) for p in PORTS], "id int, name string, country string, un_locode string, lon double, lat double")
    texts = [*TYPED, "@@@ .", "", None, "SIDAFEL"]
    out = dict(got(destinations.bound_for(messages(spark, at, texts), ports)))
    want = {i: TYPED[t] for i, t in enumerate(texts) if t in TYPED}
    assert {texts[i]: (p, want[i]) for i, p in out.items() if p != want.get(i)} == {} and set(out) == set(want)
    near = spark.createDataFrame([(7, 60.5, 0.0), (7, None, 0.0)], "mmsi long, lon double, lat double")
    assert dict(got(destinations.bound_for(messages(spark, at, ["LONPULON"]), ports, near))) == {0: 6}
    assert set(dict(got(destinations.bound_for(messages(spark, at, texts), ports.limit(0)))).values()) == {-1}


def test_tokens_meet_the_vocabulary_as_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABEKN") for _ in range(rng.randrange(2, 10)))
    typed, known = {(rng.choice("twcs"), word()) for _ in range(250)}, {(rng.choice("twcs"), word()) for _ in range(250)}
    out = got(destinations.repaired(spark.createDataFrame(sorted(typed), "kind string, token string"), spark.createDataFrame(sorted(known), "kind string, form string")))
    near = {(k, t, f, distance(t, f, 2)) for k, t in typed for j, f in known if j == k and distance(t, f, 2) <= destinations._allowed(k, t, f)}
    exact = {(k, t) for k, t, f, d in near if k == "t" and d == 0}
    assert set(out) == {x for x in near if x[:2] not in exact or x[3] == 0} and len(out) > 40


def test_rare_tokens_outweigh_frequent_ones(spark):
    ports = [(1, "Lower Kanbex", "XA", None), (2, "Upper Kanbex", "XA", None)] + [(10 + k, f"Lower {w}", "XA", None) for k, w in enumerate("Rusnam Tipemhal Dolgar Zimbur Fenhal".split())]
    table = spark.createDataFrame([(*p, 0.0, 0.0) for p in ports], "id int, name string, country string, un_locode string, lon double, lat double")
    texts = spark.createDataFrame([("LOWR KANBEXX",), ("UPER KANBX",), ("LOWER RUSNMA",), ("LOWER",)], "text string")
    assert dict(got(destinations.resolved(texts, table))) == {"LOWR KANBEXX": [1], "UPER KANBX": [2], "LOWER RUSNMA": [10], "LOWER": []}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_plan_holds_every_item_once(sizes):
    seen = {}
    for n, items in packing.plan(sizes, 100):
        assert n > 0 and sum(s * k for s, k in items.items()) <= 100 and sum(k for s, k in items.items() if 3 * s > 100) <= 2
        for s, k in items.items():
            seen[s] = seen.get(s, 0) + n * k
    assert seen == sizes


def test_plan_is_tight():
    rng = random.Random(1)
    sizes = {}
    for _ in range(3000):
        s = min(100, max(1, int(rng.lognormvariate(3, 0.8))))
        sizes[s] = sizes.get(s, 0) + 1
    bins = sum(n for n, _ in packing.plan(sizes, 100))
    assert bins <= 1.02 * sum(s * n for s, n in sizes.items()) / 100 + 1


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 7, 40, 40, 40, 60, 99, 100, 101, 250, 1000])) for i in range(500)]
    counts = spark.createDataFrame(rows, "doc_id long, tokens long")
    boxes = spark.createDataFrame([("a", 100), ("b", 256), ("c", None), ("d", 0)], "container_kind string, capacity_tokens int")
    out = packing.pack(counts, boxes).collect()
    for kind, capacity in (("a", 100), ("b", 256)):
        mine = [r for r in out if r.container_kind == kind]
        load, docs = {}, {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
            docs.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        for i, n in rows:
            pieces = sorted(docs[i])
            assert sum(t for _, t in pieces) == n and [p for p, _ in pieces] == list(range(len(pieces))) and len(pieces) == max(1, -(-n // capacity))
    assert {r.container_kind for r in out} == {"a", "b"}
    assert got(packing.pack(counts.limit(0), boxes)) == [] and got(packing.pack(counts, boxes.limit(0))) == []
    assert packing.unused(packing.pack(counts, boxes), boxes).count() == 2


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="the tokenizer's file is not here")
def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x " * 50_000), (None, "a")], "doc_id long, text string")
    assert got(packing.token_counts(docs))[:3] == [(1, 2), (2, 0), (3, 0)] and packing.token_counts(docs).count() == 4


PASSAGE = "In Mimlestos the sunken mirror remembered 10 hollow wells under a torn awning. Nobody in Gelheltuk knew why a lantern had hid the wooden staircase"


def test_leaks(spark):
    words = PASSAGE.split()
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short a passage"), (3, None), (4, "")], "item_id long, passage string")
    docs = {
        1: " ".join(words[3:15]), 2: " ".join(words[3:14]), 3: "+# " + "\n+# ".join(" ".join(words[i : i + 4]).upper() for i in range(0, 20, 4)),
        4: "<p>" + " ".join(words[:6]) + "</p>\n<b class='x'>" + "_".join(words[6:14]) + "</b>", 5: " ".join(words[:8] + ["other"] + words[8:16]), 6: None, 7: "",
        8: PASSAGE.replace("Mimlestos", "Pargunwes").replace("10", "77").replace("Gelheltuk", "Tonvaskir"), 9: PASSAGE,
        10: PASSAGE.replace("10 hollow", "ten hollow"),
    }
    df = spark.createDataFrame(list(docs.items()) + [(9, PASSAGE)], "doc_id long, text string")
    assert got(leaks.leaked(df, items)) == [(1, 1), (3, 1), (4, 1), (9, 1), (10, 1)]
    changed = got(leaks.reparameterised(df, items).select("doc_id", "replaced"))
    assert (8, 3) in changed and (10, 1) in changed and 9 not in dict(changed)
    assert got(leaks.leaked(df.limit(0), items)) == [] and got(leaks.leaked(df, items.limit(0))) == []


def planted(rng, n):
    """Passages, and documents that repeat one with other names and numbers; consistently or not."""
    plain = [f"{a}{b}" for a in "lo ma ne pi ru sa to vu".split() for b in "ber dan fil gor kel".split()]
    names = [f"{a}{b}" for a in "Ark Bel Cor Dun Eld Fen Gul Hal".split() for b in "holm wick stad ford mere".split()]
    items, docs, truth = [], [], set()
    for i in range(n):
        own = rng.sample(names, 3)
        words = [rng.choice(plain) for _ in range(30)]
        for k, name in zip((4, 9, 14, 20), (own[0], own[1], own[0], own[2])):
            words[k] = name
        words[11] = str(rng.randrange(10, 99))
        items.append((i, " ".join(words).capitalize().replace(own[0].lower(), own[0]).replace(own[1].lower(), own[1]).replace(own[2].lower(), own[2]) + "."))
        new = rng.sample([x for x in names if x not in own], 4)
        swap = {own[0]: new[0], own[1]: new[1], own[2]: new[2]}
        for kind in ("consistent", "torn"):
            changed = [swap.get(w, w) for w in words]
            changed[11] = "77"
            if kind == "torn":
                changed[14] = new[3]  # the same name replaced by two others
            else:
                truth.add((len(docs), i))
            docs.append((len(docs), "so it was. and then " + " ".join(changed) + " as they say"))
    return items, docs, truth


def test_reparameterised_leaks_by_recall(spark):
    items, docs, truth = planted(random.Random(4), 60)
    out = leaks.reparameterised(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    found = {(d, i) for d, i, *_ in got(out)}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.1 * len(truth)


@pytest.mark.parametrize("chars", [1, 500])
def test_leaks_are_the_same_in_any_number_of_blocks(spark, monkeypatch, chars):
    items, docs, _ = planted(random.Random(5), 12)
    docs += [(900 + i, p.upper()) for i, p in items[:5]]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = got(leaks.leaked(df, held)), got(leaks.reparameterised(df, held))
    assert {(900 + i, i) for i in range(5)} <= set(want[0]) and want[1]
    monkeypatch.setattr(leaks, "MOST_CHARS", chars if chars > 1 else 800)
    assert (got(leaks.leaked(df, held)), got(leaks.reparameterised(df, held))) == want


def test_slots_decide_what_is_a_verbatim_leak(spark):
    """Without the slots every re-parameterised window would be a leak."""
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, passage string")
    other = PASSAGE.replace("Mimlestos", "Gelheltuk")
    df = spark.createDataFrame([(1, PASSAGE), (2, " ".join(other.split()[:13]))], "doc_id long, text string")
    met = leaks.template_matches(df, items, size=12, by_case=False)
    assert set(got(met.select("doc_id").distinct())) == {(1,), (2,)} and got(leaks.leaked(df, items)) == [(1, 1)]


def test_windows_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{c}" for c in "abcdefgh"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(4)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(40)]
        if d % 2:
            i, n = rng.randrange(4), rng.randrange(9, 16)
            at = rng.randrange(0, 30 - n)
            w[5:5] = items[i][1].split()[at : at + n]
        docs.append((d, " ".join(w)))
    windows = {(i, tuple(p.split()[k : k + 12])) for i, p in items for k in range(19)}
    want = sorted({(d, i) for d, t in docs for k in range(len(t.split()) - 11) for i, w in windows if tuple(t.split()[k : k + 12]) == w})
    out = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert got(out) == want and want


TERMS = {"space": "orbit comet galaxy nebula quasar parallax eclipse pulsar".split(), "court": "verdict plaintiff tribunal injunction statute appeal trial docket".split(), "clinic": "vaccine biopsy symptom oncology dosage triage trial infusion".split(), "farm": "harvest barley tractor pasture silage vineyard compost wheat".split()}


def corpus(rng, n):
    plainly = "the table gets new column for value index count list entry key buffer when old size name default status change only moves".split()
    docs, truth = [], {}
    for i in range(n):
        mine = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        w = [rng.choice(plainly) for _ in range(40)] + [rng.choice(TERMS[s]) for s in mine for _ in range(9)]
        if not mine:
            w.append(rng.choice(TERMS["space"]))  # a single word in passing
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        truth[i] = set(mine)
    return docs, truth


def test_subjects_by_held_out_accuracy(spark):
    rng = random.Random(8)
    docs, truth = corpus(rng, 600)
    labels = [(i, rng.choice(sorted(truth[i]))) for i in range(80) if truth[i]] + [(3, "farm"), (9999, "farm"), (None, "farm"), (5, None)]
    df = spark.createDataFrame([*docs, (700, None), (701, ""), (None, "orbit")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string")
    found = {}
    for d, s in got(subjects.subjects_of(df, lab)):
        found.setdefault(d, set()).add(s)
    held = range(80, 600)
    right = sum(len(found.get(i, set()) & truth[i]) for i in held)
    assert right / sum(len(truth[i]) for i in held) > 0.95 and right / sum(len(found.get(i, set())) for i in held) > 0.97
    assert 700 not in found and 701 not in found
    assert got(subjects.subjects_of(df, lab.limit(0))) == [] and got(subjects.subjects_of(df.limit(0), lab)) == []
    share = {r.subject: r.documents for r in subjects.composition(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, subject string"), df).collect()}
    assert share == {"a": 2}


def test_calibration_lies_between_words_in_passing_and_subjects():
    """Labels are incomplete and now and then wrong; the middle of the curve is found all the same."""
    rng = np.random.default_rng(3)
    nats = np.r_[rng.uniform(0, 0.2, 4000), rng.uniform(4, 6.2, 200), rng.uniform(15, 90, 700)]
    true = np.r_[np.zeros(4200), np.ones(700)]
    label = np.where(true > 0, rng.random(4900) < 0.8, rng.random(4900) < 0.004).astype(float)
    assert 6.2 < subjects.calibrated(nats, label) < 16


def test_models_and_background_decide(spark):
    """Without own models no subject saves a nat; bigrams change the cross-entropies."""
    rng = random.Random(8)
    docs, _ = corpus(rng, 300)
    held = subjects.hashed(spark.createDataFrame(docs, "doc_id long, text string"))
    model = subjects.train(held, spark.createDataFrame([(i, s) for i, t in docs[:80] for s in TERMS if sum(w in t.split() for w in TERMS[s]) > 3], "doc_id long, subject string"))
    rows = held.orderBy("doc_id").collect()
    hashes, doc, n = subjects._open(pa.array([r.words for r in rows], pa.binary()))
    got, saved = subjects.score(hashes, doc, n, model)
    assert saved.max() > model.least_nats > 0 and len(model.pairs)
    flat = subjects.replace(model, own=np.repeat(model.background[:, None], 4, 1), pairs=model.pairs[:0])
    assert subjects.score(hashes, doc, n, flat)[1].max() < 1e-6
    words_only = subjects.score(hashes, doc, n, subjects.replace(model, pairs=model.pairs[:0]))[1]
    assert np.abs(words_only - saved).max() > 0.1
    one = [i for i, (_, t) in enumerate(docs) if sum(w in t.split() for s in TERMS for w in set(TERMS[s])) == 1]
    assert one and saved[one].max() < model.least_nats  # a word in passing, however often, is not enough


def test_tokens():
    assert subjects.tokens("commit 0123abcd\nreadDrought sprint_number ab f00d Wheat\nindex 12..34") == ["read", "drought", "sprint", "number", "wheat"]


def test_only_headers_and_addresses_are_no_text():
    text = "commit 0123abcd\nFrom 0123abcd Mon Sep\nindex 01ab..23cd 100644\nFrom now on anchors\ncommitted ropes\nindexes of cables\nsee https://a.example/harbour for tides\n"
    assert subjects.tokens(text) == "from now anchors committed ropes indexes cables see for tides".split()
