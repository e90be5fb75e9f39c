"""The analytics over the domain tables, each with the SQL that says the same.

Times leave the engine as microseconds since the epoch, derived doubles rounded, so that
two engines give equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.io import table
from wakeline.operators import feeds, graph, hints, ingest, profile, resolution, similar_text, visits
from wakeline.operators.containment import containing, coverage
from wakeline.workspace import cut

AS_OF = "2024-01-12 12:00:00"
T = f"TIMESTAMP '{AS_OF}'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def micros(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp"})


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: micros(f(lambda name: table(spark, folder, name)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- pieces of SQL ----------------------------------------------------------------
def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    mid = f"radians((({lat1}) + ({lat2})) / 2)"
    w = f"(1 - 0.00669437999014::DOUBLE * pow(sin({mid}), 2))"
    dlon = f"(({lon2}) - ({lon1}))"
    return f"sqrt(pow(radians({dlon}) * 6378137.0::DOUBLE / sqrt({w}) * cos({mid}), 2) + pow(radians(({lat2}) - ({lat1})) * (6378137.0::DOUBLE * (1 - 0.00669437999014::DOUBLE)) / pow({w}, 1.5::DOUBLE), 2))"


def inside_sql(points: str, regions: str, name: str = "hit") -> str:
    """CTEs that end in ``name`` (position_id, id): points in polygons."""
    return f"""
{name}_rings AS (SELECT id, unnest(CAST(json_extract(polygon, '$.coordinates') AS DOUBLE[][][])) AS r FROM {regions} WHERE polygon IS NOT NULL),
{name}_i AS (SELECT id, r, unnest(range(1, len(r))) AS i FROM {name}_rings),
{name}_e AS (SELECT id, r[i][1] AS x1, r[i][2] AS y1, r[i + 1][1] AS x2, r[i + 1][2] AS y2 FROM {name}_i),
{name}_b AS (SELECT id, min(x1) AS xa, max(x1) AS xb, min(y1) AS ya, max(y1) AS yb FROM {name}_e GROUP BY id),
{name} AS (SELECT p.position_id, e.id FROM {points} p JOIN {name}_b b ON p.lon BETWEEN b.xa AND b.xb AND p.lat BETWEEN b.ya AND b.yb JOIN {name}_e e ON e.id = b.id
  WHERE (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1
  GROUP BY p.position_id, e.id HAVING count(*) % 2 = 1)"""


BODY = "json_extract(payload, '$.Message.' || json_extract_string(payload, '$.MessageType'))"
MOMENT = r"epoch_us(try_cast(substring(regexp_replace(json_extract_string(payload, '$.MetaData.time_utc'), '^(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d\.?\d*)(Z| \+0000 UTC)$', '\1 \2'), 1, 26) AS TIMESTAMP))"
DECODED = f"""
body AS (SELECT id, source, received_at, payload, {BODY} AS b, {MOMENT} AS us FROM raw_messages),
decoded AS (SELECT id, source, received_at, coalesce(try_cast(json_extract_string(b, '$.MessageID') AS INT), 0) AS message_type,
  coalesce(try_cast(json_extract_string(payload, '$.MetaData.MMSI') AS BIGINT), try_cast(json_extract_string(b, '$.UserID') AS BIGINT), 0) AS mmsi,
  trim(coalesce(json_extract_string(payload, '$.MetaData.ShipName'), '')) AS name, us,
  try_cast(json_extract_string(b, '$.Latitude') AS DOUBLE) AS lat0, try_cast(json_extract_string(b, '$.Longitude') AS DOUBLE) AS lon0,
  try_cast(json_extract_string(b, '$.Sog') AS DOUBLE) AS sog0, try_cast(json_extract_string(b, '$.Cog') AS DOUBLE) AS cog0, try_cast(json_extract_string(b, '$.TrueHeading') AS DOUBLE) AS h0,
  json_extract_string(b, '$.Destination') AS destination FROM body),
messages AS (SELECT *, message_type IN (1, 2, 3, 18, 19, 27) AND lat0 IS NOT NULL AND lon0 IS NOT NULL AS has_position FROM decoded)"""


def _messages(t) -> DataFrame:
    return ingest.decode_messages(t("raw_messages").drop("message_type", "mmsi", "reported_at", "is_duplicate"), keep=["id", "source", "received_at"])


# -- ingest -------------------------------------------------------------------------
@query(f"""WITH {DECODED} SELECT id, message_type, mmsi, name, us AS reported_at, has_position, CASE WHEN has_position THEN lat0 END AS lat, CASE WHEN has_position THEN lon0 END AS lon,
  CASE WHEN has_position THEN sog0 END AS sog, CASE WHEN has_position THEN cog0 END AS cog, CASE WHEN has_position THEN CAST(h0 AS SMALLINT) END AS heading FROM messages""")
def n21_decode_messages(t):
    return _messages(t).select("id", "message_type", "mmsi", "name", "reported_at", "has_position", "lat", "lon", "sog", "cog", "heading")


@query(f"""WITH RECURSIVE {DECODED}, f AS (SELECT id, epoch_us(received_at) AS ra, hash(mmsi, message_type, coalesce(us, 0), round(CASE WHEN has_position THEN lon0 ELSE 0 END, 6), round(CASE WHEN has_position THEN lat0 ELSE 0 END, 6)) AS k FROM messages),
opened(k, ra) AS (SELECT k, min(ra) FROM f GROUP BY k UNION ALL SELECT o.k, min(f.ra) FROM opened o JOIN f ON f.k = o.k AND f.ra > o.ra + 300000000 GROUP BY o.k, o.ra),
first AS (SELECT min(id) AS id FROM f JOIN opened USING (k, ra) GROUP BY k, ra)
SELECT id, id NOT IN (SELECT id FROM first) AS is_duplicate FROM f""")
def n19_dedup_messages(t):
    return ingest.duplicate_flags(_messages(t))


@query("SELECT source, epoch_us(date_trunc('minute', received_at)) AS window_start, count(*) AS count FROM raw_messages GROUP BY ALL")
def n20_rate_counters(t):
    return ingest.rate_counters(t("raw_messages"))


@query("""SELECT mmsi, epoch_us(reported_at) AS reported_at, epoch_us(received_at) AS received_at, lon, lat, sog, cog, heading, nav_status FROM positions
QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY reported_at DESC, position_id DESC) = 1""")
def n18_last_positions(t):
    return ingest.last_positions(t("positions"))


@query(f"""SELECT mmsi, epoch_us(coalesce(reported_at, received_at)) AS reported_at, epoch_us(received_at) AS received_at, coalesce(try_cast(json_extract_string(payload, '$.MetaData.longitude') AS DOUBLE), try_cast(json_extract_string({BODY}, '$.Longitude') AS DOUBLE)) AS lon, coalesce(try_cast(json_extract_string(payload, '$.MetaData.latitude') AS DOUBLE), try_cast(json_extract_string({BODY}, '$.Latitude') AS DOUBLE)) AS lat
FROM raw_messages WHERE message_type IN (1, 2, 3, 18, 19, 27) AND lon IS NOT NULL AND lat IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY coalesce(reported_at, received_at) DESC, id DESC) = 1""")
def n18_rebuild_last_positions(t):
    return ingest.rebuild_last_positions(t("raw_messages"))


@query(f"""WITH {DECODED}, b AS (SELECT mmsi, max_by(name, id) FILTER (name <> '') AS n, min(epoch_us(received_at)) AS f, max(epoch_us(received_at)) AS l FROM messages GROUP BY mmsi),
v AS (SELECT mmsi, name, epoch_us(first_seen_at) AS f, epoch_us(last_seen_at) AS l FROM vessels)
SELECT coalesce(b.mmsi, v.mmsi) AS mmsi, coalesce(b.n, v.name) AS name, coalesce(v.f, b.f) AS first_seen_at, greatest(v.l, b.l) AS last_seen_at, v.f IS NULL AS is_new FROM b FULL JOIN v ON b.mmsi = v.mmsi""")
def k5_upsert_vessels(t):
    return ingest.upsert_vessels(t("vessels"), _messages(t))


@query(f"""WITH s AS (SELECT mmsi, received_at, id, json_extract(payload, '$.Message.ShipStaticData') AS b FROM raw_messages WHERE message_type = 5),
l AS (SELECT * FROM s WHERE json_extract_string(b, '$.MessageID') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY received_at DESC, id DESC) = 1),
n AS (SELECT mmsi, CAST(json_extract_string(b, '$.ImoNumber') AS BIGINT) AS imo, trim(json_extract_string(b, '$.CallSign')) AS call_sign, trim(json_extract_string(b, '$.Name')) AS name, CAST(json_extract_string(b, '$.Type') AS INT) AS ship_type,
  CAST(json_extract_string(b, '$.Dimension.A') AS INT) + CAST(json_extract_string(b, '$.Dimension.B') AS INT) AS length_m, CAST(json_extract_string(b, '$.Dimension.C') AS INT) + CAST(json_extract_string(b, '$.Dimension.D') AS INT) AS beam_m,
  trim(json_extract_string(b, '$.Destination')) AS destination FROM l)
SELECT v.mmsi, coalesce(nullif(n.imo, 0), v.imo) AS imo, coalesce(nullif(n.ship_type, 0), CAST(v.ship_type AS INT)) AS ship_type, coalesce(nullif(n.length_m, 0), v.length_m) AS length_m, coalesce(nullif(n.beam_m, 0), v.beam_m) AS beam_m,
  coalesce(nullif(n.call_sign, ''), v.call_sign) AS call_sign, coalesce(nullif(n.name, ''), v.name) AS name, n.destination, CASE WHEN n.destination IS NOT NULL THEN epoch_us({T}) END AS enriched_at
FROM vessels v LEFT JOIN n ON v.mmsi = n.mmsi""")
def n17_enrich_vessels(t):
    out = ingest.enrich_vessels(t("vessels"), t("raw_messages"), as_of=AS_OF)
    return out.select("mmsi", "imo", "ship_type", "length_m", "beam_m", "call_sign", "name", "destination", "enriched_at")


@query("""SELECT epoch_us(date_trunc('hour', reported_at)) AS bucket, mmsi, count(*) AS position_count, round(avg(CAST(sog AS DOUBLE)), 4) AS avg_sog, max(sog) AS max_sog, count(*) AS vertices,
  string_agg(CAST(CAST(round(lon * 1000000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(lat * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY reported_at, lon NULLS FIRST, lat NULLS FIRST) AS track FROM positions GROUP BY ALL""")
def n16_voyage_hourly(t):
    out = profile.voyage_hourly(t("positions"))
    micro = lambda v: F.round(v * 1000000).cast("long").cast("string")
    line = F.array_join(F.transform("track", lambda p: F.concat(micro(p["lon"]), F.lit(" "), micro(p["lat"]))), ",")
    return out.select("bucket", "mmsi", "position_count", F.round("avg_sog", 4).alias("avg_sog"), "max_sog", F.size("track").cast("long").alias("vertices"), line.alias("track"))


# -- detectors ---------------------------------------------------------------------
_SCOPE = f"scope AS (SELECT * FROM positions WHERE epoch_us(reported_at) <= epoch_us({T}))"
_TAGGED = f"""{_SCOPE}, {inside_sql('scope', 'ports')},
tag AS (SELECT position_id, arg_min(id, (d, id)) AS port_id FROM (SELECT h.position_id, h.id, {metres('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS d FROM hit h JOIN scope p USING (position_id) JOIN ports q ON q.id = h.id) GROUP BY position_id),
t AS (SELECT s.*, tag.port_id FROM scope s LEFT JOIN tag USING (position_id)),
calls AS (SELECT mmsi, port_id, min(reported_at) AS a, max(reported_at) AS z, min(sog) AS min_sog, count(*) AS positions FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY reported_at, position_id) - row_number() OVER (PARTITION BY mmsi, port_id ORDER BY reported_at, position_id) AS g FROM t) GROUP BY mmsi, port_id, g),
seen AS (SELECT mmsi, max(reported_at) AS m FROM scope GROUP BY mmsi),
port_calls AS (SELECT c.mmsi, c.port_id, epoch_us(a) AS arrived_at, CASE WHEN m > z THEN epoch_us(z) END AS departed_at, min_sog, positions FROM calls c JOIN seen USING (mmsi) WHERE port_id IS NOT NULL AND epoch_us(z) - epoch_us(a) >= 900000000)"""


def _calls(t) -> DataFrame:
    return visits.port_calls(t("positions"), t("ports"), as_of=AS_OF, lookback=None)


@query(f"WITH {_TAGGED} SELECT * FROM port_calls")
def n1_port_calls(t):
    return _calls(t)


@query(f"""WITH {_SCOPE}, {inside_sql('scope', '(SELECT * FROM geofences WHERE active)')},
v AS (SELECT DISTINCT s.mmsi, h.id FROM hit h JOIN scope s USING (position_id)),
g AS (SELECT s.position_id, s.mmsi, s.reported_at, s.lon, s.lat, v.id, h.id IS NOT NULL AS i FROM scope s JOIN v USING (mmsi) LEFT JOIN hit h ON h.position_id = s.position_id AND h.id = v.id),
l AS (SELECT *, lag(i) OVER (PARTITION BY id, mmsi ORDER BY reported_at, position_id) AS w FROM g)
SELECT DISTINCT id AS geofence_id, mmsi, CASE WHEN i THEN 'enter' ELSE 'exit' END AS event_type, epoch_us(reported_at) AS occurred_at, lon, lat FROM l WHERE w IS NOT NULL AND w <> i""")
def n2_geofence_crossings(t):
    return visits.geofence_crossings(t("positions"), t("geofences"), as_of=AS_OF, lookback=None)


@query(f"""WITH {_SCOPE}, {inside_sql('scope', 'ports')},
slow AS (SELECT DISTINCT mmsi, epoch_us(reported_at) AS us, lon, lat, epoch_us(reported_at) // 300000000 AS b FROM scope WHERE sog < 5 AND abs(lat) <= 90 AND abs(lon) <= 180 AND position_id NOT IN (SELECT position_id FROM hit)),
y AS (SELECT *, b + unnest([-1, 0, 1]) AS bb FROM slow),
m AS (SELECT x.mmsi AS a, y.mmsi AS z, x.us, {metres('x.lon', 'x.lat', 'y.lon', 'y.lat')} AS d, (x.lon + y.lon) / 2 AS cx, (x.lat + y.lat) / 2 AS cy FROM slow x JOIN y ON x.b = y.bb AND x.mmsi < y.mmsi AND abs(x.us - y.us) <= 300000000 AND abs(x.lat - y.lat) < 0.02),
e AS (SELECT a, z, min(us) AS f, max(us) AS l, min(d) AS d, avg(cx) AS cx, avg(cy) AS cy FROM m WHERE d <= 1500 GROUP BY a, z HAVING max(us) - min(us) >= 600000000),
n AS (SELECT mmsi, lon, lat FROM scope QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY reported_at DESC, position_id DESC) = 1)
SELECT a AS mmsi_a, z AS mmsi_b, f AS started_at, CASE WHEN NOT {metres('p.lon', 'p.lat', 'q.lon', 'q.lat')} <= 1500 THEN l END AS ended_at, round(d, 2) AS min_distance, round(cx, 6) AS centroid_lon, round(cy, 6) AS centroid_lat FROM e JOIN n p ON p.mmsi = a JOIN n q ON q.mmsi = z""")
def n3_sts_events(t):
    out = visits.sts_events(t("positions"), t("ports"), as_of=AS_OF, lookback=None, max_speed_kn=5, max_distance_m=1500, min_duration="10m")
    return out.select("mmsi_a", "mmsi_b", "started_at", "ended_at", F.round(F.col("min_distance").cast("double"), 2).alias("min_distance"), F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


def _no_gaps(t) -> DataFrame:
    return t("positions").select("mmsi", F.col("reported_at").alias("resolved_at")).where("false")


@query(f"""WITH {_TAGGED}, l AS (SELECT mmsi, epoch_us(reported_at) AS us, lon, lat FROM scope WHERE epoch_us(reported_at) > epoch_us({T}) - 7 * 86400000000 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY reported_at DESC, position_id DESC) = 1)
SELECT mmsi, us AS last_position, CAST(floor((epoch_us({T}) - us) / 3.6e9) AS INT) AS gap_hours, lon AS last_lon, lat AS last_lat FROM l
WHERE us < epoch_us({T}) - 6 * 3600000000 AND us > epoch_us({T}) - 72 * 3600000000 AND mmsi NOT IN (SELECT mmsi FROM port_calls WHERE departed_at IS NULL)""")
def n4_detect_gaps(t):
    return visits.detect_gaps(t("positions"), _calls(t), _no_gaps(t), as_of=AS_OF)


_OPEN = """g AS (SELECT mmsi, reported_at AS lp, lon AS x, lat AS y FROM positions WHERE epoch_us(reported_at) <= epoch_us(TIMESTAMP '2024-01-10 12:00:00') QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY reported_at DESC, position_id DESC) = 1)"""


def _open_gaps(t) -> DataFrame:
    last = ingest.last_positions(t("positions").where(F.col("reported_at") <= F.lit("2024-01-10 12:00:00").cast("timestamp")))
    return last.select("mmsi", F.col("reported_at").alias("last_position"), F.col("lon").alias("last_lon"), F.col("lat").alias("last_lat"), F.lit(None).cast("timestamp").alias("resolved_at"))


@query(f"""WITH {_OPEN}, f AS (SELECT g.*, p.reported_at, p.lon, p.lat FROM g JOIN positions p ON p.mmsi = g.mmsi AND p.reported_at > g.lp AND epoch_us(p.reported_at) <= epoch_us({T}) QUALIFY row_number() OVER (PARTITION BY g.mmsi ORDER BY p.reported_at, p.position_id) = 1)
SELECT mmsi, epoch_us(lp) AS last_position, epoch_us(reported_at) AS resolved_at, CASE WHEN {metres('x', 'y', 'lon', 'lat')} > 50000 THEN 'reappeared_far' ELSE 'reappeared_same_area' END AS resolution FROM f""")
def n5_resolve_gaps(t):
    return visits.resolve_gaps(_open_gaps(t), t("positions"), as_of=AS_OF)


@query(f"""WITH {_SCOPE}, l AS (SELECT mmsi, reported_at AS z, lag(reported_at) OVER (PARTITION BY mmsi ORDER BY reported_at, position_id) AS a FROM scope)
SELECT mmsi, epoch_us(a) AS gap_from, epoch_us(z) AS gap_to FROM l WHERE epoch_us(z) - epoch_us(a) > 3600000000""")
def n6_position_gaps(t):
    return visits.position_gaps(t("positions"), as_of=AS_OF, lookback=None)


@query(f"WITH {inside_sql('positions', 'geofences')} SELECT position_id, CAST(id AS BIGINT) AS region_id FROM hit JOIN positions USING (position_id) WHERE abs(lat) <= 90 AND abs(lon) <= 180")
def n33_zones_at(t):
    return containing(t("positions"), cut(coverage(t("geofences"))), "position_id")


# -- profiles ----------------------------------------------------------------------
@query(f"""WITH s AS (SELECT mmsi, CAST((49 * (floor(least(greatest(lat, -90), 89.999) + 90) * 360 + floor(least(greatest(lon, -180), 179.999) + 180))) AS BIGINT) % 64 AS b FROM positions WHERE epoch_us(reported_at) <= epoch_us({T}) AND epoch_us(reported_at) > epoch_us({T}) - 7 * 86400000000),
c AS (SELECT mmsi, b, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT mmsi, sum(n) AS m, sqrt(sum(n * n)) AS l FROM c GROUP BY mmsi HAVING sum(n) >= 50)
SELECT c.mmsi, CAST(b AS INT) AS bucket, round(n / l, 4) AS weight, CAST(m AS BIGINT) AS position_count FROM c JOIN q USING (mmsi)""")
def n7_trajectory_embeddings(t):
    out = profile.trajectory_embeddings(t("positions"), as_of=AS_OF)
    return out.select("mmsi", F.posexplode("embedding").alias("bucket", "w"), "position_count").where("w > 0").select("mmsi", "bucket", F.round(F.col("w").cast("double"), 4).alias("weight"), "position_count")


def _vectors(t) -> DataFrame:
    e = t("embeddings")
    return e.select(F.col("label").cast("long").alias("mmsi"), F.timestamp_seconds("vec_id").alias("window_start"), "embedding", F.lit("gridcell_v1").alias("method"))


@query("""WITH l AS (SELECT label, max(vec_id) AS v FROM embeddings GROUP BY label), n AS (SELECT e.label, e.vec_id, e.embedding FROM embeddings e JOIN l ON l.label = e.label AND l.v = e.vec_id)
SELECT CAST(n.label AS BIGINT) AS mmsi, round(least(avg(1 - list_cosine_similarity(CAST(h.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[]))), 1), 4) AS score, count(*) AS history_windows
FROM n JOIN embeddings h ON h.label = n.label AND h.vec_id < n.vec_id GROUP BY n.label""")
def n8_anomaly_scores(t):
    out = profile.anomaly_scores(_vectors(t), as_of=AS_OF)
    return out.select("mmsi", F.round(F.col("score").cast("double"), 4).alias("score"), "history_windows")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(q.e, b.e), 9) AS s FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, key, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, key) <= 10""")
def n9_similar_vessels(t):
    e = t("embeddings")
    out = profile.nearest(e.where("vec_id % 20 = 0"), e, key="vec_id", vector="embedding")
    return out.select("query", "key", F.round("similarity", 6).alias("similarity"), "rank")


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def grams(column: str) -> str:
    return _GRAMS.format(column)


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE))"


def _listed(t) -> DataFrame:
    listed = t("ports").select(F.col("id").alias("ent_num"), F.col("name").alias("sdn_name"), F.col("un_locode").alias("call_sign"))
    return similar_text.watch_list_matches(t("vessels"), listed, as_of=AS_OF, threshold=0.15)


@query(f"""WITH a AS (SELECT mmsi, name, call_sign, {grams('name')} AS g FROM vessels), b AS (SELECT id, name, un_locode, {grams('name')} AS h FROM ports),
s AS (SELECT mmsi, id, CASE WHEN call_sign <> '' AND call_sign = un_locode THEN 1.0 WHEN len(g) > 0 AND len(h) > 0 THEN {jaccard('g', 'h')} ELSE 0 END AS s FROM a JOIN b ON true)
SELECT mmsi, CAST(id AS VARCHAR) AS reference, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 5) AS match_score FROM s WHERE s > 0.15""")
def n10_sanctions_matches(t):
    return _listed(t).select("mmsi", "reference", F.round(F.col("match_score").cast("double"), 5).alias("match_score"))


_DEST = f"""d AS (SELECT DISTINCT destination FROM messages0), nrm AS (SELECT destination, upper(trim(destination)) AS n FROM d),
tl AS (SELECT destination, list_concat(list_filter(string_split_regex(n, '[^A-Z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({hints.STOP!r}, w)), [regexp_replace(n, '[^A-Z0-9]', '', 'g')]) AS l FROM nrm WHERE n NOT IN ({', '.join(f"'{j}'" for j in hints.JUNK)})),
tk AS (SELECT destination, l, unnest(range(1, len(l) + 1)) AS i FROM tl), tok AS (SELECT destination, l[i] AS token, min(i) AS pos FROM tk WHERE l[i] <> '' GROUP BY ALL),
u AS (SELECT DISTINCT token, {grams('token')} AS g FROM tok), pg AS (SELECT id, name, un_locode, {grams('name')} AS h FROM ports),
c1 AS (SELECT token, 0.95 AS c, min(id) AS port_id, 0 AS probe FROM u JOIN ports ON upper(un_locode) = token WHERE length(token) = 5 GROUP BY token),
c2 AS (SELECT token, c, id AS port_id, 1 AS probe FROM (SELECT token, id, name, {jaccard('g', 'h')} AS c FROM u JOIN pg ON len(list_intersect(g, h)) > 0) WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY token ORDER BY c DESC, length(name), id) = 1),
c3 AS (SELECT token, 0.75 AS c, arg_min(id, (length(name), id)) AS port_id, 2 AS probe FROM u JOIN ports ON name ILIKE '%' || array_to_string(string_split(token, ''), '%') || '%' WHERE length(token) BETWEEN 3 AND 6 AND length(token) - length(translate(token, 'AEIOU', '')) <= 1 GROUP BY token),
best AS (SELECT destination, c, port_id FROM tok JOIN (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) USING (token) QUALIFY row_number() OVER (PARTITION BY destination ORDER BY c DESC, pos, probe) = 1)"""


@query(f"""WITH {DECODED.replace('messages AS', 'messages1 AS')}, messages0 AS (SELECT DISTINCT mmsi, trim(destination) AS destination FROM messages1 WHERE id IN (SELECT id FROM raw_messages WHERE message_type = 5 AND epoch_us(received_at) <= epoch_us({T})) AND trim(destination) <> ''), {_DEST}
SELECT mmsi, destination, best.port_id, round(coalesce(best.c, 0), 5) AS confidence FROM messages0 LEFT JOIN best USING (destination)""")
def n11_destination_hints(t):
    out = hints.destination_hints(t("raw_messages"), t("ports"), as_of=AS_OF, lookback=None)
    return out.select("mmsi", "destination", "port_id", F.round(F.col("confidence").cast("double"), 5).alias("confidence"))


@query()
def n12_resolve_operators(t):
    names = t("vessels").where("name is not null").select("name", F.col("mmsi").alias("seq"))
    return resolution.resolve_operators(names, t("operators"))


_TREE = "RECURSIVE d(root_id, id, depth) AS (SELECT id, id, 0 FROM operators UNION ALL SELECT d.root_id, o.id, d.depth + 1 FROM d JOIN operators o ON o.parent_id = d.id WHERE d.depth < 10)"


@query(f"WITH {_TREE} SELECT d.root_id, v.mmsi, v.name, o.canonical AS operator, d.depth FROM d JOIN vessel_operators e ON e.operator_id = d.id JOIN operators o ON o.id = d.id JOIN vessels v ON v.mmsi = e.mmsi")
def n13_vessels_by_group(t):
    return graph.vessels_by_group(t("operators"), t("vessel_operators"), t("vessels"))


@query("""WITH RECURSIVE u(start_id, id, up) AS (SELECT id, id, 0 FROM operators UNION ALL SELECT u.start_id, o.parent_id, u.up + 1 FROM u JOIN operators o ON o.id = u.id WHERE o.parent_id IS NOT NULL AND u.up < 10),
m AS (SELECT start_id, max(up) AS t FROM u GROUP BY start_id) SELECT start_id, u.id, o.canonical, m.t - u.up AS depth FROM u JOIN m USING (start_id) JOIN operators o ON o.id = u.id""")
def n13_ancestor_chain(t):
    return graph.ancestor_chain(t("operators"))


@query("""WITH w AS (SELECT mmsi, name, call_sign, flag_country, unnest(regexp_extract_all(lower(coalesce(name, '')), '[\\p{L}\\p{N}]+')) AS l, 1.0 AS x FROM vessels
UNION ALL SELECT mmsi, name, call_sign, flag_country, unnest(regexp_extract_all(lower(coalesce(call_sign, '')), '[\\p{L}\\p{N}]+')), 0.4 FROM vessels
UNION ALL SELECT mmsi, name, call_sign, flag_country, unnest(regexp_extract_all(lower(coalesce(flag_country, '')), '[\\p{L}\\p{N}]+')), 0.2 FROM vessels)
SELECT mmsi, name, call_sign, flag_country, round(CAST(sum(x) AS DOUBLE), 4) AS rank FROM w WHERE l LIKE 'qm%' GROUP BY ALL ORDER BY rank DESC, mmsi LIMIT 50""")
def n15_vessel_search(t):
    return profile.vessel_search(t("vessels"), "QM").withColumn("rank", F.round("rank", 4))


# -- feeds -------------------------------------------------------------------------
@query(f"""WITH {_SCOPE}, l AS (SELECT mmsi, lon, lat FROM positions QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY reported_at DESC, position_id DESC) = 1),
o AS (SELECT e.mmsi, count(*) AS n, min(o.canonical) AS f FROM vessel_operators e JOIN operators o ON o.id = e.operator_id GROUP BY e.mmsi),
w AS (SELECT mmsi, count(*) AS entries, min(reference) AS reference FROM ({ORACLES["n10_sanctions_matches"]}) GROUP BY mmsi),
a AS (SELECT mmsi, max(epoch_us(reported_at)) % 1000 / 1000.0 AS score FROM positions GROUP BY mmsi)
SELECT v.mmsi, v.name, l.lon, l.lat, o.n AS operators, o.f AS first_operator, w.entries, w.reference, a.score AS anomaly_score FROM vessels v LEFT JOIN l USING (mmsi) LEFT JOIN o USING (mmsi) LEFT JOIN w USING (mmsi) LEFT JOIN a USING (mmsi)""")
def n22_vessel_detail(t):
    scores = t("positions").select("mmsi", F.col("reported_at").alias("computed_at"), (F.unix_micros("reported_at") % 1000 / 1000.0).alias("score"))  # a score per fix, of which the latest is shown
    out = feeds.vessel_detail(t("vessels"), ingest.last_positions(t("positions")), _listed(t), t("vessel_operators"), t("operators"), scores)
    return out.select("mmsi", "name", F.col("last_position.lon").alias("lon"), F.col("last_position.lat").alias("lat"), F.when(F.col("operators").isNotNull(), F.size("operators")).cast("long").alias("operators"), F.col("operators")[0]["operator"].alias("first_operator"), F.when(F.col("sanctions").isNotNull(), F.size("sanctions")).cast("long").alias("entries"), F.array_min(F.transform("sanctions", lambda x: x["reference"])).alias("reference"), "anomaly_score")


@query("""SELECT lon, lat, sog, cog, heading, nav_status, epoch_us(reported_at) AS reported_at FROM positions WHERE mmsi = 799990017 AND epoch_us(reported_at) BETWEEN epoch_us(TIMESTAMP '2024-01-03 00:00:00') AND epoch_us(TIMESTAMP '2024-01-04 00:00:00')
ORDER BY positions.reported_at, position_id LIMIT 500""")
def n23_vessel_track(t):
    return feeds.vessel_track(t("positions"), 799990017, start="2024-01-03 00:00:00", end="2024-01-04 00:00:00")


@query("SELECT id, name, country, un_locode, lon, lat FROM ports WHERE name ILIKE '%haven%' AND country = 'QR' ORDER BY name, id LIMIT 100")
def n24_port_lookup(t):
    return feeds.port_lookup(t("ports"), search="haven", country="QR")


@query(f"WITH {_TAGGED} SELECT c.mmsi, v.name AS vessel_name, c.port_id, arrived_at, departed_at, positions FROM port_calls c LEFT JOIN vessels v USING (mmsi) ORDER BY arrived_at DESC, c.mmsi, c.port_id LIMIT 50")
def n25_recent_calls(t):
    return feeds.recent_calls(_calls(t), t("vessels"))


@query("SELECT id, name, description, polygon, epoch_us(created_at) AS created_at, active FROM geofences")
def n26_list_geofences(t):
    return feeds.list_geofences(t("geofences"))


def _alerts(t, **kw) -> DataFrame:
    p = t("positions")
    crossings = visits.geofence_crossings(p, t("geofences"), as_of=AS_OF, lookback=None)
    gaps = visits.detect_gaps(p, _calls(t), _no_gaps(t), as_of=AS_OF)
    sts = visits.sts_events(p, t("ports"), as_of=AS_OF, lookback=None, max_speed_kn=5, max_distance_m=1500, min_duration="10m")
    return feeds.alerts(crossings, gaps, sts, _listed(t), **kw)


@query(f"""SELECT * FROM (SELECT 'geofence' AS type, mmsi, occurred_at AS "at" FROM ({ORACLES["n2_geofence_crossings"]}) UNION ALL SELECT 'gap', mmsi, last_position FROM ({ORACLES["n4_detect_gaps"]})
UNION ALL SELECT 'sts', mmsi_a, started_at FROM ({ORACLES["n3_sts_events"]}) UNION ALL SELECT 'sanctions', mmsi, epoch_us({T}) FROM ({ORACLES["n10_sanctions_matches"]}))
WHERE "at" > epoch_us(TIMESTAMP '2024-01-11 12:00:00') ORDER BY "at" DESC, type, mmsi LIMIT 100""")
def n27_alerts(t):
    return _alerts(t, since="2024-01-11 12:00:00").select("type", "mmsi", "at")


@query(ORACLES["n4_detect_gaps"] + " ORDER BY last_position DESC, mmsi LIMIT 100")
def n28_gap_feed(t):
    gaps = visits.detect_gaps(t("positions"), _calls(t), _no_gaps(t), as_of=AS_OF)
    return feeds.gap_feed(gaps, since="2024-01-05 12:00:00")


_BOXES = [("north", -180.0, 0.0, 180.0, 90.0), ("west", 0.0, 10.0, -60.0, -60.0), ("small", -38.5, -39.5, -38.0, -39.0)]


@query(f"""SELECT s.subscriber, p.position_id FROM positions p JOIN (VALUES {', '.join(f"('{n}', {min(a, c)}, {max(a, c)}, {min(b, d)}, {max(b, d)})" for n, a, b, c, d in _BOXES)}) s(subscriber, xa, xb, ya, yb) ON p.lon BETWEEN xa AND xb AND p.lat BETWEEN ya AND yb""")
def n29_live_feed(t):
    p = t("positions")
    subs = p.sparkSession.createDataFrame(_BOXES, "subscriber string, lon1 double, lat1 double, lon2 double, lat2 double")
    return feeds.live_feed(p.select("position_id", "lon", "lat"), subs).select("subscriber", "position_id")


@query(f"""WITH {_SCOPE}, {inside_sql('scope', '(SELECT * FROM geofences WHERE active)')}, e AS (SELECT p.mmsi, CAST(h.id AS VARCHAR) AS payload FROM hit h JOIN scope p USING (position_id))
SELECT 'all' AS adapter, 'geofence' AS channel, mmsi, payload FROM e UNION ALL SELECT 'ferry', 'geofence', mmsi, payload FROM e WHERE mmsi = 799990017""")
def n30_route_alerts(t):
    p = t("positions").where(F.col("reported_at") <= F.lit(AS_OF).cast("timestamp"))
    held = containing(p, cut(coverage(t("geofences").where("active"))), "position_id").join(p.select("position_id", "mmsi"), "position_id")
    events = held.select(F.lit("geofence").alias("channel"), "mmsi", F.col("region_id").cast("string").alias("payload"))
    subs = p.sparkSession.createDataFrame([("all", [], []), ("ferry", ["geofence"], [799990017]), ("gaps", ["gap"], [])], "adapter string, channels array<string>, mmsis array<long>")
    return feeds.route_alerts(events, subs)


@query("""WITH b AS (SELECT mmsi, name, ship_type FROM vessels WHERE epoch_us(first_seen_at) < epoch_us(TIMESTAMP '2024-01-08 00:00:00')), a AS (SELECT mmsi, CASE WHEN ship_type = 70 THEN 'X' ELSE name END AS name, ship_type FROM vessels WHERE ship_type <> 80)
SELECT coalesce(a.mmsi, b.mmsi) AS mmsi, CASE WHEN a.mmsi IS NULL THEN b.name ELSE a.name END AS name, CAST(CASE WHEN a.mmsi IS NULL THEN b.ship_type ELSE a.ship_type END AS INT) AS ship_type, CASE WHEN b.mmsi IS NULL THEN 'I' WHEN a.mmsi IS NULL THEN 'D' ELSE 'U' END AS action FROM a FULL JOIN b ON a.mmsi = b.mmsi WHERE a.mmsi IS NULL OR b.mmsi IS NULL OR a.name IS DISTINCT FROM b.name OR a.ship_type IS DISTINCT FROM b.ship_type""")
def n31_change_feed(t):
    v = t("vessels")
    before = v.where(F.col("first_seen_at") < F.lit("2024-01-08 00:00:00").cast("timestamp")).select("mmsi", "name", "ship_type")
    after = v.where("ship_type <> 80").select("mmsi", F.when(F.col("ship_type") == 70, "X").otherwise(F.col("name")).alias("name"), "ship_type")
    out = feeds.change_feed(before, after, ["mmsi"], table="vessels")
    return out.select(F.get_json_object("data", "$.mmsi").cast("long").alias("mmsi"), F.get_json_object("data", "$.name").alias("name"), F.get_json_object("data", "$.ship_type").cast("int").alias("ship_type"), "action")


# -- further reads ------------------------------------------------------------------
@query("""WITH l AS (SELECT label, arg_max(CAST(embedding AS DOUBLE[]), vec_id) AS e FROM embeddings GROUP BY label), g AS (SELECT e AS target FROM l WHERE label = 3)
SELECT CAST(label AS BIGINT) AS mmsi, 'v' || CAST(label AS VARCHAR) AS name, round(list_cosine_similarity(e, target), 6) AS similarity FROM l, g WHERE label <> 3 ORDER BY list_cosine_similarity(e, target) DESC, label LIMIT 10""")
def n9_similar_to_one(t):
    vessels = t("embeddings").select(F.col("label").cast("long").alias("mmsi"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("name")).distinct()
    return profile.similar_vessels(_vectors(t), vessels, 3).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT * FROM ({ORACLES['n3_sts_events']}) WHERE started_at > epoch_us(TIMESTAMP '2024-01-03 00:00:00') ORDER BY started_at DESC, mmsi_a, mmsi_b LIMIT 100")
def n34_sts_feed(t):
    out = feeds.sts_feed(visits.sts_events(t("positions"), t("ports"), as_of=AS_OF, lookback=None, max_speed_kn=5, max_distance_m=1500, min_duration="10m"), since="2024-01-03 00:00:00")
    return out.select("mmsi_a", "mmsi_b", "started_at", "ended_at", F.round(F.col("min_distance").cast("double"), 2).alias("min_distance"), F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


@query(f"SELECT mmsi, event_type, occurred_at, lon, lat FROM ({ORACLES['n2_geofence_crossings']}) WHERE geofence_id = 7 ORDER BY occurred_at DESC, mmsi, event_type LIMIT 100")
def n35_geofence_history(t):
    return feeds.geofence_history(visits.geofence_crossings(t("positions"), t("geofences"), as_of=AS_OF, lookback=None), 7)


_NEW = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'


@query(f"""SELECT id, name, description, polygon, epoch_us(created_at) AS created_at, active FROM geofences UNION ALL SELECT CAST(max(id) + 1 AS INT), 'new', NULL, '{_NEW}', epoch_us({T}), true FROM geofences""")
def n36_create_geofence(t):
    return feeds.create_geofence(t("geofences"), "new", _NEW, created_at=AS_OF)


_EARLIER = "TIMESTAMP '2024-01-08 00:00:00'"
_OLD_CALLS = ORACLES["n1_port_calls"].replace(f"epoch_us({T})", f"epoch_us({_EARLIER})")


@query(f"""WITH o AS ({_OLD_CALLS}), n AS ({ORACLES["n1_port_calls"]})
SELECT mmsi, port_id, arrived_at, CASE WHEN n.positions IS NULL THEN o.departed_at ELSE n.departed_at END AS departed_at, least(o.min_sog, n.min_sog) AS min_sog, coalesce(n.positions, o.positions) AS positions FROM o FULL JOIN n USING (mmsi, port_id, arrived_at)""")
def n37_reconcile_calls(t):
    old = visits.port_calls(t("positions"), t("ports"), as_of="2024-01-08 00:00:00", lookback=None)
    return visits.reconcile_calls(old, _calls(t))


@query("""SELECT 'U' AS action, 'vessels' AS "table", CAST(mmsi AS VARCHAR) AS mmsi, name FROM vessels""")
def n38_decode_changes(t):
    cell = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
    entry = lambda name: F.to_json(F.struct(F.lit("U").alias("action"), F.lit("public").alias("schema"), F.lit(name).alias("table"), F.array(cell("mmsi"), cell("name")).alias("columns")))
    log = t("vessels").select(F.explode(F.array(entry("vessels"), entry("other"), F.lit("no entry"))).alias("value"))
    out = feeds.decode_changes(log, ["vessels"])
    return out.select("action", "table", F.col("data")["mmsi"].alias("mmsi"), F.col("data")["name"].alias("name"))
