"""Read-side queries: profiles, tracks, look-ups, feeds, live delivery and change feeds.

All orderings are total (a key breaks ties). Page sizes are positive and at most 500.
Defined results: unset filters filter nothing; unknown keys give empty results; null
sides of optional joins stay null; empty in, empty out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.timeline import latest

MOST_ROWS = 500


def page(limit: int | str | None, default: int) -> int:
    """A page size: the default unless a positive number is asked for, never over 500."""
    try:
        n = int(limit) if limit is not None else default
    except ValueError:
        n = default
    return min(n if n > 0 else default, MOST_ROWS)


def vessel_detail(vessels: DataFrame, last_positions: DataFrame, sanctions: DataFrame, edges: DataFrame, operators: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One nested row per vessel: last position, watch-list entries, operators, latest anomaly."""
    pos = last_positions.select("mmsi", F.struct("reported_at", "lon", "lat", "sog", "cog", "heading", "nav_status").alias("last_position"))
    listed = sanctions.groupBy("mmsi").agg(F.array_sort(F.collect_list(F.struct("program", "reference", "match_score"))).alias("sanctions"))
    named = edges.join(operators.select(F.col("id").alias("operator_id"), F.col("canonical").alias("operator")), "operator_id")
    owned = named.groupBy("mmsi").agg(F.array_sort(F.collect_list(F.struct("operator", "role"))).alias("operators"))
    odd = latest(anomalies.select("mmsi", "computed_at", "score"), ["mmsi"], ["computed_at"]).select("mmsi", F.col("score").alias("anomaly_score"))
    out = vessels
    for side in (pos, listed, owned, odd):
        out = out.join(side, "mmsi", "left")
    return out


def vessel_track(positions: DataFrame, mmsi: int, *, start: str, end: str, limit: int | None = None) -> DataFrame:
    """The oldest fixes of a vessel in the closed range, in order."""
    rows = positions.where((F.col("mmsi") == mmsi) & F.col("reported_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    cols = ["lon", "lat", "sog", "cog", "heading", "nav_status", "reported_at"]
    return rows.orderBy("reported_at", "position_id").limit(page(limit, MOST_ROWS)).select(*cols)


def port_lookup(ports: DataFrame, *, search: str | None = None, country: str | None = None, limit: int | None = None) -> DataFrame:
    rows = ports
    if search:
        rows = rows.where(F.col("name").ilike(f"%{search}%"))
    if country:
        rows = rows.where(F.col("country") == country)
    return rows.orderBy("name", "id").limit(page(limit, 100)).select("id", "name", "country", "un_locode", "lon", "lat")


def recent_calls(port_calls: DataFrame, vessels: DataFrame, port_id: int | None = None, *, limit: int | None = None) -> DataFrame:
    rows = port_calls if port_id is None else port_calls.where(F.col("port_id") == port_id)
    named = rows.join(vessels.select("mmsi", F.col("name").alias("vessel_name")), "mmsi", "left")
    return named.orderBy(F.desc("arrived_at"), "mmsi", "port_id").limit(page(limit, 50)).select("mmsi", "vessel_name", "port_id", "arrived_at", "departed_at", "positions")


def list_geofences(geofences: DataFrame) -> DataFrame:
    return geofences.orderBy("id").select("id", "name", "description", "polygon", "created_at", "active")


def valid_polygon(geojson: str) -> list:
    """Rings of a GeoJSON Polygon; raises unless every ring is closed, has four points and
    lies on the map."""
    try:
        shape = json.loads(geojson)
    except (TypeError, ValueError) as e:
        raise ValueError("polygon is no JSON") from e
    rings = shape.get("coordinates") if isinstance(shape, dict) and shape.get("type") == "Polygon" else None
    if not rings:
        raise ValueError("a Polygon with coordinates is needed")
    for ring in rings:
        if not isinstance(ring, list) or len(ring) < 4 or ring[0] != ring[-1]:
            raise ValueError("a ring must be closed and have at least four points")
        for p in ring:
            if not (isinstance(p, list) and len(p) >= 2 and abs(p[0]) <= 180 and abs(p[1]) <= 90):
                raise ValueError("a point lies off the map")
    return rings


def create_geofence(geofences: DataFrame, name: str, polygon: str, description: str | None = None, *, created_at: str) -> DataFrame:
    """The table with one more active fence, numbered after the highest id."""
    if not name:
        raise ValueError("a name is needed")
    valid_polygon(polygon)
    new = geofences.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id")).select("id", F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.lit(polygon).alias("polygon"), F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(True).alias("active"))
    return geofences.select(*new.columns).unionByName(new)


def geofence_history(events: DataFrame, geofence_id: int, *, limit: int | None = None) -> DataFrame:
    return events.where(F.col("geofence_id") == geofence_id).orderBy(F.desc("occurred_at"), "mmsi", "event_type").limit(page(limit, 100)).select("mmsi", "event_type", "occurred_at", "lon", "lat")


def alerts(geofence_events: DataFrame, gaps: DataFrame, sts: DataFrame, sanctions: DataFrame, *, since: str, type: str | None = None, limit: int | None = None) -> DataFrame:
    """(type, mmsi, at, detail) of four event tables, newest first; a type prunes the others."""
    detail = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]), {"ignoreNullFields": "false"})
    c = F.col
    branches = {
        "geofence": (geofence_events, c("mmsi"), c("occurred_at"), detail(geofence_id=c("geofence_id"), event=c("event_type"))),
        "gap": (gaps, c("mmsi"), c("last_position"), detail(gap_hours=c("gap_hours"))),
        "sts": (sts, c("mmsi_a"), c("started_at"), detail(mmsi_b=c("mmsi_b"), min_distance=c("min_distance"))),
        "sanctions": (sanctions, c("mmsi"), c("matched_at"), detail(program=c("program"), reference=c("reference"))),
    }
    out = None
    for name, (df, mmsi, at, text) in branches.items():
        if type in (None, "", name):
            part = df.select(F.lit(name).alias("type"), mmsi.alias("mmsi"), at.alias("at"), text.alias("detail")).where(F.col("at") > F.lit(since).cast("timestamp"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no alerts of type {type}")
    return out.orderBy(F.desc("at"), "type", "mmsi", "detail").limit(page(limit, 100))


def sts_feed(sts: DataFrame, *, since: str, limit: int | None = None) -> DataFrame:
    return sts.where(F.col("started_at") > F.lit(since).cast("timestamp")).orderBy(F.desc("started_at"), "mmsi_a", "mmsi_b").limit(page(limit, 100))


def gap_feed(gaps: DataFrame, *, since: str, resolved: bool | None = None, limit: int | None = None) -> DataFrame:
    rows = gaps.where(F.col("last_position") > F.lit(since).cast("timestamp"))
    if resolved is not None:
        rows = rows.where(F.col("resolved_at").isNotNull() == F.lit(resolved))
    return rows.orderBy(F.desc("last_position"), "mmsi").limit(page(limit, 100))


def in_box(lon: Column, lat: Column, a: str = "lon1", b: str = "lat1", c: str = "lon2", d: str = "lat2") -> Column:
    """Whether a point lies in a box given by two opposite corners, edges included."""
    x1, x2, y1, y2 = F.least(a, c), F.greatest(a, c), F.least(b, d), F.greatest(b, d)
    return (lon >= x1) & (lon <= x2) & (lat >= y1) & (lat <= y2)


def live_feed(fixes: DataFrame, subscriptions: DataFrame, *, cell: float = 1.0) -> DataFrame:
    """Every fix for every subscriber whose box (lon1, lat1, lon2, lat2) holds it.

    Boxes are cut into grid cells and meet the fixes by cell, so nothing is compared with
    everything; a box larger than 4096 cells enters a coarser grid."""
    s = subscriptions.select(
        "subscriber", F.least("lon1", "lon2").alias("_x1"), F.greatest("lon1", "lon2").alias("_x2"), F.least("lat1", "lat2").alias("_y1"), F.greatest("lat1", "lat2").alias("_y2")
    )
    big = ((F.col("_x2") - F.col("_x1")) / cell + 1) * ((F.col("_y2") - F.col("_y1")) / cell + 1) > 4096
    s = s.withColumn("_size", F.when(big, 16 * cell).otherwise(cell))
    at = lambda v: F.floor(v / F.col("_size"))
    s = s.withColumn("_cx", F.explode(F.sequence(at(F.col("_x1")), at(F.col("_x2"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("_y1")), at(F.col("_y2")))))
    f = fixes.drop("subscriber").withColumn("_size", F.explode(F.array(F.lit(cell), F.lit(16 * cell)))).withColumns({"_cx": at(F.col("lon")), "_cy": at(F.col("lat"))})
    met = f.join(s, ["_size", "_cx", "_cy"]).where(F.col("lon").between(F.col("_x1"), F.col("_x2")) & F.col("lat").between(F.col("_y1"), F.col("_y2")))
    return met.select("subscriber", *[c for c in fixes.columns if c != "subscriber"])


def route_alerts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(adapter, channel, mmsi, payload): every event for every subscription whose channels
    and movers (empty: all) hold it. Meets by channel and mover keys, wildcards included."""
    any_c, any_m = F.array(F.lit("*")), F.array(F.lit(-1).cast("long"))
    keys = subscriptions.select(
        "adapter",
        F.explode(F.when(F.size("channels") == 0, any_c).otherwise(F.array_distinct("channels"))).alias("kc"),
        F.when(F.size("mmsis") == 0, any_m).otherwise(F.array_distinct("mmsis")).alias("ms"),
    ).select("adapter", "kc", F.explode("ms").alias("km"))
    probe = events.select("channel", "mmsi", "payload").withColumn("kc", F.explode(F.array(F.col("channel"), F.lit("*")))).withColumn("km", F.explode(F.array(F.coalesce("mmsi", F.lit(-2).cast("long")), F.lit(-1).cast("long"))))
    return probe.join(keys, ["kc", "km"]).select("adapter", "channel", "mmsi", "payload")


def change_feed(before: DataFrame, after: DataFrame, key: list[str], *, table: str, schema: str = "public") -> DataFrame:
    """(action, schema, table, data) between two versions of a table: I, U or D per key."""
    cols = [c for c in after.columns if c not in key]
    pack = lambda df, n: df.select(*key, F.struct(*[F.col(c) for c in cols]).alias(n))
    both = pack(before, "_old").join(pack(after, "_new"), key, "full")
    action = F.when(F.col("_old").isNull(), "I").when(F.col("_new").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("_new")), "U")
    row = F.coalesce("_new", "_old")
    data = F.to_json(F.struct(*key, *[row[c].alias(c) for c in cols]), {"ignoreNullFields": "false"})
    return both.select(action.alias("action"), F.lit(schema).alias("schema"), F.lit(table).alias("table"), data.alias("data")).where("action is not null")


def decode_changes(log: DataFrame, tables: list[str], column: str = "value") -> DataFrame:
    """Row changes of the given tables in a logical-decoding log; other entries are passed over."""
    entry = F.from_json(column, "action string, `schema` string, `table` string, columns array<struct<name:string,value:string>>, identity array<struct<name:string,value:string>>")
    rows = log.select(entry.alias("e")).where(F.col("e.action").isin("I", "U", "D") & F.col("e.table").isin(*tables))
    cells = F.coalesce("e.columns", "e.identity")
    return rows.select("e.action", "e.schema", "e.table", F.map_from_entries(F.coalesce(cells, F.array().cast("array<struct<name:string,value:string>>"))).alias("data"))
