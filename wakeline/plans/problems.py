"""The queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.io import table
from wakeline.operators import containment, late_counts, message_store, proximity, spikes, stops
from wakeline.plans.reference import BODY, MOMENT, inside_sql, micros
from wakeline.workspace import cut


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return message_store.further_copies(table(spark, folder, "raw_messages"))


def p1_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    kept = message_store.deduplicated(table(spark, folder, "raw_messages"))
    return micros(kept.select("id", "source", "message_type", "mmsi", "received_at", "reported_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.bad_readings(table(spark, folder, "positions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_counts.amended(_late_state(spark, folder))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return late_counts.counts(_late_state(spark, folder))


#: Batches, in order of arrival, whose states make up the late counts.
BATCHES = 4


def _late_state(spark: SparkSession, folder: str) -> DataFrame:
    first = message_store.deduplicated(table(spark, folder, "raw_messages"))
    first = cut(first.select("id", "mmsi", "source", "reported_at", "received_at"))
    low, high = first.agg(F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    batch = F.expr(f"(id - {low}) div {(high - low) // BATCHES + 1}")
    return late_counts.merge(*[late_counts.cells(first.where(batch == k), batch=k) for k in range(BATCHES)])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    positions = table(spark, folder, "positions")
    within = containment.positions_in_regions(positions, table(spark, folder, "geofences"))
    near = proximity.near_pairs(positions)
    return within.select(
        F.lit("inside").alias("kind"), F.col("position_id").alias("key_a"), F.col("region_id").alias("key_b")
    ).unionByName(near.select(F.lit("near").alias("kind"), "key_a", "key_b"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = stops.stops_and_trips(table(spark, folder, "positions"))
    return found.select(
        "mmsi", F.expr("start_us div 1000000").alias("started_at"), F.expr("end_us div 1000000").alias("ended_at")
    )


def p6_trips(spark: SparkSession, folder: str) -> DataFrame:
    _, trips = stops.stops_and_trips(table(spark, folder, "positions"))
    return trips.select(
        "mmsi", F.expr("start_us div 1000000").alias("started_at"), F.expr("end_us div 1000000").alias("ended_at"),
        F.round("duration_s", 3).alias("duration_s"), F.round("distance_m", 1).alias("distance_m"),
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_deduplicated, p2_found, p4_found, p4_counts, p5_found, p6_found, p6_trips)
}

#: Every message with its identity spelled out: vessel, type, moment of report and the inner
#: message as sorted paths with numbers by value.
_IDENTITY = f"""m AS (SELECT id, mmsi, message_type, source, reported_at, received_at, {BODY} AS b, {MOMENT} AS us FROM raw_messages),
c AS (SELECT m.id AS mid, string_agg(t.fullkey || '=' || coalesce(CASE WHEN t.type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || CAST(t.atom AS VARCHAR) END, t.type), ';' ORDER BY t.fullkey) AS content FROM m, json_tree(m.b) AS t GROUP BY m.id),
k AS (SELECT m.*, row_number() OVER (PARTITION BY mmsi, message_type, us, content ORDER BY id) AS copy FROM m JOIN c ON c.mid = m.id)"""
_LATE = """h AS (SELECT mmsi, epoch_us(received_at) AS r, epoch_us(coalesce(reported_at, received_at)) // 3600000000 * 3600 AS hour_start FROM k WHERE copy = 1),
l AS (SELECT mmsi, hour_start, count(*) FILTER (r < (hour_start + 3900) * 1000000) AS published, count(*) AS corrected FROM h WHERE r < (hour_start + 25200) * 1000000 GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_IDENTITY} SELECT id FROM k WHERE copy > 1",
    "p1_deduplicated": f"WITH {_IDENTITY} SELECT id, source, message_type, mmsi, epoch_us(received_at) AS received_at, epoch_us(reported_at) AS reported_at FROM k WHERE copy = 1",
    "p4_found": f"WITH {_IDENTITY}, {_LATE} SELECT mmsi, hour_start FROM l WHERE corrected > published",
    "p4_counts": f"WITH {_IDENTITY}, {_LATE} SELECT mmsi, hour_start, published, corrected FROM l",
    "p5_found": f"""WITH scope AS (SELECT * FROM positions WHERE abs(lat) <= 90 AND abs(lon) <= 180), {inside_sql("scope", "(SELECT * FROM geofences WHERE active)")},
f AS (SELECT DISTINCT mmsi, epoch_us(reported_at) AS us, lon, lat, epoch_us(reported_at) // 300000000 AS b FROM scope), g AS (SELECT *, b + unnest([-1, 0, 1]) AS bb FROM f)
SELECT 'inside' AS kind, position_id AS key_a, CAST(id AS BIGINT) AS key_b FROM hit UNION ALL
SELECT DISTINCT 'near', x.mmsi, y.mmsi FROM f x JOIN g y ON x.b = y.bb AND x.mmsi < y.mmsi AND abs(x.us - y.us) <= 300000000 AND abs(x.lat - y.lat) < 0.01
WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 400""",
}
