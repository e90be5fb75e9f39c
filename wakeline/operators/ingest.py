"""From raw envelopes to messages, positions, vessels and counters.

Defined results: text that is no envelope gives no message; numbers beyond the range of
their column are null, not an error; unreadable report times are null; repeated rows are
handled as each function states; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import envelope as E
from wakeline.operators.timeline import latest
from wakeline.workspace import cut

#: Message types that carry a position.
POSITION_TYPES = (1, 2, 3, 18, 19, 27)
STATIC_TYPE = 5

_FULL = "MessageType string, MetaData struct<MMSI:long,ShipName:string,time_utc:string>, Message map<string,variant>"


def _field(body: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(body, f"$.{path}", kind)


def decode_messages(raw: DataFrame, *, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Decoded messages; the inner body is chosen by the envelope's type.

    The vessel is MetaData.MMSI, else the body's UserID; a position needs a position type
    and both coordinates."""
    env = F.from_json(E.plain_numbers(F.col(payload)), _FULL)
    rows = raw.withColumn("_e", env).where("_e.MessageType is not null").withColumn("_b", F.col("_e.Message")[F.col("_e.MessageType")])
    b = F.col("_b")
    kind = F.coalesce(_field(b, "MessageID", "int"), F.lit(0))
    lat, lon = _field(b, "Latitude", "double"), _field(b, "Longitude", "double")
    has = kind.isin(*POSITION_TYPES) & lat.isNotNull() & lon.isNotNull()
    us = E.moment(F.col("_e.MetaData.time_utc"))
    only = lambda c: F.when(has, c)
    return rows.select(
        *(keep or []),
        kind.alias("message_type"),
        F.coalesce(F.col("_e.MetaData.MMSI"), _field(b, "UserID", "long"), F.lit(0)).alias("mmsi"),
        F.trim(F.coalesce(F.col("_e.MetaData.ShipName"), F.lit(""))).alias("name"),
        F.timestamp_micros(us).alias("reported_at"), us.isNotNull().alias("has_reported"), has.alias("has_position"),
        only(lat).alias("lat"), only(lon).alias("lon"), only(_field(b, "Sog", "double")).alias("sog"), only(_field(b, "Cog", "double")).alias("cog"),
        only(_field(b, "TrueHeading", "double").try_cast("smallint")).alias("heading"), only(_field(b, "NavigationalStatus", "double").try_cast("smallint")).alias("nav_status"),
        _field(b, "Destination", "string").alias("destination"),
    )


def fingerprint(df: DataFrame) -> Column:
    """SHA-256 of vessel, type, report time in nanoseconds and position, zeros where absent."""
    nanos = F.coalesce(F.unix_micros("reported_at"), F.lit(0)) * 1000
    place = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("lon", "lat")]
    return F.sha2(F.format_string("%d|%d|%d|%.6f|%.6f", F.col("mmsi"), F.col("message_type").cast("long"), nanos, *place), 256)


def duplicate_flags(messages: DataFrame, seen: DataFrame | None = None, *, order: str = "id", window: str = "5m") -> DataFrame:
    """(order, is_duplicate): a receipt opens a window unless it lies in an open one of the same
    fingerprint; those in it repeat the first. Later receipts don't prolong it. ``seen``
    (fingerprint, first_seen) are windows opened earlier; equal times go by ``order``.

    Receipts with pauses of at most the window make a chain, found from the first and last of
    each slot of the window's length, so that only two values per fingerprint and slot
    are shuffled, however often one message was delivered. A chain within one window has
    one first receipt. Longer ones are read in order, keeping the last opening only."""
    span = int(window[:-1]) * {"s": 1, "m": 60, "h": 3600}[window[-1]] * 1_000_000
    slot = F.expr(f"(at - pmod(at, {span}L)) div {span}L").alias("slot")
    keys = messages.where("received_at is not null").select(F.col(order).cast("long").alias("by"), F.unix_micros("received_at").alias("at"), fingerprint(messages).alias("fingerprint"))
    keys = cut(keys)  # messages are decoded once
    all_ = keys if seen is None else keys.unionByName(seen.select(F.lit(None).cast("long").alias("by"), F.unix_micros("first_seen").alias("at"), "fingerprint"))
    ends = all_.groupBy("fingerprint", slot).agg(F.min(F.struct("at", F.coalesce("by", F.lit(-(2**63))).alias("by"))).alias("lo"), F.max("at").alias("hi"))
    over = Window.partitionBy("fingerprint").orderBy("slot")  # one row per slot
    fresh = F.when(F.col("lo.at") - F.lag("hi").over(over) <= span, 0).otherwise(1)
    chained = ends.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(over))
    whole = Window.partitionBy("fingerprint", "chain")
    chained = chained.select("fingerprint", "slot", "chain", F.min("lo").over(whole).alias("first"), F.max("hi").over(whole).alias("last"))
    rows = all_.withColumn("slot", slot).join(chained, ["fingerprint", "slot"])
    short = F.col("last") - F.col("first.at") <= span
    plainly = rows.where(short & F.col("by").isNotNull()).select("by", (F.struct("at", "by") != F.struct("first.at", "first.by")).alias("is_duplicate"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, 0
        for batch in batches:
            flags = []
            for f, c, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (f, c) != key or at > opened + span:
                    key, opened = (f, c), at
                    flags.append(False)
                else:
                    flags.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(flags, pa.bool_())], names=["by", "is_duplicate"])

    long = rows.where(~short).select("fingerprint", "chain", "at", "by").repartition("fingerprint", "chain").sortWithinPartitions("fingerprint", "chain", "at", F.asc_nulls_first("by"))
    return plainly.unionByName(long.mapInArrow(read, "by long, is_duplicate boolean").where("by is not null")).withColumnRenamed("by", order)


def dedup_messages(messages: DataFrame, seen: DataFrame | None = None, *, order: str = "id", window: str = "5m") -> DataFrame:
    """Adds is_duplicate to messages with unique ``order`` (``duplicate_flags``); receipts without a time are none."""
    flags = duplicate_flags(messages, seen, order=order, window=window).select(F.col(order).alias("_order"), "is_duplicate")
    rows = messages.drop("is_duplicate")
    return rows.join(flags, rows[order] == flags["_order"], "left").drop("_order").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def to_positions(messages: DataFrame) -> DataFrame:
    """Rows for the position table: positions that are no duplicates, timed by their report
    or else their receipt, speeds and courses in single precision."""
    rows = messages.where("has_position and not is_duplicate")
    return rows.select("mmsi", F.coalesce("reported_at", "received_at").alias("reported_at"), "received_at", "source", "lon", "lat", F.col("sog").cast("float").alias("sog"), F.col("cog").cast("float").alias("cog"), "heading", "nav_status")


def upsert_vessels(vessels: DataFrame, messages: DataFrame, *, order: str = "id") -> DataFrame:
    """Vessels with the last non-empty name and the time last seen; new ones are added.
    ``is_new`` marks those first seen in this batch."""
    named = F.when(F.col("name") != "", F.col("name"))
    batch = messages.groupBy("mmsi").agg(F.max_by(named, F.when(named.isNotNull(), F.col(order))).alias("_name"), F.min("received_at").alias("_first"), F.max("received_at").alias("_last"))
    both = vessels.select("mmsi", "name", "first_seen_at", "last_seen_at").join(batch, "mmsi", "full")
    return both.select("mmsi", F.coalesce("_name", "name").alias("name"), F.coalesce("first_seen_at", "_first").alias("first_seen_at"), F.greatest("last_seen_at", "_last").alias("last_seen_at"), F.col("first_seen_at").isNull().alias("is_new"))


LAST = ["reported_at", "received_at", "lon", "lat", "sog", "cog", "heading", "nav_status"]


def last_positions(positions: DataFrame, cache: DataFrame | None = None, *, tie: str = "position_id") -> DataFrame:
    """The newest fix of each vessel; equal times go to the later row, and an earlier cache
    gives way to a fix that is at least as new."""
    rows = positions.where("mmsi is not null and reported_at is not null").select("mmsi", *LAST, F.col(tie).cast("long").alias("_tie"))
    if cache is not None:
        rows = rows.unionByName(cache.select("mmsi", *LAST).withColumn("_tie", F.lit(-1).cast("long")))
    return latest(rows, ["mmsi"], ["reported_at", "_tie"]).drop("_tie")


def rebuild_last_positions(raw: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The newest position of each vessel from the archive, by the place in the envelope's
    MetaData, else in its body; motion is unknown. A cache that holds any row is left as it is."""
    if cache is not None and not cache.isEmpty():
        return cache
    env = F.from_json(E.plain_numbers(F.col("payload")), "MessageType string, MetaData struct<latitude:double,longitude:double>, Message map<string,variant>").alias("e")
    read = raw.where(F.col("message_type").isin(*POSITION_TYPES)).select("mmsi", F.coalesce("reported_at", "received_at").alias("reported_at"), "received_at", "id", env)
    body = F.col("e.Message")[F.col("e.MessageType")]
    rows = read.select("mmsi", "reported_at", "received_at", "id", F.coalesce("e.MetaData.longitude", _field(body, "Longitude", "double")).alias("lon"), F.coalesce("e.MetaData.latitude", _field(body, "Latitude", "double")).alias("lat"))
    return latest(rows.where("lon is not null and lat is not null"), ["mmsi"], ["reported_at", "id"]).drop("id")


def rate_counters(messages: DataFrame) -> DataFrame:
    """(source, window_start, count) per source and minute of receipt."""
    return messages.groupBy("source", F.date_trunc("minute", "received_at").alias("window_start")).agg(F.count(F.lit(1)).alias("count"))


def enrich_vessels(vessels: DataFrame, raw: DataFrame, *, as_of: str) -> DataFrame:
    """Vessels patched from their latest static message: zero and empty values keep the old.

    Length and beam are sums of the reported distances; bodies that are no object patch
    nothing. Adds destination and enriched_at for the patched ones."""
    body = E.parsed(F.col("payload"))
    static = raw.where(F.col("message_type") == STATIC_TYPE).select("mmsi", "received_at", "id", body.alias("e")).withColumn("b", F.col("e.Message")["ShipStaticData"])
    num = lambda p: _field(F.col("b"), p, "long")
    txt = lambda p: F.trim(_field(F.col("b"), p, "string"))
    fields = static.where(num("MessageID").isNotNull()).select(
        "mmsi", "received_at", "id", num("ImoNumber").alias("imo"), txt("CallSign").alias("call_sign"), txt("Name").alias("name"), num("Type").cast("int").alias("ship_type"),
        (num("Dimension.A") + num("Dimension.B")).cast("int").alias("length_m"), (num("Dimension.C") + num("Dimension.D")).cast("int").alias("beam_m"), txt("Destination").alias("destination"),
    )
    new = latest(fields, ["mmsi"], ["received_at", "id"]).drop("received_at", "id")
    new = new.select("mmsi", *[F.col(c).alias(f"_{c}") for c in new.columns if c != "mmsi"])
    both = vessels.join(new, "mmsi", "left")
    patch = {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(0)), F.col(c)) for c in ("imo", "ship_type", "length_m", "beam_m")}
    patch |= {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in ("call_sign", "name")}
    keep = [c for c in vessels.columns if c not in patch and c != "mmsi"]
    return both.select("mmsi", *[v.alias(k) for k, v in patch.items()], *keep, F.col("_destination").alias("destination"), F.when(F.col("_destination").isNotNull(), F.lit(as_of).cast("timestamp")).alias("enriched_at"))
