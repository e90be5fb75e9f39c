"""Continuous ingest on Structured Streaming.

Every step of a micro-batch is idempotent by key or by epoch, because an epoch may be
run again: raw rows, positions and counters are written under their epoch's partition,
which a retry replaces; last positions are a maximum. A receipt is compared with all
within the window before it, of its own epoch and of earlier ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline.operators import feeds, ingest

#: How long after an earlier receipt another is a duplicate.
WINDOW = "5m"
RAW = "id long, source string, message_type short, mmsi long, received_at timestamp, reported_at timestamp, payload string, is_duplicate boolean"


def read_messages(spark: SparkSession, folder: str, *, files_per_batch: int = 16) -> DataFrame:
    """A stream of raw messages from JSON-lines files; more files wait, nothing is dropped."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(folder)


def decoded(raw: DataFrame) -> DataFrame:
    return ingest.decode_messages(raw.drop("message_type", "mmsi", "reported_at", "is_duplicate"), keep=["id", "source", "received_at", "payload"])


def within_boxes(messages: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Only positions in one of the boxes; the whole globe without a box."""
    if not boxes:
        return messages
    keep = F.lit(False)
    for x1, y1, x2, y2 in boxes:
        keep = keep | (F.col("lon").between(min(x1, x2), max(x1, x2)) & F.col("lat").between(min(y1, y2), max(y1, y2)))
    return messages.where(keep)


def only(messages: DataFrame, mmsis: list[int] | None = None, types: list[int] | None = None) -> DataFrame:
    """Only messages of the vessels and types named; all without names."""
    if mmsis:
        messages = messages.where(F.col("mmsi").isin(*mmsis))
    return messages.where(F.col("message_type").isin(*types)) if types else messages


def write_epoch(folder: str, last_cache: str) -> Callable[[DataFrame, int], None]:
    """The steps of one micro-batch: flag duplicates, archive, positions, counters, vessels, last
    positions. Rows lie in partitions by day of receipt, so that ``expire`` can drop them."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        flagged = ingest.dedup_messages(batch, _earlier(batch, f"{folder}/receipts", epoch), window=WINDOW).persist()
        try:
            day = F.coalesce(F.date_format("received_at", "yyyy-MM-dd"), F.lit("0000-00-00"))
            save = lambda df, name, *by: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "epoch").parquet(f"{folder}/{name}")
            save(flagged.select("id", "source", "message_type", "mmsi", "received_at", "reported_at", "payload", "is_duplicate", day.alias("date")), "raw", "date")
            positions = ingest.to_positions(flagged).withColumn("position_id", F.xxhash64("mmsi", "reported_at"))
            save(positions.withColumn("date", day), "positions", "date")
            save(ingest.rate_counters(flagged), "counters")
            # receipts that opened a window of their fingerprint
            opened = flagged.where("received_at is not null and not is_duplicate")
            receipts = opened.select(ingest.fingerprint(opened).alias("fingerprint"), F.col("received_at").alias("first_seen"), day.alias("date")).distinct()
            save(receipts, "receipts", "date")
            # vessels and cache are versioned by epoch: a retry starts from the version before it
            known = _version(spark, f"{folder}/vessels", epoch)
            none = spark.createDataFrame([], "mmsi long, name string, first_seen_at timestamp, last_seen_at timestamp")
            ingest.upsert_vessels(none if known is None else known, flagged.where("mmsi > 0")).write.mode("overwrite").parquet(f"{folder}/vessels/v={epoch}")
            ingest.last_positions(positions, _version(spark, last_cache, epoch)).write.mode("overwrite").parquet(f"{last_cache}/v={epoch}")
            for path in (f"{folder}/vessels", last_cache):
                _drop(spark, f"{path}/v={epoch - 2}")
        finally:
            flagged.unpersist()
            batch.unpersist()

    return run


def _version(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """What the epoch before left; None for the first. A missing version is an error, since to
    start from nothing would lose what was known."""
    if epoch == 0:
        return None
    before = f"{path}/v={epoch - 1}"
    if not _exists(spark, before):
        raise RuntimeError(f"{before} is missing")
    return spark.read.parquet(before)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _earlier(batch: DataFrame, path: str, epoch: int) -> DataFrame | None:
    """(fingerprint, first_seen) of the windows opened in earlier epochs that can hold one of the batch's receipts."""
    spark = batch.sparkSession
    at = F.unix_micros("received_at")
    low, high = batch.agg(F.min(at), F.max(at)).first()
    if low is None or not _exists(spark, path):
        return None
    low -= int(WINDOW[:-1]) * 60_000_000
    day = lambda us: F.date_format(F.timestamp_micros(F.lit(us)), "yyyy-MM-dd")
    kept = spark.read.schema("fingerprint string, first_seen timestamp, date string, epoch long").parquet(path)
    kept = kept.where((F.col("epoch") < epoch) & F.col("date").between(day(low), day(high)))
    return kept.where(F.unix_micros("first_seen").between(low, high)).select("fingerprint", "first_seen")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def start_ingest(raw: DataFrame, folder: str, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Runs the writer over a stream; without an interval all that is there, then stops."""
    writer = decoded(raw).writeStream.foreachBatch(write_epoch(folder, f"{folder}/last")).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def hourly_stream(positions: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Hourly counts and speeds per mover; hours close ``lateness`` after the newest report."""
    w = positions.withWatermark("reported_at", lateness).groupBy(F.window("reported_at", "1 hour").alias("w"), "mmsi")
    return w.agg(F.count(F.lit(1)).alias("position_count"), F.avg("sog").alias("avg_sog"), F.max("sog").alias("max_sog")).select(F.col("w.start").alias("bucket"), "mmsi", "position_count", "avg_sog", "max_sog")


def first_receipts(messages: DataFrame, *, window: str = "5 minutes") -> DataFrame:
    """Messages without the repeats that arrive within the window of the first receipt."""
    keyed = messages.withColumn("fingerprint", ingest.fingerprint(messages))
    return keyed.withWatermark("received_at", window).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint")


def deliver(deliveries: DataFrame, send: Callable[[dict], None], *, attempts: int = 3, pause_s: float = 0.1) -> DataFrame:
    """Sends every routed alert from the executors and returns the dead letters
    (adapter, channel, payload, error). Delivery is at least once."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            dead = []
            for row in pdf.to_dict("records"):
                for k in range(attempts):
                    try:
                        send(row)
                        break
                    except Exception as e:  # noqa: BLE001 - every failure is a dead letter
                        if k + 1 == attempts:
                            dead.append((row["adapter"], row["channel"], row["payload"], str(e)))
                        else:
                            time.sleep(pause_s * 2**k)
            yield pd.DataFrame(dead, columns=["adapter", "channel", "payload", "error"])

    return deliveries.select("adapter", "channel", "payload").mapInPandas(run, "adapter string, channel string, payload string, error string")


def start_alerts(events: DataFrame, subscriptions: DataFrame, send: Callable[[dict], None], dead_letters: str, checkpoint: str) -> StreamingQuery:
    """Routes a stream of events to subscriptions and keeps what could not be delivered."""

    def run(batch: DataFrame, epoch: int) -> None:
        dead = deliver(feeds.route_alerts(batch, subscriptions), send)
        dead.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(dead_letters)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(spark: SparkSession, folder: str, column: str, *, as_of: str, keep_days: int) -> list[str]:
    """Drops the date partitions of a table that are older than ``keep_days``; returns their names.

    Only directory names are read, one per day."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = spark.sql(f"select date_format(date_sub(to_date('{as_of}'), {keep_days}), 'yyyy-MM-dd')").first()[0]
    gone = []
    for s in fs.listStatus(hadoop):
        name = s.getPath().getName()
        if name.startswith(f"{column}=") and name.split("=", 1)[1] < limit:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
