"""Messages delivered more than once: an idempotent store keyed by message identifier.

A message is identified by its vessel, type, moment of report and canonical body.
Batches are collapsed before they are shuffled (so a message that makes up a third
of a batch leaves each task as one row), written as runs that are hash-bucketed and
sorted by identifier, and merged by compaction so that equal identifiers meet in one
bucket and leave one winner, the lowest arrival id. Writing a run again replaces it,
and compaction is a minimum, so retries and reordering change nothing.

Defined results: a null vessel, type or payload is a value of its own that equals
itself; unreadable report times equal each other; an empty table gives empty tables;
rows with a null id can neither win nor be reported.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import envelope as E
from wakeline.workspace import cut, scratch

KEY = ["key_hi", "key_lo"]


def identifier(payload: Column, *parts: Column) -> list[Column]:
    """128 bits of the message's identity as two longs, cheap to group and sort by."""
    env = E.parsed(payload)
    written = env["MetaData"]["time_utc"]
    fields = [F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts]
    fields += [F.coalesce(F.concat(E.moment(written).cast("string"), F.lit("."), E.below_micro(written)), F.lit("unread"))]
    fields += [F.coalesce(E.body_text(env, payload), F.lit("\x00null"))]
    text = F.concat_ws("\x1f", *fields)
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit("second half"), F.sha1(text)).alias(KEY[1])]


def identified(messages: DataFrame, run: Column | None = None) -> DataFrame:
    """(id, run, key_hi, key_lo) of every archived row; nothing else is carried on.

    ``run`` names the batch. A whole archive is loaded as a few runs by source."""
    by_source = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(8))
    return messages.select(
        F.col("id"),
        (by_source if run is None else run).cast("int").alias("run"),
        *identifier(F.col("payload"), F.col("mmsi"), F.col("message_type")),
    )


class MessageStore:
    """Runs of (identifier, lowest id), bucketed and sorted; ``compact`` merges them."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "messages")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"wakeline_runs_{uuid.uuid4().hex}"
        self.merged = f"{self.name}_merged"

    def _write(self, rows: DataFrame, name: str, by: list[str]) -> None:
        exists = self.spark.catalog.tableExists(name)
        rows = rows.repartition(self.buckets, *KEY)
        if exists:
            # only the partitions that the rows belong to are replaced
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                rows.write.insertInto(name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)
            return
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name, format="parquet")

    def upsert(self, batch: DataFrame) -> MessageStore:
        """Add the runs of ``batch`` (id, run, identifier); runs that are there are replaced,
        so a batch that is delivered again under its own run changes nothing."""
        won = batch.groupBy("run", *KEY).agg(F.min("id").alias("id")).select(*KEY, "id", "run")
        self._write(won, self.name, ["run"])
        return self

    def winners(self) -> DataFrame:
        """One row per identifier with its lowest id. The runs are bucketed by the
        identifier, so the merge reads them in place without a shuffle."""
        return self.spark.table(self.name).groupBy(*KEY).agg(F.min("id").alias("id"))

    def compact(self) -> DataFrame:
        """The winners, kept as a table of their own."""
        self._write(self.winners(), self.merged, [])
        return self.spark.table(self.merged)

    def drop(self) -> None:
        """Takes the tables out of the catalog and their files out of the shared folder."""
        for name in (self.name, self.merged):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def first_deliveries(messages: DataFrame) -> DataFrame:
    """(id) of the row that each message keeps: the lowest of its copies. The store is
    removed once its winners are written."""
    store = MessageStore(messages.sparkSession).upsert(identified(messages))
    won = cut(store.winners().select("id"))
    store.drop()
    return won


def deduplicated(messages: DataFrame) -> DataFrame:
    """The archive with exactly one row per message."""
    return messages.join(first_deliveries(messages), "id", "left_semi")


def further_copies(messages: DataFrame) -> DataFrame:
    """(id) of every row that repeats a row with a lower id.

    Ids are unique, so taking the winners away from all ids is a join without a hot
    key, however often one message was delivered."""
    return messages.where(F.col("id").isNotNull()).select("id").join(first_deliveries(messages), "id", "left_anti")
