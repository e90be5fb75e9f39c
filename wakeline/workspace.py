"""Shared scratch space: written runs, checkpoints and how a session is built."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wakeline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the session runs on one machine is a
    temporary folder made; elsewhere that would be lost with its executor, so it
    is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="wakeline-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that several
    consumers share one computation and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_round(df: DataFrame) -> DataFrame:
    """As ``cut``, for a table that is joined into its own next version. A checkpoint keeps the
    estimated size, and joins multiply estimates, so the number would double its digits every
    round until it fills the driver; here it is let go."""
    spark, written = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def shuffled(df: DataFrame) -> DataFrame:
    """Marks ``df`` so that joins with it are shuffled, whatever their estimated size: where a
    row becomes many, or a packed file wide rows, the estimate is far below what a broadcast
    would bring to the driver."""
    return df.hint("merge")
