"""Structured Streaming jobs: landing, latest revisions, current demand, rolling views, feed gaps.

Event times are timestamps (streams reject timestamps without zone); rows more than 72 hours late are dropped by the
watermark, as the hourly job re-fetches no further back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.live import sane
from ..sources import store
from . import state

LATE = "72 hours"


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what is available to a table, to the end, and give the table: nothing passes through the driver."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def land(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available, duplicates included, to year/month partitions."""
    rows = store.with_months(stream, "ts_utc")
    rows.writeStream.format("parquet").partitionBy("year", "month").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def log_changes(stream: DataFrame, path: str, checkpoint: str, ties: list[str] = (), late: str = LATE) -> DataFrame:
    """Append the changes that a stream's revisions make to a table by year and month, and give the table.

    A revision that is not newer than the kept one changes nothing; nothing written is written again, whatever is revised.
    A restart goes on from the checkpoint, with the state as it was committed.
    """
    spark = stream.sparkSession
    setting, provider = state.PROVIDER
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, provider)
    try:
        log = state.changes(stream, late, ties=ties)
        land(log, path, checkpoint)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return store.scan(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema))


def latest(stream: DataFrame, path: str, checkpoint: str, ties: list[str] = ()) -> DataFrame:
    """The latest revision of each (ba, ts_utc)."""
    return state.collapse(log_changes(stream, path, checkpoint, ties).drop("year", "month"))


def current_load(stream: DataFrame, path: str, checkpoint: str, min_bas: int, ties: list[str] = ()) -> DataFrame:
    """(ts_utc, total_mw, ba_count) by hour, from the log of changes: what was taken back counts negatively.

    The latest revision of a (ts, ba) wins before the range filter, so an invalid one hides its BA-hour, as in the batch job.
    """
    rows = log_changes(stream, path, checkpoint, ties).where(sane())
    hours = rows.groupBy("ts_utc").agg(F.sum(F.col("load_mw") * F.col("op")).alias("total_mw"), F.sum("op").alias("ba_count"))
    return hours.where(F.col("ba_count") >= min_bas)


def rolling_24h(stream: DataFrame, late: str = LATE) -> DataFrame:
    """(w_start, w_end, total_mw, n): sliding 24-hour windows every hour."""
    w = stream.withWatermark("ts_utc", late).groupBy(F.window("ts_utc", "24 hours", "1 hour"))
    return w.agg(F.sum("load_mw").alias("total_mw"), F.count("*").alias("n")).select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "total_mw", "n")


def gap_sessions(stream: DataFrame, gap: str = "3 hours", late: str = LATE) -> DataFrame:
    """(ba, s_start, s_end, n): stretches of a feed without an outage of ``gap``."""
    s = stream.withWatermark("ts_utc", late).groupBy("ba", F.session_window("ts_utc", gap)).agg(F.count("*").alias("n"))
    return s.select("ba", F.col("session_window.start").alias("s_start"), F.col("session_window.end").alias("s_end"), "n")
