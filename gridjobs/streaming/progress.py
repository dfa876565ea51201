"""What each micro-batch took in and what it dropped as late, kept as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, batch bigint, n_rows bigint, late_rows bigint, latest timestamp, watermark timestamp"
NAME = "batch"


def observed(stream: DataFrame, ts: str = "ts_utc") -> DataFrame:
    """The stream with its rows and its latest time observed batch by batch."""
    return stream.observe(NAME, F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("latest"))


class BatchLog(StreamingQueryListener):
    """A row for each micro-batch of a run that had input; the watermark is the one that holds while it runs."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            seen = p.observedMetrics.get(NAME)
            late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.rows.append((str(p.runId), p.batchId, seen["n_rows"] if seen else p.numInputRows, late, seen["latest"] if seen else None, p.eventTime.get("watermark")))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def run_logged(spark: SparkSession, run, path: str, wait: float = 60.0) -> None:
    """Call ``run()``, which starts one query and waits for its end, and append its batches to the table at ``path``."""
    log = BatchLog()
    spark.streams.addListener(log)
    try:
        run()
        log.ended.wait(wait)
    finally:
        spark.streams.removeListener(log)
    rows = spark.createDataFrame([(*r[:5], r[5]) for r in log.rows], SCHEMA.replace("watermark timestamp", "watermark string"))
    rows.withColumn("watermark", F.to_timestamp("watermark")).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
