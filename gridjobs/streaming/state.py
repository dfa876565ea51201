"""Keyed state of a stream of revisions: the latest one of each (ba, ts_utc), for as long as it can still change.

The state of an hour is the latest revision of each ba, in ``SLICES`` parts by the ba's hash: one call of Python and one
read and write of the state store serve all the bas of a part.  A newer revision replaces the held one and gives two
rows of a log of changes: the old revision with op -1, the new one with op 1.  So sums over the log weighted by op are
sums over the latest revisions, and nothing that was written is ever written again.  An event-time timer clears a part
once the watermark passes its hour, from when on the watermark drops its rows as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, FloatType, IntegerType, NumericType, StructField, StructType, TimestampType

KEY = ["ba", "ts_utc"]
#: Parts of an hour; one part of one hour is held by one task.
SLICES = 4
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LatestRevisions(StatefulProcessor):
    """The latest revisions of one slice of one hour, by ba, as one table in Arrow's IPC format.

    ``columns``: those that are kept; ``order``: those that rank revisions, larger values first; of equal ones the first
    that came stays.
    """

    def __init__(self, columns: list[str], order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "revisions binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        stored = self.latest.get()
        seen = [x[self.columns].assign(held=False) for x in rows]
        held = pa.ipc.open_stream(stored[0]).read_pandas() if stored is not None else seen[0][self.columns].head(0)
        best = pd.concat([held.assign(held=True), *seen] if len(held) else seen, ignore_index=True)
        best = best.sort_values(self.order, ascending=False, kind="stable").drop_duplicates("ba")
        new = best[~best["held"]][self.columns]
        if not len(new):
            return
        table, sink = pa.Table.from_pandas(best[self.columns], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.latest.update((sink.getvalue().to_pybytes(),))
        if stored is None:
            self.handle.registerTimer(int(new["at"].iloc[0]) // 1000)
        old = held[held["ba"].isin(new["ba"])]
        if len(old):
            yield old.assign(op=-1)
        yield new.assign(op=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def changes(stream: DataFrame, late: str, as_of: str = "as_of", ties: list[str] = (), slices: int = SLICES) -> DataFrame:
    """The log of changes of a stream of revisions: its columns, and op 1 or -1.  Rows without a key are left out.

    ``slices``, the parts that an hour's bas are dealt to, stays the same for as long as a checkpoint is used.
    """
    names = [c for c in stream.columns if c not in KEY]
    times = [c for c in names if isinstance(stream.schema[c].dataType, TimestampType)]  # kept as microseconds
    rows = stream.select(*KEY, *names).withColumns({c: F.unix_micros(c) for c in times}).where(F.col("ba").isNotNull() & F.col("ts_utc").isNotNull())
    # pandas takes null for NaN: a column beside each number says which it is, in Spark's order of null, number, NaN.
    kinds = {c: f"kind_{c}" for c in names if isinstance(rows.schema[c].dataType, NumericType)}
    rows = rows.withColumns({kind: F.when(F.isnull(c), -1).when(F.isnan(c), 1).otherwise(0) for c, kind in kinds.items()})
    rows = rows.withColumns({c: F.when(F.col(kind) == 0, F.col(c)).otherwise(F.lit(0).cast(rows.schema[c].dataType)) for c, kind in kinds.items()})
    kept = rows.withColumn("at", F.unix_micros("ts_utc")).withWatermark("ts_utc", late).withColumn("slice", F.pmod(F.xxhash64("ba"), F.lit(slices)))
    columns = ["ba", "at", *names, *kinds.values()]
    order = [x for c in (as_of, *ties) for x in (kinds.get(c), c) if x]
    out = StructType([*(kept.schema[c] for c in columns), StructField("op", IntegerType())])
    log = kept.groupBy("ts_utc", "slice").transformWithStateInPandas(LatestRevisions(columns, order), outputStructType=out, outputMode="Append", timeMode="EventTime")
    back = {c: F.when(F.col(kind) == 0, F.col(c)) for c, kind in kinds.items()}
    log = log.withColumns({c: x.when(F.col(kinds[c]) == 1, F.lit("NaN").cast(rows.schema[c].dataType)) if isinstance(rows.schema[c].dataType, (DoubleType, FloatType)) else x for c, x in back.items()}).withColumns({c: F.timestamp_micros(c) for c in times})
    return log.select("ba", F.timestamp_micros("at").alias("ts_utc"), *names, "op")


def collapse(log: DataFrame) -> DataFrame:
    """The latest revisions: what a log of changes has added and not taken back."""
    names = [c for c in log.columns if c != "op"]
    return log.groupBy(*names).agg(F.sum("op").alias("op")).where("op > 0").drop("op")
