"""Positions, lags and flat runs of very long series, a block of a series at a time.

A window over a whole series is one task.  Here windows stay inside blocks (a month, or ``block`` rows); what crosses a
block's ends is carried by a table of a row or two a block: counts of earlier blocks, the last rows that a lag reaches
back to, runs that touch an end.  Results equal those of the plain windows in ``series``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def row_index(rows: DataFrame, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Add idx, the position in the series from 0: rows before in the month, and those of earlier months.

    Rows without a time come first, as in the plain window.
    """
    rows = rows.withColumn("_b", F.coalesce(F.trunc(ts, "month"), F.lit("0001-01-01").cast("date")))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(key, "_b").orderBy(ts)) - 1
    return rows.join(starts.drop("_n"), [key, "_b"]).withColumn("idx", (own + F.col("_first")).cast("int")).drop("_b", "_first")


def seasonal_lags(indexed: DataFrame, lags: tuple[int, ...] = (24, 48, 168), value: str = "load_mw", key: str = "ba", block: int = BLOCK) -> DataFrame:
    """Add lag24, lag48, ...; 0.0 before the start.  Each block borrows the last rows of the one before it (its halo)."""
    block, longest = max(block, *lags), max(lags)
    own = indexed.withColumn("_b", F.expr(f"idx div {block}")).withColumn("_halo", F.lit(False))
    halo = own.where(f"idx % {block} >= {block - longest}").select(key, "idx", value, (F.col("_b") + 1).alias("_b"), F.lit(True).alias("_halo"))
    w = Window.partitionBy(key, "_b").orderBy("idx")
    met = own.unionByName(halo, allowMissingColumns=True)
    return met.select("*", *(F.lag(value, k, 0.0).over(w).alias(f"lag{k}") for k in lags)).where("NOT _halo").drop("_b", "_halo")


def flatline_runs(indexed: DataFrame, value: str = "load_mw", key: str = "ba", block: int = BLOCK) -> DataFrame:
    """Rows (ba, longest): the longest run of identical consecutive values, in rows.

    Runs are found inside blocks; only those at a block's ends, two a block, are put together over the series.
    """
    rows = indexed.select(key, "idx", F.col(value).alias("_v"), F.expr(f"idx div {block}").alias("_b"))
    w = Window.partitionBy(key, "_b").orderBy("idx")
    change = F.coalesce(F.col("_v") != F.lag("_v").over(w), F.lit(True)).cast("int")
    runs = rows.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "_b", "_run").agg(F.count("*").alias("_len"), F.min("idx").alias("_from"), F.max("idx").alias("_to"), F.first("_v").alias("_v"))
    within = Window.partitionBy(key, "_b")
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(within)))
    inner = runs.where("NOT _edge").groupBy(key).agg(F.max("_len").alias("longest"))
    over = Window.partitionBy(key).orderBy("_from")
    joined = F.coalesce((F.col("_v") == F.lag("_v").over(over)) & (F.col("_from") == F.lag("_to").over(over) + 1), F.lit(False))
    edges = runs.where("_edge").withColumn("_new", (~joined).cast("int")).withColumn("_island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    across = edges.groupBy(key, "_island").agg(F.sum("_len").alias("longest")).groupBy(key).agg(F.max("longest").alias("longest"))
    return inner.unionByName(across).groupBy(key).agg(F.max("longest").alias("longest"))
