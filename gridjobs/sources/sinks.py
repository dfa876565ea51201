"""Publishing forecasts: one JSON document for each BA, flat CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_docs(points: DataFrame, model: str, as_of: str) -> DataFrame:
    """Rows (ba, model, as_of_utc, horizon, units, points array) of points (ba, step, ts_utc, lo, median, hi).

    A document has one forecast's points, so its array is bounded by the horizon.
    """
    p = F.struct("step", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), F.col("median").alias("median_mw"), F.col("lo").alias("p10_mw"), F.col("hi").alias("p90_mw"))
    docs = points.groupBy("ba").agg(F.sort_array(F.collect_list(p)).alias("points"))
    return docs.select("ba", F.lit(model).alias("model"), F.lit(as_of).alias("as_of_utc"), F.size("points").alias("horizon"), F.lit("MW").alias("units"), "points")


def forecast_csv(points: DataFrame) -> DataFrame:
    """CSV cells with two decimals, blank where null."""
    blank = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.2f", c)).alias(c)
    cols = [c for c in ("median", "lo", "hi", "temp_c") if c in points.columns]
    return points.select("ba", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), *(blank(c) for c in cols))
