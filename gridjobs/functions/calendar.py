"""Calendar features in UTC: cyclic hour and weekday, holidays, bridge days, holiday proximity."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month; n = -1: the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (date(year + month // 12, month % 12 + 1, 1)) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def us_holidays(first_year: int, last_year: int) -> list[date]:
    """US federal holidays and, for those on a weekend, also the observed Friday or Monday."""
    days = set()
    for y in range(first_year, last_year + 2):
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)] + ([date(y, 6, 19)] if y >= 2021 else [])
        moving = [_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)]
        observed = [d + timedelta(days={5: -1, 6: 1}[d.weekday()]) for d in fixed if d.weekday() >= 5]
        days.update(fixed + moving + observed)
    return sorted(d for d in days if first_year <= d.year <= last_year)


def holiday_table(spark: SparkSession, first_year: int = 1990, last_year: int = 2035) -> DataFrame:
    return spark.createDataFrame([(d,) for d in us_holidays(first_year, last_year)], "day date")


def cyclic(ts: str = "ts_utc") -> list[Column]:
    hour, dow = F.hour(ts), F.weekday(ts)
    return [
        F.sin(hour * (2 * math.pi / 24)).alias("hour_sin"),
        F.cos(hour * (2 * math.pi / 24)).alias("hour_cos"),
        F.sin(dow * (2 * math.pi / 7)).alias("dow_sin"),
        F.cos(dow * (2 * math.pi / 7)).alias("dow_cos"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]


def calendar_features(rows: DataFrame, holidays: DataFrame, ts: str = "ts_utc") -> DataFrame:
    """Add hour_sin, hour_cos, dow_sin, dow_cos, is_weekend, is_holiday (observed days included)."""
    marked = F.broadcast(holidays.select(F.col("day").alias("_day"), F.lit(1).alias("is_holiday")))
    out = rows.select("*", *cyclic(ts), F.to_date(ts).alias("_day")).join(marked, "_day", "left").drop("_day")
    return out.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))


def special_days(rows: DataFrame, holidays: DataFrame, ts: str = "ts_utc") -> DataFrame:
    """Rows (day, is_bridge, hol_prox), counted over the days that occur in ``rows``.

    A bridge is a working day between two off-days that are its neighbours among the days present; the first and last
    day are none.  Proximity is the signed number of present days to the nearest holiday (a tie counts as before it),
    clipped to a week and divided by 7; 1.0 when there is no holiday.  One row a day: the windows are over days.
    """
    days = rows.select(F.to_date(ts).alias("day")).distinct()
    marked = days.join(F.broadcast(holidays.withColumn("hol", F.lit(True))), "day", "left").select("day", F.coalesce("hol", F.lit(False)).alias("hol"))
    w = Window.orderBy("day")
    off = F.col("hol") | (F.weekday("day") >= 5)
    placed = marked.withColumn("off", off).withColumn("pos", F.row_number().over(w))
    at = F.when(F.col("hol"), F.col("pos"))
    placed = placed.withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    to_next, since = F.col("after") - F.col("pos"), F.col("pos") - F.col("before")
    signed = F.when(to_next.isNull() & since.isNull(), 7).when(since.isNull() | (to_next <= since), -to_next).otherwise(since)
    bridge = ~F.col("off") & F.coalesce(F.lag("off").over(w), F.lit(False)) & F.coalesce(F.lead("off").over(w), F.lit(False))
    return placed.select("day", bridge.cast("int").alias("is_bridge"), (F.greatest(F.lit(-7), F.least(F.lit(7), signed)) / 7).alias("hol_prox"))

