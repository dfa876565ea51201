"""Current national demand and serving views."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .series import dedupe_latest

SANE_MAX_MW = 200_000.0


def sane(value: str = "load_mw", most: float = SANE_MAX_MW) -> Column:
    return F.col(value).isNotNull() & (F.col(value) > 0) & (F.col(value) < most)


def current_load(rows: DataFrame, last: int, min_bas: int = 35, ties: list[str] = (), most: float = SANE_MAX_MW) -> DataFrame:
    """Rows (ts_utc, total_mw, ba_count) ascending: the last hours that enough BAs cover.

    Only the newest hours are read: as many as are asked for and 12 more, and four times as many again while too few of
    them are covered.  A store's year and month prune its partitions.  Revisions collapse before the range filter, so an
    invalid latest revision hides its BA-hour.  After the repartition by hour both the deduplication and the sum use one
    exchange, and rows are counted instead of distinct BAs.
    """
    oldest, newest = rows.agg(F.min("ts_utc"), F.max("ts_utc")).first()
    span = last + 12
    while True:
        start = newest - timedelta(hours=span) if newest and newest - oldest > timedelta(hours=span) else oldest
        near = rows.where(F.col("ts_utc") >= F.lit(start)) if start else rows
        if start and {"year", "month"} <= set(rows.columns):
            near = near.where(in_months(F.lit(start), F.lit(newest)))
        latest = dedupe_latest(near.repartition("ts_utc"), ["ts_utc", "ba"], "as_of", ties)
        hours = latest.where(sane(most=most)).groupBy("ts_utc").agg(F.sum("load_mw").alias("total_mw"), F.count("*").alias("ba_count"))
        hours = stored(hours.where(F.col("ba_count") >= min_bas), "hours")
        if start == oldest or hours.count() >= last:
            return hours.orderBy(F.desc("ts_utc")).limit(last).orderBy("ts_utc")
        span *= 4


def in_months(start: Column, end: Column) -> Column:
    """A predicate on year and month for partition pruning; put it before any window."""
    ym = F.col("year") * 12 + F.col("month")
    return ym.between(F.year(start) * 12 + F.month(start), F.year(end) * 12 + F.month(end))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def last_hours(rows: DataFrame, n: int, key: str = "ba") -> DataFrame:
    """The last n valid hours of each BA, ascending."""
    w = Window.partitionBy(key).orderBy(F.desc("ts_utc"))
    return rows.where(sane()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n").orderBy(key, "ts_utc")


def data_end(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("ts_utc").alias("data_end"))


def freshness(docs: DataFrame, now: str, horizon: int = 24, stale_hours: float = 25.0) -> DataFrame:
    """Rows (ba, age_h, status, points): stale or short documents are flagged, the others sliced to the horizon."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("as_of_utc").cast("double")) / 3600
    out = docs.withColumn("age_h", age).withColumn("status", F.when(F.col("age_h") > stale_hours, "stale").when(F.size("points") < horizon, "short").otherwise("ok"))
    return out.withColumn("points", F.when(F.col("status") == "ok", F.slice("points", 1, horizon)))


def size_tier(reg: DataFrame) -> DataFrame:
    return reg.withColumn("tier", F.when(F.col("is_rto"), "RTO").when(F.coalesce("peak_mw", F.lit(0)) >= 5000, "Utility").otherwise("Small"))


def temp_kind(rows: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (ba, kind): absent, constant (range below 1) or varying."""
    spread = rows.groupBy(key).agg((F.max("temp_c") - F.min("temp_c")).alias("_s"))
    return spread.select(key, F.when(F.col("_s").isNull(), "absent").when(F.col("_s") < 1, "constant").otherwise("varying").alias("kind"))


def sort_grid(cards: DataFrame, by: str = "name") -> DataFrame:
    order = {"name": [F.asc("name")], "peak": [F.desc_nulls_last("peak_mw"), F.asc("name")], "utilisation": [F.desc_nulls_last("utilisation"), F.asc("name")]}
    return cards.orderBy(*order[by])


def nwp_spread(members: list[str]) -> Column:
    """Greatest less least of two or more members, else null."""
    known = sum((F.col(m).isNotNull().cast("int") for m in members[1:]), F.col(members[0]).isNotNull().cast("int"))
    return F.when(known >= 2, F.greatest(*members) - F.least(*members))


def centre_mean(points: DataFrame, centres: DataFrame, channels: list[str]) -> DataFrame:
    """Rows (ba, ts_utc, *channels): mean of the weather over a BA's load centres for each hour; nulls are ignored.

    ``points``: lat, lon, ts_utc, channels, one a place and hour; ``centres``: ba, lat, lon, as large as the registry.  A
    place that several BAs share counts for each of them.
    """
    return points.join(F.broadcast(centres), ["lat", "lon"]).groupBy("ba", "ts_utc").agg(*(F.avg(c).alias(c) for c in channels))


def to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def to_gw(mw: Column) -> Column:
    return mw / 1000
