"""Domain tables derived from the driver's test tables, each with work that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("2024-01-21", "2024-01-26", "2024-01-31")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def exact_sum(c: str):
    """Sum of a column with two decimals, independent of the order of its rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def load_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Five series (event types): hourly sums."""
    return events(spark, d).groupBy(F.col("event_type").alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc")).agg(exact_sum("value").alias("load_mw"))


def load_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Many small series (users)."""
    return events(spark, d).groupBy(F.col("user_id").cast("string").alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc")).agg(exact_sum("value").alias("load_mw"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_type").alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc"), F.col("value").alias("load_mw"), F.lit("events").alias("source"), F.col("ts").alias("as_of"), F.col("event_id").alias("tie"))


def user_revisions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").cast("string").alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc"), F.col("value").alias("load_mw"), F.col("ts").alias("as_of"), F.col("event_id").alias("tie"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Observed °F from the events' property k."""
    return events(spark, d).select(F.col("event_type").alias("ba"), "ts", F.get_json_object("props", "$.k").cast("double").alias("f"), F.col("user_id"))


def weather(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("ba", F.date_trunc("hour", "ts").alias("ts_utc")).agg(((F.avg("f") - 32) * 5 / 9).alias("temp_c"))


def point_weather(spark: SparkSession, d: str, places: DataFrame) -> DataFrame:
    """Hourly weather by place (lat, lon): users report from the ``places`` in turn."""
    numbered = places.select("lat", "lon").distinct().select("lat", "lon", (F.row_number().over(Window.orderBy("lat", "lon")) - 1).alias("k"))
    n = numbered.count()
    seen = observations(spark, d).withColumn("k", F.pmod("user_id", F.lit(n))).join(F.broadcast(numbered), "k")
    return seen.groupBy("lat", "lon", F.date_trunc("hour", "ts").alias("ts_utc")).agg(F.avg("f").alias("temp_c"), F.max(F.when(F.col("f") > 20, F.col("f"))).alias("wind"))


def generation(spark: SparkSession, d: str) -> DataFrame:
    fuel = F.when(F.col("event_type") == "click", "WND").when(F.col("event_type") == "view", "SUN").otherwise("OTH")
    return events(spark, d).select(F.concat(F.lit("U"), F.pmod("user_id", F.lit(5))).alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc"), fuel.alias("fuel"), F.col("value").alias("gen_mw"))


def grouped_load(spark: SparkSession, d: str) -> DataFrame:
    """Five series by user group, as ``generation`` has them."""
    return events(spark, d).groupBy(F.concat(F.lit("U"), F.pmod("user_id", F.lit(5))).alias("ba"), F.date_trunc("hour", "ts").alias("ts_utc")).agg(exact_sum("value").alias("load_mw"))


def archived(spark: SparkSession, d: str) -> DataFrame:
    """Archived forecasts of temp_c: from 11 January on, without hours whose number is divisible by 7; lead 24 or 30 h."""
    w = weather(spark, d).where("ts_utc >= timestamp'2024-01-11' AND pmod(hour(ts_utc), 7) <> 0")
    return w.select("ba", "ts_utc", (F.col("temp_c") + 0.5).alias("temp_c_fcst"), (F.col("temp_c") - 0.25).alias("temp_c_anal"), (F.col("temp_c") * 3 + 100).alias("rad_wm2_fcst"), F.when(F.pmod(F.hour("ts_utc"), F.lit(5)) != 0, F.col("temp_c") / 2 + 4).alias("wind100_fcst"), F.when(F.pmod(F.hour("ts_utc"), F.lit(3)) != 1, F.abs("temp_c") / 10).alias("temp_spread_c"), F.when(F.pmod(F.hour("ts_utc"), F.lit(2)) == 0, 24).otherwise(30).alias("lead_hours"))


def operator_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Another party's forecast: the load with an error by the hour, absent in some hours."""
    x = load_hourly(spark, d).where("pmod(hour(ts_utc), 5) <> 0")
    return x.select("ba", "ts_utc", (F.col("load_mw") * (1 + (F.hour("ts_utc") - 12) / 100.0)).alias("forecast_mw"))


def daily_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("ba"), F.col("o_orderdate").cast("timestamp").alias("ts_utc")).agg(exact_sum("o_totalprice").alias("load_mw"))


def node_prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("node"), F.col("l_shipdate").cast("timestamp").alias("ts_utc")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("lmp"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """A registry from nation and region: code, interconnect, utc_offset, peak_mw (customers), is_rto."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("peak_mw"))
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("code"), F.col("r_name").alias("interconnect"), (F.col("n_nationkey") - 12).cast("int").alias("utc_offset"), F.coalesce("peak_mw", F.lit(0)).alias("peak_mw"), (F.col("n_regionkey") == 1).alias("is_rto"), F.col("n_name").alias("name"))
