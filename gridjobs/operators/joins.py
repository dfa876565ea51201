"""Aligning load with weather, generation mix, archived forecasts, peers and future covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import steps

# Modes of the covariate policy.
MODES = ("persistence", "lag24", "forecast", "forecast_full", "analysis_only", "none", "oracle", "oracle_om")
OPEN_METEO_MODES = ("forecast", "forecast_full", "analysis_only", "oracle_om")
CALENDAR = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_holiday")
FORECAST_EXTRAS = ("rad_fcst", "wind_fcst")


def left_on_ts(load: DataFrame, weather: DataFrame, value: str = "temp_c") -> DataFrame:
    return load.join(weather.select("ba", "ts_utc", value), ["ba", "ts_utc"], "left")


def gen_pivot(load: DataFrame, gen: DataFrame, fuels: tuple[str, ...] = ("WND", "SUN")) -> DataFrame:
    """Add a column for each fuel: mean of duplicate rows, null where the hour lacks it, 0 where the BA never has it."""
    wide = gen.where(F.col("fuel").isin(*fuels)).groupBy("ba", "ts_utc").pivot("fuel", list(fuels)).agg(F.avg("gen_mw"))
    known = gen.where(F.col("fuel").isin(*fuels)).groupBy("ba").agg(*(F.max(F.when(F.col("fuel") == f, True)).alias(f"has_{f}") for f in fuels))
    out = load.join(wide, ["ba", "ts_utc"], "left").join(known, "ba", "left")
    return out.select(*load.columns, *(F.when(F.col(f"has_{f}"), F.col(f)).otherwise(0.0).alias(f) for f in fuels))


def forecast_alignment(indexed: DataFrame, archived: DataFrame, extras: dict[str, str] | None = None) -> DataFrame:
    """Add temp_fcst, temp_anal, fcst_start and fcst_lead_hours to a filled series with temp_c.

    Archived rows match by exact timestamp.  Before the first match the observed temperature stands in; later gaps
    carry the last forecast.  fcst_start is the first matched position, fcst_lead_hours the least lead.  ``extras`` maps
    further channels to add (irradiance, wind) to the archive's columns: gaps carry the last value, those before the
    first value take that one, as nothing observed stands in for them.
    """
    extras = extras or {}
    side = archived.select("ba", "ts_utc", F.col("temp_c_fcst").alias("_f"), F.col("temp_c_anal").alias("_a"), F.col("lead_hours").alias("_lead"), *(F.col(c).alias(f"_x_{name}") for name, c in extras.items()))
    w, whole = Window.partitionBy("ba").orderBy("idx"), Window.partitionBy("ba")
    met = indexed.join(side, ["ba", "ts_utc"], "left")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    out = met.withColumn("fcst_start", F.min(F.when(F.col("_f").isNotNull(), F.col("idx"))).over(whole)).withColumn("fcst_lead_hours", F.min("_lead").over(whole))
    return out.withColumn("temp_fcst", F.coalesce(F.last("_f", True).over(past), "temp_c")).withColumn("temp_anal", F.last("_a", True).over(past)).drop("_f", "_a", "_lead").withColumns({name: F.coalesce(F.last(f"_x_{name}", True).over(past), F.first(f"_x_{name}", True).over(w.rowsBetween(0, Window.unboundedFollowing))) for name in extras}).drop(*(f"_x_{name}" for name in extras))


def analysis_past(aligned: DataFrame, mode: str) -> DataFrame:
    """In the modes that forecast from the archive, the past channel is the analysis from fcst_start on."""
    if mode not in OPEN_METEO_MODES:
        return aligned
    return aligned.withColumn("temp_c", F.when(F.col("idx") >= F.col("fcst_start"), F.coalesce("temp_anal", "temp_c")).otherwise(F.col("temp_c")))


def reindex_ffill(target: DataFrame, source: DataFrame, value: str, keys: list[str] = ("ba",), ts: str = "ts_utc") -> DataFrame:
    """Source values at the target's timestamps by exact match, then carried forward over target rows only."""
    met = target.join(source.select(*keys, ts, value), [*keys, ts], "left")
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(value, F.last(value, True).over(w))


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Rows (ba, ts_utc, actual, forecast) at common timestamps."""
    return actual.select("ba", "ts_utc", F.col("load_mw").alias("actual")).join(forecast.select("ba", "ts_utc", F.col("forecast_mw").alias("forecast")), ["ba", "ts_utc"])


def overlay(actual: DataFrame, forecast: DataFrame, operator: DataFrame) -> DataFrame:
    """Chart rows (ba, ts_utc, load, lo, median, hi, operator).

    Actuals before the forecast's first hour, then the forecast; the last actual also carries its load as the band, so
    that the lines meet; the operator's forecast is attached to rows that exist.
    """
    start = forecast.groupBy("ba").agg(F.min("ts_utc").alias("_start"))
    acts = actual.groupBy("ba", "ts_utc").agg(F.max("load_mw").alias("load")).join(start, "ba", "left").where("_start IS NULL OR ts_utc < _start")
    last = F.row_number().over(Window.partitionBy("ba").orderBy(F.desc("ts_utc"))) == 1
    bridge = F.when(last, F.col("load"))
    acts = acts.select("ba", "ts_utc", "load", bridge.alias("lo"), bridge.alias("median"), bridge.alias("hi"))
    rows = acts.unionByName(forecast.select("ba", "ts_utc", F.lit(None).cast("double").alias("load"), "lo", "median", "hi"))
    return rows.join(operator.select("ba", "ts_utc", F.col("forecast_mw").alias("operator")), ["ba", "ts_utc"], "left")


def peer_pairs(series: DataFrame, value: str = "load_mw") -> DataFrame:
    """Rows (ba, peer, ts_utc, y, x): every ordered pair of series at common timestamps.

    The output has one row for each pair and hour by definition; the inputs are registry-sized in keys.
    """
    other = series.select(F.col("ba").alias("peer"), "ts_utc", F.col(value).alias("x"))
    return series.select("ba", "ts_utc", F.col(value).alias("y")).join(other, "ts_utc").where("ba <> peer")


def resolve_policy(mode: str, gen: tuple[str, ...] = ("WND", "SUN")) -> dict[str, str]:
    """Covariate -> policy."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    temp = {"oracle": "oracle", "oracle_om": "oracle", "persistence": "persistence", "lag24": "lag24", "forecast": "forecast", "forecast_full": "forecast"}.get(mode, "past_only")
    policy = dict.fromkeys(CALENDAR, "known") | {"temp_c": temp}
    if mode == "forecast_full":
        policy |= dict.fromkeys(FORECAST_EXTRAS, "fcst_extra")
    return policy | dict.fromkeys(gen, "oracle" if mode == "oracle" else "past_only")


def check_lead(meta: DataFrame, horizon: int) -> None:
    """Error if any BA's forecasts have a shorter lead than the horizon; reads one aggregated row."""
    worst = meta.where(F.col("fcst_lead_hours") > 0).agg(F.min_by("ba", "fcst_lead_hours").alias("ba"), F.min("fcst_lead_hours").alias("lead")).first()
    if worst and worst["lead"] is not None and horizon > worst["lead"]:
        raise ValueError(f"{worst['ba']}: the forecasts lead by {worst['lead']} h, the horizon is {horizon} h")


def lag_position(origin: Column, step: Column, n: Column, lag: int = 24) -> Column:
    """Position of the same hour of the last known day; longer horizons repeat that day."""
    return F.greatest(F.lit(0), F.least(n - 1, origin - lag + F.pmod(step, F.lit(lag))))


def future_covariate(indexed: DataFrame, origins: DataFrame, horizon: int, policy: str, value: str, source: str | None = None) -> DataFrame:
    """Rows (ba, origin, step, value) over the horizon under a policy.

    known and oracle read the realised rows, persistence freezes the row before the origin (row 0 at origin 0), lag24
    repeats the last known day, forecast and fcst_extra read the archived channel ``source``.
    """
    if policy == "past_only":
        raise ValueError("a past-only covariate has no future")
    spread = steps(origins, horizon)
    column = source if policy in ("forecast", "fcst_extra") else value
    if column not in indexed.columns:
        raise ValueError(f"policy {policy} needs the channel {column}")
    if policy == "persistence":
        at = F.greatest(F.lit(0), F.col("origin") - 1)
    elif policy == "lag24":
        sizes = indexed.groupBy("ba").agg((F.max("idx") + 1).alias("_n"))
        spread = spread.join(sizes, "ba")
        at = lag_position(F.col("origin"), F.col("step"), F.col("_n"))
    elif policy in ("known", "oracle", "forecast", "fcst_extra"):
        at = F.col("idx")
    else:
        raise ValueError(f"unknown policy {policy}")
    asked = spread.withColumn("_at", at.cast("bigint")).select("ba", "origin", "step", "_at")
    return asked.join(indexed.select("ba", F.col("idx").cast("bigint").alias("_at"), F.col(column).alias(value)), ["ba", "_at"]).drop("_at")


def future_channels(aligned: DataFrame, origins: DataFrame, horizon: int, channels: dict[str, str]) -> DataFrame:
    """Rows (ba, origin, step, *channels): archived forecasts over the horizon, each output named with its column."""
    absent = sorted(c for c in channels.values() if c not in aligned.columns)
    if absent:
        raise ValueError(f"no forecast channel {', '.join(absent)}")
    side = aligned.select("ba", F.col("idx").cast("bigint").alias("_at"), *(F.col(c).alias(name) for name, c in channels.items()))
    asked = steps(origins, horizon).withColumn("_at", F.col("idx").cast("bigint")).select("ba", "origin", "step", "_at")
    return asked.join(side, ["ba", "_at"]).drop("_at")


def baseline_temperature(indexed: DataFrame, origins: DataFrame, horizon: int, policy: str, source: str = "temp_fcst") -> DataFrame:
    """Rows (ba, origin, step, temp_c): what a classical baseline sees of temperature over the horizon.

    oracle, lag24 and forecast (where the channel is there) follow their policy.  All else is persistence: a baseline is
    trained with a temperature and must be given some, so a past-only one stays at its last value.
    """
    if policy == "forecast" and source not in indexed.columns:
        policy = "persistence"
    known = policy if policy in ("oracle", "lag24", "forecast") else "persistence"
    return future_covariate(indexed, origins, horizon, known, "temp_c", source)
