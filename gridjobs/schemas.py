"""Canonical tables and their enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOAD = "ts_utc timestamp, ba string, load_mw double, source string, as_of timestamp"
LMP = "ts_utc timestamp, iso string, node string, market string, lmp_usd_per_mwh double, energy_usd_per_mwh double, congestion_usd_per_mwh double, losses_usd_per_mwh double, source string, as_of timestamp"
GEN_BY_FUEL = "ts_utc timestamp, ba string, fuel string, gen_mw double, source string, as_of timestamp"
WEATHER_HOURLY = "ts_utc timestamp, temp_c double, station string, ba string, source string, as_of timestamp"
WEATHER_FCST_HOURLY = "ts_utc timestamp, temp_c_fcst double, temp_c_anal double, rad_wm2_fcst double, wind100_fcst double, temp_spread_c double, ba string, lead_hours int, source string, as_of timestamp"
MANIFEST = "source string, key string, fetched_at timestamp, n_rows bigint, sha256 string"
REGISTRY = "position int, code string, name string, interconnect string, utc_offset int, station string, has_demand boolean, is_rto boolean, centroid struct<lon: double, lat: double>, peak_mw int"
TABLES = {"load_hourly": LOAD, "lmp": LMP, "gen_by_fuel": GEN_BY_FUEL, "weather_hourly": WEATHER_HOURLY, "weather_fcst_hourly": WEATHER_FCST_HOURLY}


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a schema string without nested commas."""
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(",")]


def missing(df: DataFrame, schema: str) -> list[str]:
    """Names that the schema has and the frame lacks, sorted."""
    return sorted({name for name, _ in columns(schema)} - set(df.columns))


def enforce(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; further columns are dropped, absent ones are an error."""
    absent = missing(df, schema)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns(schema)))
