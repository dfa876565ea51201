"""Jobs over all series at once: feature table, backtest, comparison, ensemble, calibration, serving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_features
from ..operators import conformal, joins, metrics, peers, series
from ..session import stored


def prepare(load: DataFrame, splits: tuple[str, str, str], k: float = 20.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled and indexed series, split bounds, denominators) of a deduplicated load table.

    Bounds, denominators, forecasts and truths all read the prepared series, so it is written once.
    """
    cleaned = series.robust_clean(stored(load, "load"), k=k)
    indexed = stored(series.row_index(series.fill(cleaned)), "indexed")
    meta = series.split_bounds(indexed, *splits)
    return indexed, meta, series.mase_denominator(indexed, meta)


def feature_table(load: DataFrame, weather: DataFrame, gen: DataFrame, archived: DataFrame, holidays: DataFrame, splits: tuple[str, str, str], mode: str = "forecast", k: float = 20.0, n_peers: int = 2, extras: dict[str, str] | None = None) -> DataFrame:
    """Load, weather, generation, archived forecasts, calendar and peers for all series in one frame.

    ``extras`` maps further forecast channels (irradiance, wind, spread of the models) to the archive's columns.
    Dedupe comes first, as a revision can be the outlier; cleaning precedes filling; lags count rows after that.
    """
    latest = stored(series.dedupe_latest(load), "latest")
    cleaned = series.robust_clean(latest, k=k)
    joined = joins.gen_pivot(joins.left_on_ts(cleaned, weather), gen)
    filled = joined
    for c in ("load_mw", "temp_c", "WND", "SUN"):
        filled = series.fill(filled, c)
    indexed = stored(series.row_index(filled), "features")
    aligned = joins.analysis_past(joins.forecast_alignment(indexed, archived, extras), mode)
    dated = calendar_features(aligned, holidays)
    best = peers.top_peers(peers.peer_correlation(indexed.select("ba", "ts_utc", "load_mw"), splits[0]), n_peers)
    return peers.peer_channels(dated, best, n_peers)


def naive_backtest(indexed: DataFrame, meta: DataFrame, denom: DataFrame, horizon: int = 24, step: int = 24, season: int = 24, start: str = "val_end", end: str = "test_end") -> tuple[DataFrame, DataFrame]:
    """(scored rows, metrics by series) of the seasonal-naive forecast."""
    origins = series.rolling_origins(meta, start, end, horizon, step, season)
    scored = series.with_truth(series.forecast_seasonal_naive(indexed, origins, horizon, season), indexed)
    return scored, metrics.point_metrics(scored, denom)


def backtest(indexed: DataFrame, meta: DataFrame, denom: DataFrame, horizon: int = 24, step: int = 24, season: int = 24, width: float = 0.1, coverage: float = 0.8, replicates: int = 200, seed: int = 0) -> DataFrame:
    """The whole report of the seasonal-naive forecast with a band: rows by series, MACRO, and MACRO by step ahead.

    Columns ba, step, mae, rmse, mase, n_points, n_windows, ci_lo, ci_hi, delta_mw, coverage_raw, coverage.  The interval
    (ci) is the bootstrap's over pooled windows; each series' band is widened by the delta that the split before the
    scored one gives (none: 0), without a clamp; a step's mase is the mean over series.
    """
    scored, per = naive_backtest(indexed, meta, denom, horizon, step, season)
    scored = stored(with_band(scored, width), "scored")
    before, _ = naive_backtest(indexed, meta, denom, horizon, step, season, "train_end", "val_end")
    deltas = conformal.conformal_delta(with_band(before, width), coverage)
    widened = conformal.apply_delta(scored, deltas, clamp=False)
    inside = metrics.coverage(scored).withColumnRenamed("coverage", "coverage_raw").join(metrics.coverage(widened), "ba")
    series_rows = stored(per.join(deltas, "ba", "left").join(inside, "ba", "left").fillna(0.0, ["delta_mw"]), "series")
    means = ["mae", "rmse", "mase", "delta_mw", "coverage_raw", "coverage"]
    total = series_rows.agg(*(F.avg(c).alias(c) for c in means), *(F.sum(c).alias(c) for c in ("n_points", "n_windows"))).where("n_points IS NOT NULL")
    pooled = metrics.bootstrap_ci(metrics.window_errors(scored, denom), replicates, seed).select(F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    macro = total.join(F.broadcast(pooled)).withColumn("ba", F.lit("MACRO"))
    steps = metrics.step_mase(scored, denom).withColumn("ba", F.lit("MACRO"))
    rows = series_rows.unionByName(macro, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    return rows.select("ba", F.col("step").cast("int").alias("step"), "mae", "rmse", "mase", "n_points", "n_windows", "ci_lo", "ci_hi", "delta_mw", "coverage_raw", "coverage")


def with_band(scored: DataFrame, width: float = 0.1) -> DataFrame:
    """A simple band of the mean times 1 -+ width."""
    return scored.withColumn("q_lo", F.col("mean") * (1 - width)).withColumn("q_mid", F.col("mean")).withColumn("q_hi", F.col("mean") * (1 + width))


def operator_comparison(actual: DataFrame, own: DataFrame, operator: DataFrame, denom: DataFrame) -> DataFrame:
    """Rows (ba, n, mae_own, mae_op, mase_own, mase_op, mae_ratio) on the timestamps that all three share."""
    keys = ["ba", "ts_utc"]
    own, operator = (x.select(*keys, F.col("forecast_mw").alias(c)) for x, c in ((own, "own"), (operator, "op")))
    both = actual.select(*keys, "load_mw").join(own, keys).join(operator, keys)
    miss = {c: F.abs(F.col(c) - F.col("load_mw")) for c in ("own", "op")}
    per = both.groupBy("ba").agg(F.count(miss["own"]).alias("n"), *(F.avg(m).alias(f"mae_{c}") for c, m in miss.items()))
    per = per.join(denom, "ba", "left")
    return per.select("*", *(F.try_divide(f"mae_{c}", "denom").alias(f"mase_{c}") for c in miss)).drop("denom").withColumn("mae_ratio", F.try_divide("mae_op", "mae_own"))


def conformal_fit(scored: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Published deltas: rounded to two decimals, zeros left out."""
    return conformal.conformal_delta(scored, coverage).withColumn("delta_mw", F.round("delta_mw", 2)).where("delta_mw <> 0")


def serve_batch(indexed: DataFrame, holidays: DataFrame, weather: DataFrame, context: int, horizon: int) -> DataFrame:
    """Request rows (ba, step, ts_utc, calendar, temp_c) for each BA that has ``context`` rows.

    Weather is used only when it covers the whole horizon; it is null otherwise, never a flat value.
    """
    enough = indexed.groupBy("ba").agg(F.count("*").alias("_n")).where(F.col("_n") >= context).select("ba")
    hours = series.next_hours(indexed.join(enough, "ba", "left_semi"), horizon)
    hours = hours.withColumn("step", F.row_number().over(Window.partitionBy("ba").orderBy("ts_utc")) - 1)
    met = calendar_features(hours, holidays).join(weather.select("ba", "ts_utc", "temp_c"), ["ba", "ts_utc"], "left")
    covered = F.count("temp_c").over(Window.partitionBy("ba")) == horizon
    return met.withColumn("temp_c", F.when(covered, F.col("temp_c")))


Model = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def run_forecaster(contexts: DataFrame, model: Model, horizon: int) -> DataFrame:
    """Apply a model (context[N, C], horizon) -> (quantiles[N, H, 3], mean[N, H]) to rows (ba, origin, context array).

    Contexts of one length in a batch are stacked; output rows (ba, origin, step, q_lo, q_mid, q_hi, mean).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, own in batch.groupby(batch["context"].map(len)):
                q, mean = model(np.stack(own["context"].to_numpy()), horizon)
                n = len(own)
                yield pd.DataFrame({"ba": np.repeat(own["ba"].to_numpy(), horizon), "origin": np.repeat(own["origin"].to_numpy(), horizon), "step": np.tile(np.arange(horizon), n), "q_lo": q[:, :, 0].ravel(), "q_mid": q[:, :, 1].ravel(), "q_hi": q[:, :, 2].ravel(), "mean": mean.ravel()})

    return contexts.select("ba", "origin", "context").mapInPandas(run, "ba string, origin bigint, step int, q_lo double, q_mid double, q_hi double, mean double")


def seasonal_naive_model(season: int = 24) -> Model:
    def model(context: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        mean = context[:, context.shape[1] - season + np.arange(horizon) % season]
        return np.repeat(mean[:, :, None], 3, 2), mean

    return model


def persistence_model(context: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    mean = np.repeat(context[:, -1:], horizon, 1)
    return np.repeat(mean[:, :, None], 3, 2), mean


MODELS: dict[str, Model] = {"persistence": persistence_model, "seasonal_naive_24": seasonal_naive_model(24), "seasonal_naive_168": seasonal_naive_model(168)}
