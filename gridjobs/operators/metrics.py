"""Scores of point and probabilistic forecasts.

Scored rows: (ba, origin, step, y, mean, q_lo, q_mid, q_hi); rows whose truth is null are not scored.  Point errors use
the mean.  Macro figures are unweighted means of per-series figures, never pooled ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.when(y >= q, tau * (y - q)).otherwise((1 - tau) * (q - y))


def point_metrics(scored: DataFrame, denom: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (ba, mae, rmse, mase, n_points, n_windows)."""
    err = F.abs(F.col("y") - F.col("mean"))
    per = scored.where("y IS NOT NULL").groupBy(key).agg(F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count("*").alias("n_points"), F.countDistinct("origin").alias("n_windows"))
    return per.join(denom, key).select(key, "mae", "rmse", F.try_divide("mae", "denom").alias("mase"), "n_points", "n_windows")


def crps(scored: DataFrame, taus: tuple[float, ...] = (0.1, 0.5, 0.9), columns: tuple[str, ...] = ("q_lo", "q_mid", "q_hi"), key: str = "ba") -> DataFrame:
    """Rows (ba, crps): mean over levels of the mean pinball loss."""
    losses = [F.avg(pinball(F.col("y"), F.col(c), t)) for t, c in zip(taus, columns)]
    return scored.where("y IS NOT NULL").groupBy(key).agg((sum(losses[1:], losses[0]) / len(losses)).alias("crps"))


def coverage(scored: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (ba, coverage): share of truths inside the interval, ends included."""
    inside = F.col("y").between(F.col("q_lo"), F.col("q_hi")).cast("double")
    return scored.where("y IS NOT NULL").groupBy(key).agg(F.avg(inside).alias("coverage"))


def coverage_label(low: float, high: float) -> str:
    return f"cov_pi{round((high - low) * 100)}"


def error_scores(pairs: DataFrame, denom: DataFrame | None = None, key: str = "ba") -> DataFrame:
    """Rows (ba, n, mae, rmse, mape, bias[, mase]) of (actual, forecast) pairs; MAPE's denominator is at least 1."""
    err = F.col("forecast") - F.col("actual")
    out = pairs.where("actual IS NOT NULL AND forecast IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), (100 * F.avg(F.abs(err) / F.greatest(F.col("actual"), F.lit(1.0)))).alias("mape"), F.avg(err).alias("bias"))
    return out.join(denom, key, "left").withColumn("mase", F.try_divide("mae", "denom")).drop("denom") if denom is not None else out


def week_mape(pairs: DataFrame, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Rows (ba, mape, peak_error): denominators of 0 or less become 1; the signed error at the first greatest actual."""
    err = F.col("forecast") - F.col("actual")
    top = Window.partitionBy(key).orderBy(F.desc("actual"), ts)
    placed = pairs.withColumn("_n", F.row_number().over(top))
    return placed.groupBy(key).agg((100 * F.avg(F.abs(err) / F.when(F.col("actual") > 0, F.col("actual")).otherwise(1.0))).alias("mape"), F.max(F.when(F.col("_n") == 1, err)).alias("peak_error"))


def macro(per_series: DataFrame, columns: list[str]) -> DataFrame:
    return per_series.agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n_series"))


def holdout_flags(codes: DataFrame, fraction: float = 0.2, key: str = "ba") -> DataFrame:
    """Rows (ba, holdout): every k-th of the sorted codes, k = max(round(1 / fraction), 2).  One row a series.

    Codes are sorted by range and numbered within each part, after the rows of earlier parts, of which there are few.
    """
    k = max(round(1 / fraction), 2)
    parts = stored(codes.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "codes")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1 + F.col("_first")
    return parts.join(starts, "_p").select(key, (F.pmod(place, F.lit(k)) == 0).alias("holdout"))


def holdout_gap(per_series: DataFrame, metric: str = "mase", fraction: float = 0.2, key: str = "ba") -> DataFrame:
    met = per_series.join(holdout_flags(per_series, fraction, key), key)
    tuned, held = F.avg(F.when(~F.col("holdout"), F.col(metric))), F.avg(F.when(F.col("holdout"), F.col(metric)))
    return met.agg(tuned.alias("tuned"), held.alias("holdout")).withColumn("gap", F.col("holdout") - F.col("tuned"))


def step_mase(scored: DataFrame, denom: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (step, mase): per series mean absolute error of the step over its denominator, then the mean over series."""
    per = scored.where("y IS NOT NULL").groupBy(key, "step").agg(F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae")).join(denom, key)
    return per.groupBy("step").agg(F.avg(F.try_divide("mae", "denom")).alias("mase"))


def break_even(by_step: DataFrame, level: float = 1.0) -> DataFrame:
    return by_step.agg(F.min(F.when(F.col("mase") >= level, F.col("step") + 1)).alias("break_even"))


def skill(own: DataFrame, baseline: DataFrame, metric: str = "mae", key: str = "ba") -> DataFrame:
    """Rows (ba, own, baseline, ratio, improvement_pct)."""
    met = own.select(key, F.col(metric).alias("own")).join(baseline.select(key, F.col(metric).alias("baseline")), key)
    return met.withColumn("ratio", F.try_divide("baseline", "own")).withColumn("improvement_pct", 100 * (1 - F.try_divide("own", "baseline")))


def window_errors(scored: DataFrame, denom: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (ba, origin, err): MASE of each window over its valid points."""
    per = scored.where("y IS NOT NULL").groupBy(key, "origin").agg(F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae"))
    return per.join(denom, key).select(key, "origin", F.try_divide("mae", "denom").alias("err"))


def poisson_weight(name: Column) -> Column:
    """A Poisson(1) number from 0 to 8 drawn from a name: the same in every run and on every cluster."""
    u = F.conv(F.substr(F.md5(name), F.lit(1), F.lit(8)), 16, 10).cast("double") / 2**32
    limits, p = [], math.exp(-1)
    for k in range(8):
        limits.append(sum(limits[-1:]) + p / math.factorial(k))
    return sum(((u >= x).cast("int") for x in limits), F.lit(0))


def bootstrap_ci(errors: DataFrame, replicates: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(lo, hi): percentile interval of the mean of pooled window errors (ba, origin, err).

    Each replicate weights each window by its own Poisson(1) draw, the large-sample form of drawing with replacement, so
    nothing is collected: weights come from a hash of (seed, replicate, ba, origin) and partial sums by replicate are
    all that is shuffled.
    """
    each = errors.where("err IS NOT NULL").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = poisson_weight(F.concat_ws("/", F.lit(str(seed)), "b", "ba", F.col("origin").cast("bigint")))
    means = each.withColumn("w", w).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("err")), F.sum("w")).alias("mean"))
    return _interval(means.where("mean IS NOT NULL"), level)


def exact_draws(errors: DataFrame, replicates: int = 2000, seed: int = 0, block: int = 4096, most_blocks: int = 10_000) -> DataFrame:
    """Rows (b, draws, mean): for each replicate exactly n draws with replacement from the n pooled windows.

    Windows are dealt to blocks by hash.  A replicate's n draws are parted over the blocks by a multinomial (binomial
    steps, one block after another) and then, in each block's task, over its windows.  The sizes of at most
    ``most_blocks`` blocks are all that the driver sees; a block's task holds its windows and a count a replicate.
    """
    rows = errors.where("err IS NOT NULL").select("ba", F.col("origin").cast("bigint").alias("origin"), F.col("err").cast("double").alias("err"))
    n = rows.count()
    blocks = max(1, min(most_blocks, -(-n // block)))
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("ba", "origin"), F.lit(blocks))), "windows")
    sizes = np.zeros(blocks, np.int64)
    for r in rows.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                m = np.random.default_rng([seed, b]).multinomial(n, sizes / max(n, 1))
                some = np.flatnonzero(m)
                yield pa.RecordBatch.from_pydict({"b": np.full(len(some), b), "block": some, "m": m[some]})

    def draw(key: tuple, windows: pa.Table, parts: pa.Table) -> pa.Table:
        err = windows.sort_by([("ba", "ascending"), ("origin", "ascending")]).column("err").to_numpy()
        bs, ms = parts.column("b").to_numpy(), parts.column("m").to_numpy()
        sums = [err[np.random.default_rng([seed, b, key[0].as_py()]).integers(0, len(err), m)].sum() for b, m in zip(bs.tolist(), ms.tolist())]
        return pa.table({"b": pa.array(bs, pa.int64()), "draws": pa.array(ms, pa.int64()), "total": pa.array(sums, pa.float64())})

    spark = errors.sparkSession
    parts = spark.range(replicates if n else 0).mapInArrow(part, "b long, block long, m long")
    drawn = rows.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(draw, "b long, draws long, total double")
    return drawn.groupBy("b").agg(F.sum("draws").alias("draws"), (F.sum("total") / F.sum("draws")).alias("mean"))


def bootstrap_ci_exact(errors: DataFrame, replicates: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(lo, hi, replicates): percentile interval of the mean, each replicate of exactly as many draws as windows."""
    return _interval(exact_draws(errors, replicates, seed), level)


def _interval(means: DataFrame, level: float) -> DataFrame:
    return means.agg(F.percentile("mean", (1 - level) / 2).alias("lo"), F.percentile("mean", (1 + level) / 2).alias("hi"), F.count("*").alias("replicates"))


def weather_skill(pairs: DataFrame, key: str = "ba") -> DataFrame:
    """Rows (ba, mae, rmse, corr, bias) of temp_c_fcst against temp_c_anal."""
    err = F.col("temp_c_fcst") - F.col("temp_c_anal")
    return pairs.where("temp_c_fcst IS NOT NULL AND temp_c_anal IS NOT NULL").groupBy(key).agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.try_divide(F.covar_pop("temp_c_fcst", "temp_c_anal"), F.stddev_pop("temp_c_fcst") * F.stddev_pop("temp_c_anal")).alias("corr"), F.avg(err).alias("bias"))


def forecast_stats(points: DataFrame, horizon: int = 24, key: str = "ba") -> DataFrame:
    """Rows (ba, peak, peak_step, mean, pi_pct_first, peak_over_mean_pct, peak_all) of points (step, lo, median, hi).

    The first maximum wins; the interval width at the first step is in percent of its median.
    """
    inside = F.col("step") < horizon
    top = Window.partitionBy(key).orderBy(F.desc(F.when(inside, F.col("median"))), "step")
    placed = points.withColumn("_n", F.row_number().over(top))
    out = placed.groupBy(key).agg(F.max(F.when(inside, F.col("median"))).alias("peak"), F.max(F.when(F.col("_n") == 1, F.col("step"))).alias("peak_step"), F.avg(F.when(inside, F.col("median"))).alias("mean"), F.max(F.when(F.col("step") == 0, F.try_divide(100 * (F.col("hi") - F.col("lo")), F.col("median")))).alias("pi_pct_first"), F.max("median").alias("peak_all"))
    return out.withColumn("peak_over_mean_pct", 100 * (F.try_divide("peak", "mean") - 1))


def peak_utilisation(points: DataFrame, peaks: DataFrame, horizon: int = 24, key: str = "ba") -> DataFrame:
    """Rows (ba, utilisation, status): greatest median of the first steps in percent of the peak (0 without one)."""
    top = points.where(F.col("step") < horizon).groupBy(key).agg(F.max("median").alias("top")).join(peaks, key, "left")
    used = F.when(F.coalesce("peak_mw", F.lit(0)) > 0, 100 * F.col("top") / F.col("peak_mw")).otherwise(0.0)
    return top.select(key, used.alias("utilisation")).withColumn("status", F.when(F.col("utilisation") >= 85, "near-peak").when(F.col("utilisation") >= 55, "moderate").otherwise("low"))


def ensemble(forecasts: DataFrame, key: str = "ba") -> DataFrame:
    """Average of several models' rows (model, ba, origin, step, mean, q_lo, q_mid, q_hi)."""
    return forecasts.groupBy(key, "origin", "step", "idx").agg(*(F.avg(c).alias(c) for c in ("mean", "q_lo", "q_mid", "q_hi")))
