"""Split-conformal calibration of forecast intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .selection import exact_quantile


def conformal_delta(scored: DataFrame, coverage: float = 0.8, key: str = "ba") -> DataFrame:
    """Rows (ba, delta_mw): quantile of max(q_lo - y, y - q_hi) at min(ceil((n + 1) * coverage) / n, 1)."""
    scores = scored.where("y IS NOT NULL").withColumn("s", F.greatest(F.col("q_lo") - F.col("y"), F.col("y") - F.col("q_hi")))
    level = F.least(F.ceil((F.col("n") + 1) * F.lit(coverage) - F.lit(1e-9)) / F.col("n"), F.lit(1.0))
    return exact_quantile(stored(scores.select(key, "s"), "scores"), "s", level, key, "delta_mw")


def apply_delta(points: DataFrame, deltas: DataFrame, key: str = "ba", clamp: bool = True) -> DataFrame:
    """Widen (q_lo, q_hi) by the BA's delta and keep q_lo <= q_mid <= q_hi; the middle never moves.

    BAs match in any case; BAs without a delta and deltas that are not finite change nothing.
    """
    ok = deltas.select(F.upper(key).alias("_k"), F.col("delta_mw").cast("double").alias("_d")).where("_d IS NOT NULL AND NOT isnan(_d) AND abs(_d) < double('infinity')")
    met = points.withColumn("_k", F.upper(key)).join(ok, "_k", "left")
    d = F.coalesce("_d", F.lit(0.0))
    lo, hi = F.col("q_lo") - d, F.col("q_hi") + d
    if clamp:
        lo, hi = F.when(F.col("_d").isNull(), F.col("q_lo")).otherwise(F.least(lo, "q_mid")), F.when(F.col("_d").isNull(), F.col("q_hi")).otherwise(F.greatest(hi, "q_mid"))
    return met.withColumn("q_lo_new", lo).withColumn("q_hi", hi).withColumn("q_lo", F.col("q_lo_new")).drop("_k", "_d", "q_lo_new")
