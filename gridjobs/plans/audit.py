"""Leakage audits of the feature builder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUMP = 1.0e4


def audit_origins(meta: DataFrame, n: int = 3, horizon: int = 24) -> DataFrame:
    """Rows (ba, origin): lo + span * i div n in the test span, or in the validation span where test is too short."""
    test = F.col("test_end") - F.col("val_end") >= horizon
    lo = F.when(test, F.col("val_end")).otherwise(F.col("train_end"))
    hi = F.when(test, F.col("test_end")).otherwise(F.col("val_end")) - horizon
    spans = meta.select("ba", lo.alias("lo"), hi.alias("hi")).where("hi >= lo")
    return spans.select("ba", F.explode(F.expr(f"transform(sequence(0, {n - 1}), i -> lo + ((hi - lo) * i) div {n})")).alias("origin")).distinct()


def causal_audit(indexed: DataFrame, origins: DataFrame, build: Callable[[DataFrame, DataFrame], DataFrame], covariates: list[str], declared: list[str]) -> DataFrame:
    """Rows (ba, origin, covariate, problem): leaks and declared covariates that the builder does not produce.

    ``build(indexed, origins)`` gives rows (ba, origin, step, covariate, value).  Every listed covariate (calendar and
    archived channels are left out by the caller) is bumped at and after each origin; a value that changes has leaked.
    One origin's bump must not reach another's window, so origins are keyed into the series.
    """
    copies = indexed.join(origins, "ba").withColumn("ba", F.to_json(F.struct("ba", "origin")))
    keyed = origins.withColumn("ba", F.to_json(F.struct("ba", "origin")))
    bumped = copies.select(*(F.when(F.col("idx") >= F.col("origin"), F.col(c) + BUMP).otherwise(F.col(c)).alias(c) if c in covariates else F.col(c) for c in copies.columns))
    a, b = (build(x.drop("origin"), keyed) for x in (copies, bumped))
    both = a.withColumnRenamed("value", "v1").join(b.withColumnRenamed("value", "v2"), ["ba", "origin", "step", "covariate"], "full")
    leaks = both.where(~F.col("v1").eqNullSafe(F.col("v2"))).select("ba", "origin", "covariate", F.lit("leak").alias("problem")).distinct()
    want = keyed.withColumn("covariate", F.explode(F.array(*map(F.lit, declared))))
    absent = want.join(a.select("ba", "origin", "covariate").distinct(), ["ba", "origin", "covariate"], "left_anti").select("ba", "origin", "covariate", F.lit("missing").alias("problem"))
    return leaks.unionByName(absent).withColumn("ba", F.get_json_object("ba", "$.ba"))


def timestamp_only_audit(rows: DataFrame, columns: list[str], ts: str = "ts_utc") -> DataFrame:
    """Rows (covariate, timestamps): calendar covariates on which series disagree, and at how many timestamps."""
    long = rows.select(ts, F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(ts, "x.*")
    spread = long.groupBy(ts, "covariate").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    return spread.where(F.col("hi") - F.col("lo") > 1e-8 + 1e-5 * F.abs("hi")).groupBy("covariate").agg(F.count("*").alias("timestamps"))
