"""Ridge regression for each (series, hour of day) from sums that add up.

Nothing is gathered by group: a first aggregation gives each feature's mean and range, a second the sums of products of
centred features and target, 78 numbers a group whatever its rows.  The 11 by 11 system of a group is then solved in its
one row by elimination, which needs no pivoting as the ridge makes it positive definite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_features
from ..operators import series

FEATURES = ["lag24", "lag48", "lag168", "temp_c", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_holiday", "month"]
GROUP = ["ba", "hour"]


def moments(train: DataFrame) -> DataFrame:
    """Rows (ba, hour, n, y_mean, means, products): ``products`` is the upper triangle over the features and the target."""
    names = [*FEATURES, "y"]
    rows = train.select(*GROUP, *(F.col(c).cast("double").alias(c) for c in names)).dropna(subset=names)
    ranges = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{p}") for c in names for p, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))))
    # A feature without range is zero once centred; its mean may differ from it in the last digit.
    centred = rows.join(ranges, GROUP).select(*GROUP, "n", *(F.col(f"{c}_mean") for c in names), *(F.when(F.col(f"{c}_lo") == F.col(f"{c}_hi"), 0.0).otherwise(F.col(c) - F.col(f"{c}_mean")).alias(c) for c in names))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    sums = centred.groupBy(*GROUP, "n", *(f"{c}_mean" for c in names)).agg(F.array(*products).alias("products"))
    return sums.select(*GROUP, "n", F.col("y_mean"), F.array(*(f"{c}_mean" for c in FEATURES)).alias("means"), "products")


def solve(sums: DataFrame, ridge: float) -> DataFrame:
    """Rows (ba, hour, n, y_mean, means, scales, weights) of the standardised ridge system of each group."""
    k = len(FEATURES)
    place, at = {}, 0
    for i in range(k + 1):
        for j in range(i, k + 1):
            place[i, j] = place[j, i] = at
            at += 1
    product = lambda i, j: f"products[{place[i, j]}]"
    scales = "array(" + ", ".join(f"IF({product(i, i)} > 0, sqrt({product(i, i)} / n), 1D)" for i in range(k)) + ")"
    row = lambda i: "array(" + ", ".join([*(f"{product(i, j)} / (scales[{i}] * scales[{j}])" + (f" + {ridge!r}D" if i == j else "") for j in range(k)), f"{product(i, k)} / scales[{i}]"]) + ")"
    system = "array(" + ", ".join(row(i) for i in range(k)) + ")"
    eliminated = f"""aggregate(sequence(0, {k - 1}), system, (a, p) -> transform(a, (r, i) -> IF(i = p,
        transform(r, x -> x / a[p][p]), zip_with(r, a[p], (x, y) -> x - r[p] * y / a[p][p]))))"""
    met = sums.withColumn("scales", F.expr(scales)).withColumn("system", F.expr(system)).withColumn("solved", F.expr(eliminated))
    return met.select(*GROUP, "n", "y_mean", "means", "scales", F.expr(f"transform(solved, r -> r[{k}])").alias("weights"))


def hourly_regression(features: DataFrame, ridge: float = 1.0, min_rows: int = 100) -> DataFrame:
    """Rows (ba, idx, y, mean) of the test rows, each predicted by its (ba, hour)'s ridge on standardised features.

    ``features``: ba, idx, hour, is_train, y, lag24 and FEATURES.  Hours with fewer than ``min_rows`` training rows fall
    back to lag24.  Training rows with a null feature are left out.
    """
    fitted = solve(moments(features.where("is_train")).where(f"n >= {min_rows}"), ridge)
    met = features.where("NOT is_train").join(fitted, GROUP, "left")
    own = [f"(cast({c} AS double) - means[{i}]) / scales[{i}] * weights[{i}]" for i, c in enumerate(FEATURES)]
    return met.select("ba", F.col("idx").cast("bigint").alias("idx"), "y", F.when(F.col("n").isNull(), F.col("lag24")).otherwise(F.expr("y_mean + " + " + ".join(own))).alias("mean"))


def regression_features(indexed: DataFrame, meta: DataFrame, holidays: DataFrame, horizon: int = 24) -> DataFrame:
    """Features of ``hourly_regression``: test rows see the temperature of the row before their day's origin."""
    lagged = series.seasonal_lags(calendar_features(indexed, holidays)).join(meta.select("ba", "train_end", "val_end"), "ba")
    origin = F.col("val_end") + F.floor((F.col("idx") - F.col("val_end")) / horizon) * horizon
    test = lagged.where("idx >= val_end").withColumn("_at", (origin - 1).cast("bigint")).drop("temp_c").join(indexed.select("ba", F.col("idx").cast("bigint").alias("_at"), "temp_c"), ["ba", "_at"])
    train = lagged.where("idx < train_end AND idx >= 168")
    cols = ["ba", F.col("idx").cast("bigint").alias("idx"), F.hour("ts_utc").alias("hour"), F.col("load_mw").alias("y"), *(c for c in FEATURES if c != "month"), F.month("ts_utc").alias("month")]
    return train.select(*cols, F.lit(True).alias("is_train")).unionByName(test.select(*cols, F.lit(False).alias("is_train")))
