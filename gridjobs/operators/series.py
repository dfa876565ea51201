"""Hourly series in long form, keyed (ba, ts_utc): revisions, outliers, positions, gaps, lags, origins.

Lags, splits and windows are positional: they count rows of the series, not hours.  NaN becomes null on entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .selection import exact_quantile

MAD_SCALE = 1.4826
CEILING_MW = 500_000.0


def no_nan(x: str) -> Column:
    return F.when(~F.isnan(x), F.col(x))


def over_series(key: str = "ba", ts: str = "ts_utc"):
    return Window.partitionBy(key).orderBy(ts)


def dedupe_latest(rows: DataFrame, keys: list[str] = ("ba", "ts_utc"), as_of: str | None = "as_of", ties: list[str] = ()) -> DataFrame:
    """One row a key: the greatest ``as_of`` (nulls last), then the greatest of ``ties``; else the greatest row overall."""
    order = [F.col(c).desc_nulls_last() for c in ([as_of] if as_of and as_of in rows.columns else []) + list(ties)]
    if not order:
        order = [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mad_stats(rows: DataFrame, value: str = "load_mw", key: str = "ba", most: int = 1_000_000) -> DataFrame:
    """Rows (ba, med, mad).  The statistics have a row a series and are joined back, so series never gather in a window.

    A median's aggregation holds a series' values; beyond ``most`` rows in the largest series both medians come from
    selection by narrowing instead, which holds none and gives the same values.
    """
    largest = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        rows = rows.select(key, no_nan(value).alias("_x"))
        med = stored(exact_quantile(rows, "_x", F.lit(0.5), key, "med"), "med")
        mad = exact_quantile(rows.join(med, key).withColumn("_x", F.abs(F.col("_x") - F.col("med"))), "_x", F.lit(0.5), key, "mad")
        return rows.select(key).distinct().join(med, key, "left").join(mad, key, "left")
    med = rows.groupBy(key).agg(F.median(no_nan(value)).alias("med"))
    return rows.join(med, key).groupBy(key).agg(F.first("med").alias("med"), F.median(F.abs(no_nan(value) - F.col("med"))).alias("mad"))


def robust_clean(rows: DataFrame, value: str = "load_mw", key: str = "ba", k: float = 20.0, ceiling: float = CEILING_MW) -> DataFrame:
    """Null where the value is over the ceiling or beyond k scaled MADs of its series' median (not where the MAD is 0)."""
    met = rows.join(mad_stats(rows, value, key), key, "left")
    far = (F.col("mad") > 0) & (F.abs(F.col(value) - F.col("med")) > k * MAD_SCALE * F.col("mad"))
    bad = F.coalesce(far, F.lit(False)) | (F.abs(value) > ceiling)
    return met.withColumn(value, F.when(~bad, no_nan(value))).drop("med", "mad")


def row_index(rows: DataFrame, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    return rows.withColumn("idx", F.row_number().over(over_series(key, ts)) - 1)


def fill(rows: DataFrame, value: str = "load_mw", key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Forward fill; a leading gap takes the first value; a series without values is 0."""
    w = over_series(key, ts)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(before, first, F.lit(0.0)))


def block_fill(rows: DataFrame, value: str, keys: list[str], ts: str = "ts_utc") -> DataFrame:
    """Forward fill of very long series: windows within (keys, month), the last value of earlier months carried over a
    table of one row a month."""
    rows = rows.withColumn("_m", F.trunc(ts, "month"))
    w = Window.partitionBy(*keys, "_m").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_m").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", True).over(earlier)).drop("_end")
    return rows.join(carried, [*keys, "_m"]).withColumn(value, F.coalesce(F.last(value, True).over(w), "_carry")).drop("_m", "_carry")


def split_bounds(rows: DataFrame, train_end: str, val_end: str, test_end: str, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Rows (ba, n, train_end, val_end, test_end): numbers of rows before each time."""
    before = lambda t: F.count(F.when(F.col(ts) < F.lit(t).cast("timestamp"), 1))
    return rows.groupBy(key).agg(F.count("*").alias("n"), before(train_end).alias("train_end"), before(val_end).alias("val_end"), before(test_end).alias("test_end"))


def inner_split(meta: DataFrame, from_forecast: bool, validation: int = 8760) -> DataFrame:
    """Training span without its tail for early stopping: (inner_start, inner_end)."""
    start = F.coalesce("fcst_start", F.lit(0)) if from_forecast else F.lit(0)
    return meta.withColumn("inner_start", start).withColumn("inner_end", F.greatest(F.col("train_end") - validation, F.expr("train_end div 2")))


def mase_denominator(indexed: DataFrame, meta: DataFrame, value: str = "load_mw", key: str = "ba", lag: int = 24) -> DataFrame:
    """Rows (ba, denom): mean absolute positional seasonal difference on the training rows of a filled series."""
    diff = F.abs(F.col(value) - F.lag(value, lag).over(Window.partitionBy(key).orderBy("idx")))
    return indexed.withColumn("_d", diff).join(meta.select(key, "train_end"), key).where("idx < train_end").groupBy(key).agg(F.avg("_d").alias("denom"))


def mase_denominator_dropna(rows: DataFrame, train_end: str, value: str = "load_mw", key: str = "ba", ts: str = "ts_utc", lag: int = 24) -> DataFrame:
    """The variant that drops nulls before counting positions."""
    kept = rows.where(F.col(value).isNotNull() & (F.col(ts) < F.lit(train_end).cast("timestamp")))
    diff = F.abs(F.col(value) - F.lag(value, lag).over(over_series(key, ts)))
    return kept.withColumn("_d", diff).groupBy(key).agg(F.avg("_d").alias("denom"))


def seasonal_lags(indexed: DataFrame, lags: tuple[int, ...] = (24, 48, 168), value: str = "load_mw", key: str = "ba") -> DataFrame:
    """Add lag24, lag48, ...; 0.0 before the start."""
    w = Window.partitionBy(key).orderBy("idx")
    return indexed.select("*", *(F.lag(value, k, 0.0).over(w).alias(f"lag{k}") for k in lags))


def rolling_origins(meta: DataFrame, start: str = "val_end", end: str = "test_end", horizon: int = 24, step: int = 24, context: int = 0, key: str = "ba") -> DataFrame:
    """Rows (ba, origin): start, start + step, ... while origin + horizon <= end and origin - context >= 0."""
    last = F.col(end) - horizon
    ok = meta.where(last >= F.col(start)).select(key, F.explode(F.sequence(F.col(start), last, F.lit(step).cast("bigint"))).alias("origin"))
    return ok.where(F.col("origin") >= context)


def steps(origins: DataFrame, horizon: int) -> DataFrame:
    """Rows (ba, origin, step, idx) over the horizon."""
    return origins.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("idx", F.col("origin") + F.col("step"))


def window_rows(indexed: DataFrame, origins: DataFrame, horizon: int, value: str = "load_mw", key: str = "ba") -> DataFrame:
    """Truths of each origin's horizon by an equi-join on the position."""
    return steps(origins, horizon).join(indexed.select(key, "idx", F.col(value).alias("y")), [key, "idx"])


def context_rows(indexed: DataFrame, origins: DataFrame, context: int, value: str = "load_mw", key: str = "ba") -> DataFrame:
    """Rows (ba, origin, back, x): the ``context`` values before each origin, back = 1 the latest."""
    spread = origins.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(context)))).withColumn("idx", F.col("origin") - F.col("back"))
    return spread.join(indexed.select(key, "idx", F.col(value).alias("x")), [key, "idx"]).drop("idx")


def training_pairs(indexed: DataFrame, meta: DataFrame, context: int, horizon: int, stride: int, value: str = "load_mw", key: str = "ba") -> DataFrame:
    """Rows (ba, idx, context array, target array) over the training rows, every ``stride`` positions.

    Windows start at multiples of the stride, so they are made of whole chunks of that many rows: each chunk goes to the
    windows that contain it, and only windows that are kept are ever built.  Those with a null value are left out.
    """
    train = indexed.join(meta.select(key, "train_end"), key).where("idx < train_end")
    chunks = train.groupBy(key, F.expr(f"idx div {stride}").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("part"))
    n = -(-(context + horizon) // stride)
    parts = chunks.withColumn("_w", F.explode(F.expr(f"sequence(greatest(0L, _c - {n - 1}), _c)")))
    whole = parts.groupBy(key, "_w").agg(F.expr("transform(flatten(array_sort(collect_list(part))), x -> x.v)").alias("all"))
    pairs = whole.select(key, (F.col("_w") * stride + context).cast("int").alias("idx"), F.slice("all", 1, context).alias("context"), F.slice("all", context + 1, horizon).alias("target"))
    return pairs.where((F.size("target") == horizon) & ~F.exists("context", F.isnull) & ~F.exists("target", F.isnull))


def forecast_seasonal_naive(indexed: DataFrame, origins: DataFrame, horizon: int, season: int = 24, value: str = "load_mw", key: str = "ba") -> DataFrame:
    """Rows (ba, origin, step, idx, mean): y[origin - season + step mod season]."""
    source = steps(origins, horizon).withColumn("_at", F.col("origin") - season + F.pmod(F.col("step"), F.lit(season)))
    return source.join(indexed.select(key, F.col("idx").alias("_at"), F.col(value).alias("mean")), [key, "_at"]).drop("_at")


def forecast_persistence(indexed: DataFrame, origins: DataFrame, horizon: int, value: str = "load_mw", key: str = "ba") -> DataFrame:
    last = origins.withColumn("_at", F.col("origin") - 1).join(indexed.select(key, F.col("idx").alias("_at"), F.col(value).alias("mean")), [key, "_at"]).drop("_at")
    return last.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("idx", F.col("origin") + F.col("step"))


def with_truth(forecast: DataFrame, indexed: DataFrame, value: str = "load_mw", key: str = "ba") -> DataFrame:
    return forecast.join(indexed.select(key, "idx", F.col(value).alias("y")), [key, "idx"])


def hourly_spine(rows: DataFrame, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Every hour from a series' first to its last."""
    ends = rows.groupBy(key).agg(F.date_trunc("hour", F.min(ts)).alias("a"), F.date_trunc("hour", F.max(ts)).alias("b"))
    return ends.select(key, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias(ts))


def next_hours(rows: DataFrame, horizon: int, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """The ``horizon`` hours after each series' last row."""
    return rows.groupBy(key).agg(F.max(ts).alias("b")).select(key, F.explode(F.expr(f"sequence(b + interval 1 hour, b + interval {horizon} hour, interval 1 hour)")).alias(ts))


def flatline_runs(indexed: DataFrame, value: str = "load_mw", key: str = "ba", extra: list[str] = ()) -> DataFrame:
    """Rows (ba, longest): the longest run of identical consecutive values, in rows (gaps and islands)."""
    by = [key, *extra]
    w = Window.partitionBy(*by).orderBy("idx")
    change = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
    runs = indexed.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.count("*").alias("len")).groupBy(*by).agg(F.max("len").alias("longest"))


def peak_week(indexed: DataFrame, meta: DataFrame, anchor: str, floor_ba: str | None = None, floor: float = 5000.0, hours: int = 168, run: int = 8, key: str = "ba", value: str = "load_mw") -> DataFrame:
    """Rows (week, peak), at most one: the anchor's test week (candidates every 24 h) with the greatest peak.

    Weeks in which any series is short or flat for ``run`` hours, or in which ``floor_ba`` falls below ``floor``, are out;
    of equal peaks the first week wins.
    """
    test = indexed.join(meta.select(key, F.col("val_end").alias("_v"), F.col("n").alias("_n")), key).where("idx >= _v").withColumn("rel", F.col("idx") - F.col("_v"))
    weeks = test.withColumn("week", F.explode(F.expr(f"sequence(greatest(0, cast(ceil((rel - {hours - 1}) / 24) as int)), cast(rel div 24 as int))"))).withColumn("start", F.col("week") * 24)
    weeks = weeks.where("rel >= start AND rel < start + " + str(hours))
    size = meta.where(F.col(key) == anchor).select((F.col("n") - F.col("val_end")).alias("_len"))
    weeks = weeks.join(F.broadcast(size)).where(f"start < _len - {hours}")
    stats = weeks.groupBy("week", key).agg(F.count("*").alias("rows"), F.max(value).alias("top"), F.min(value).alias("low"))
    flat = flatline_runs(weeks, value, key, ["week"]).where(F.col("longest") >= run).select("week")
    n = meta.select(F.count("*").alias("_all"))
    short = stats.groupBy("week").agg(F.count(F.when(F.col("rows") == hours, 1)).alias("full")).join(F.broadcast(n)).where("full < _all").select("week")
    bad = flat.unionAll(short)
    if floor_ba:
        bad = bad.unionAll(stats.where((F.col(key) == floor_ba) & (F.col("low") < floor)).select("week"))
    good = stats.where(F.col(key) == anchor).join(bad.distinct(), "week", "left_anti")
    return good.orderBy(F.desc("top"), "week").limit(1).select("week", F.col("top").alias("peak"))


def night_bands(hours: DataFrame, offset: Column, key: str = "ba", ts: str = "ts_utc") -> DataFrame:
    """Rows (ba, start, end): contiguous runs of rows whose local hour is 20 or later or before 6."""
    w = Window.partitionBy(key).orderBy(ts)
    local = local_hour(ts, offset)
    flagged = hours.withColumn("_night", (local >= 20) | (local < 6))
    runs = flagged.withColumn("_run", F.sum((F.col("_night") != F.coalesce(F.lag("_night").over(w), ~F.col("_night"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_night").groupBy(key, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end")).drop("_run")


def local_hour(ts: str, offset: Column) -> Column:
    return F.pmod(F.hour(ts) + offset, F.lit(24))
