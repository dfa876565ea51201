import math

import pytest
from pyspark.sql import functions as F

from gridjobs.functions import calendar
from gridjobs.operators import conformal, joins, live, metrics, peers, series


def hours(spark, values, ba="A", start="2024-01-01"):
    rows = [(ba, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ba string, h int, load_mw double").select("ba", F.expr(f"timestamp'{start}' + make_interval(0, 0, 0, 0, h)").alias("ts_utc"), "load_mw")


def column(df, name, order="ts_utc"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def test_dedupe_nulls_last_and_ties(spark):
    df = spark.createDataFrame([("A", 1, 10.0, None, 1), ("A", 1, 20.0, 5, 1), ("A", 1, 30.0, 5, 2), ("B", 1, 1.0, None, 1)], "ba string, ts_utc int, load_mw double, as_of int, tie int")
    assert {r.ba: r.load_mw for r in series.dedupe_latest(df, ties=["tie"]).collect()} == {"A": 30.0, "B": 1.0}
    once = series.dedupe_latest(df, ties=["tie"])
    assert series.dedupe_latest(once, ties=["tie"]).collect() == once.collect()


def test_clean_rules(spark):
    wild = hours(spark, [100.0, 101.0, 99.0, 100.0, 102.0, 2147483647.0, -16773374.0, float("nan")])
    flat = hours(spark, [5.0] * 4 + [9.0, 600000.0], "FLAT")
    none = hours(spark, [None, None], "NONE")
    out = series.robust_clean(wild.unionAll(flat).unionAll(none))
    assert column(out.where("ba = 'A'"), "load_mw") == [100.0, 101.0, 99.0, 100.0, 102.0, None, None, None]
    assert column(out.where("ba = 'FLAT'"), "load_mw") == [5.0] * 4 + [9.0, None]
    assert column(out.where("ba = 'NONE'"), "load_mw") == [None, None]


def test_fill_rules(spark):
    df = hours(spark, [None, 1.0, None, 2.0, None]).unionAll(hours(spark, [None, None], "Z"))
    out = series.fill(df)
    assert column(out.where("ba = 'A'"), "load_mw") == [1.0, 1.0, 1.0, 2.0, 2.0] and column(out.where("ba = 'Z'"), "load_mw") == [0.0, 0.0]


def test_block_fill_crosses_months(spark):
    df = hours(spark, [None, 7.0] + [None] * 60 * 24 + [8.0, None])
    out = column(series.block_fill(df, "load_mw", ["ba"]), "load_mw")
    assert out[0] is None and out[1:-2] == [7.0] * (len(out) - 3) and out[-2:] == [8.0, 8.0]


def test_denominators_count_positions(spark):
    df = hours(spark, [float(i) for i in range(30)] + [None] * 3 + [float(i * i) for i in range(30)]).where("hour(ts_utc) <> 5")
    filled = series.row_index(series.fill(df))
    meta = series.split_bounds(filled, "2024-01-03", "2024-01-03", "2024-02-01")
    y = column(filled, "load_mw")
    n = meta.first().train_end
    want = sum(abs(y[i] - y[i - 24]) for i in range(24, n)) / (n - 24)
    assert series.mase_denominator(filled, meta).first().denom == pytest.approx(want)
    z = [r.load_mw for r in df.orderBy("ts_utc").collect() if r.load_mw is not None and str(r.ts_utc) < "2024-01-03"]
    assert series.mase_denominator_dropna(df, "2024-01-03").first().denom == pytest.approx(sum(abs(z[i] - z[i - 24]) for i in range(24, len(z))) / (len(z) - 24))


def test_origins_drop_short_tails_and_contexts(spark):
    meta = spark.createDataFrame([("A", 50, 100)], "ba string, val_end long, test_end long")
    got = lambda **k: sorted(r.origin for r in series.rolling_origins(meta, **k).collect())
    assert got(horizon=24, step=24) == [50, 74] and got(horizon=30, step=12) == [50, 62] and got(horizon=24, step=24, context=60) == [74] and got(horizon=60) == []


def test_training_pairs(spark):
    idx = series.row_index(hours(spark, [float(i) for i in range(20)]))
    meta = spark.createDataFrame([("A", 15)], "ba string, train_end long")
    rows = series.training_pairs(idx, meta, 4, 3, 5).orderBy("idx").collect()
    assert [(r.idx, r.context, r.target) for r in rows] == [(4, [0.0, 1, 2, 3], [4.0, 5, 6]), (9, [5.0, 6, 7, 8], [9.0, 10, 11])]


@pytest.mark.parametrize("policy, horizon, want", [("persistence", 3, [49.0] * 3), ("oracle", 3, [50.0, 51, 52]), ("known", 2, [50.0, 51]), ("lag24", 30, [26.0 + i % 24 for i in range(30)])])
def test_future_covariates(spark, policy, horizon, want):
    idx = series.row_index(hours(spark, [0.0] * 100)).withColumn("x", F.col("idx").cast("double"))
    origins = spark.createDataFrame([("A", 50)], "ba string, origin long")
    assert column(joins.future_covariate(idx, origins, horizon, policy, "x"), "x", "step") == want


def test_future_errors(spark):
    idx = series.row_index(hours(spark, [0.0] * 5))
    origins = spark.createDataFrame([("A", 2)], "ba string, origin long")
    for policy in ("past_only", "what"):
        with pytest.raises(ValueError):
            joins.future_covariate(idx, origins, 2, policy, "load_mw")
    with pytest.raises(ValueError, match="needs the channel"):
        joins.future_covariate(idx, origins, 2, "forecast", "temp_c", "temp_fcst")
    with pytest.raises(ValueError, match="lead"):
        joins.check_lead(spark.createDataFrame([("A", 24)], "ba string, fcst_lead_hours int"), 48)
    joins.check_lead(spark.createDataFrame([("A", 24), ("B", None)], "ba string, fcst_lead_hours int"), 24)
    with pytest.raises(ValueError):
        joins.resolve_policy("nope")


def test_alignment_prefix_gap_and_lead(spark):
    idx = series.row_index(hours(spark, [0.0] * 6)).withColumn("temp_c", F.col("idx") * 1.0)
    arch = idx.where("idx IN (2, 3, 5)").select("ba", "ts_utc", (F.col("idx") + 100.0).alias("temp_c_fcst"), (F.col("idx") + 200.0).alias("temp_c_anal"), F.lit(24).alias("lead_hours"))
    out = joins.forecast_alignment(idx, arch)
    assert column(out, "temp_fcst", "idx") == [0.0, 1.0, 102.0, 103.0, 103.0, 105.0]
    assert {(r.fcst_start, r.fcst_lead_hours) for r in out.collect()} == {(2, 24)}
    assert column(joins.analysis_past(out, "forecast"), "temp_c", "idx") == [0.0, 1.0, 202.0, 203.0, 203.0, 205.0]
    assert column(joins.analysis_past(out, "oracle"), "temp_c", "idx") == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_reindex_is_exact_match_then_fill(spark):
    target = hours(spark, [0.0] * 4).where("hour(ts_utc) IN (1, 3)")
    source = hours(spark, [10.0, 11.0, 12.0, 13.0]).where("hour(ts_utc) IN (0, 1, 2)").withColumnRenamed("load_mw", "x")
    assert column(joins.reindex_ffill(target, source, "x"), "x") == [11.0, 11.0]


def test_peers_rank_ties_by_code_descending(spark):
    base = [math.sin(i) for i in range(48)]
    df = hours(spark, base, "T").unionAll(hours(spark, [-x for x in base], "A")).unionAll(hours(spark, base, "B")).unionAll(hours(spark, [3.0] * 48, "FLAT"))
    r = peers.peer_correlation(df, "2024-02-01")
    assert not r.where("peer = 'FLAT' OR ba = 'FLAT'").collect()
    assert [x.peer for x in peers.top_peers(r.withColumn("r", F.round("r", 9)), 2).where("ba = 'T'").orderBy("rank").collect()] == ["B", "A"]
    out = peers.peer_channels(df, peers.top_peers(r, 3), 3).where("ba = 'T'")
    assert set(column(out, "nbr3")) == {0.0}


def test_holidays_and_bridges(spark):
    days = set(calendar.us_holidays(2022, 2024))
    from datetime import date

    assert {date(2024, 7, 4), date(2022, 12, 26), date(2023, 1, 2), date(2024, 11, 28), date(2024, 5, 27), date(2022, 6, 20)} <= days and date(2024, 7, 5) not in days
    assert date(2020, 6, 19) not in calendar.us_holidays(2020, 2020)
    ts = spark.sql("SELECT explode(sequence(timestamp'2024-06-28', timestamp'2024-07-08', interval 1 day)) AS ts_utc")
    out = {str(r.day): (r.is_bridge, round(r.hol_prox * 7)) for r in calendar.special_days(ts, calendar.holiday_table(spark)).collect()}
    assert out["2024-07-05"] == (1, 1) and out["2024-07-04"] == (0, 0) and out["2024-07-03"] == (0, -1) and out["2024-06-28"] == (0, -6)
    none = calendar.special_days(spark.sql("SELECT timestamp'2024-08-06' AS ts_utc"), calendar.holiday_table(spark)).first()
    assert none.hol_prox == 1.0 and none.is_bridge == 0


def test_current_load_gate_ceiling_and_duplicates(spark):
    rows = spark.sql("SELECT format_string('BA%02d', b.id) AS ba, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h.id) AS ts_utc, 1000.0D AS load_mw, timestamp'2024-02-01' AS as_of FROM range(50) b CROSS JOIN range(10) h")
    bad = spark.sql("SELECT 'CORRUPT' AS ba, timestamp'2024-01-01 05:00:00' AS ts_utc, 500000.0D AS load_mw, timestamp'2024-02-01' AS as_of")
    out = live.current_load(rows.unionAll(rows).unionAll(bad), 4).collect()
    assert [(r.total_mw, r.ba_count) for r in out] == [(50000.0, 50)] * 4 and out == sorted(out, key=lambda r: r.ts_utc)
    with pytest.raises(ValueError):
        live.require_rows(live.current_load(rows.where("ba < 'BA05'"), 4), "covered hours")
    worse = spark.sql("SELECT 'BA00' AS ba, timestamp'2024-01-01 09:00:00' AS ts_utc, -1.0D AS load_mw, timestamp'2024-03-01' AS as_of")
    assert live.current_load(rows.unionAll(worse), 1).first().ba_count == 49  # an older valid revision does not come back


BLOCK = [("PJM", 0, 90.0, 100.0, 115.0), ("CISO", 1, 80.0, 95.0, 101.0), ("ERCO", 2, 70.0, 71.0, 130.0)]


def test_conformal_apply(spark):
    q = spark.createDataFrame(BLOCK, "ba string, step int, q_lo double, q_mid double, q_hi double")
    d = spark.createDataFrame([("pjm", 10.0), ("CISO", 2.5), ("ERCO", float("nan"))], "ba string, delta_mw double")
    assert {r.ba: (r.q_lo, r.q_mid, r.q_hi) for r in conformal.apply_delta(q, d).collect()} == {"PJM": (80.0, 100.0, 125.0), "CISO": (77.5, 95.0, 103.5), "ERCO": (70.0, 71.0, 130.0)}
    crossed = spark.createDataFrame([("PJM", 0, 105.0, 100.0, 95.0)], "ba string, step int, q_lo double, q_mid double, q_hi double")
    r = conformal.apply_delta(crossed, spark.createDataFrame([("PJM", -40.0)], "ba string, delta_mw double")).first()
    assert r.q_lo <= r.q_mid <= r.q_hi and r.q_mid == 100.0


@pytest.mark.parametrize("n", [1, 9, 10, 365])
def test_conformal_level(spark, n):
    import numpy as np

    s = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([("A", float(x)) for x in s], "ba string, y double").withColumn("q_lo", F.lit(-1e9)).withColumn("q_hi", F.lit(0.0))
    want = np.quantile(s, min(math.ceil((n + 1) * 0.8 - 1e-9) / n, 1.0))
    assert conformal.conformal_delta(rows).first().delta_mw == pytest.approx(want)


def test_scores(spark):
    rows = spark.createDataFrame([("A", 0, 0, 10.0, 8.0), ("A", 0, 1, 20.0, 24.0), ("B", 0, 0, 5.0, 5.0), ("B", 0, 1, None, 1.0)], "ba string, origin long, step int, y double, mean double")
    rows = rows.withColumn("q_lo", F.col("mean") - 1).withColumn("q_mid", F.col("mean")).withColumn("q_hi", F.col("mean") + 1)
    denom = spark.createDataFrame([("A", 2.0), ("B", 4.0)], "ba string, denom double")
    per = {r.ba: r for r in metrics.point_metrics(rows, denom).collect()}
    assert (per["A"].mae, per["A"].mase, per["A"].n_points, per["B"].mae) == (3.0, 1.5, 2, 0.0) and per["A"].rmse == pytest.approx(math.sqrt(10))
    assert metrics.macro(metrics.point_metrics(rows, denom), ["mase"]).first().mase == 0.75
    assert {r.ba: r.coverage for r in metrics.coverage(rows).collect()} == {"A": 0.0, "B": 1.0}
    want = ((0.1 * (10 - 7) + 0.9 * 3) / 2 + (0.5 * 2 + 0.5 * 4) / 2 + (0.9 * (10 - 9) + 0.1 * 5) / 2) / 3
    assert {r.ba: r.crps for r in metrics.crps(rows).collect()}["A"] == pytest.approx((0.15 + 1.35 + 1.5 + 0.7) / 3) == pytest.approx(want)
    steps = {r.step: r.mase for r in metrics.step_mase(rows, denom).collect()}
    assert steps == {0: 0.5, 1: 2.0} and metrics.break_even(metrics.step_mase(rows, denom)).first().break_even == 2
    assert metrics.coverage_label(0.05, 0.95) == "cov_pi90"


def test_bootstrap_is_seeded(spark):
    e = spark.createDataFrame([("A", i, float(i)) for i in range(50)], "ba string, origin long, err double")
    a, b = metrics.bootstrap_ci(e, 100, 3).first(), metrics.bootstrap_ci(e.orderBy(F.desc("err")), 100, 3).first()
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo < 24.5 < a.hi
    other = metrics.bootstrap_ci(e, 100, 4).first()
    assert (other.lo, other.hi) != (a.lo, a.hi)
    w = spark.range(20000).select(metrics.poisson_weight(F.col("id").cast("string")).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(w.m - 1) < 0.03 and abs(w.v - 1) < 0.06


def test_flatlines(spark):
    idx = series.row_index(hours(spark, [1.0] * 7 + [2.0] * 8 + [1.0]))
    assert series.flatline_runs(idx).first().longest == 8


def test_overlay_bridge(spark):
    act = hours(spark, [1.0, 2.0, 3.0]).unionAll(hours(spark, [1.0]))
    fc = hours(spark, [0.0] * 4).where("hour(ts_utc) >= 2").select("ba", "ts_utc", F.lit(8.0).alias("lo"), F.lit(9.0).alias("median"), F.lit(10.0).alias("hi"))
    op = hours(spark, [5.0] * 9).withColumnRenamed("load_mw", "forecast_mw")
    rows = joins.overlay(act, fc, op).orderBy("ts_utc").collect()
    assert [(r.load, r.median, r.operator) for r in rows] == [(1.0, None, 5.0), (2.0, 2.0, 5.0), (None, 9.0, 5.0), (None, 9.0, 5.0)]
