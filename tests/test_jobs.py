import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridjobs import adapters as A
from gridjobs import queries as Q
from gridjobs.operators import joins, series
from gridjobs.plans import audit, jobs, regression
from gridjobs.streaming import jobs as streams

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    report = entry.entry(spark).collect()
    rows = {r.ba: r for r in report if r.step is None}
    steps = {r.step: r.mase for r in report if r.step is not None}
    assert set(steps) == set(range(24)) and all(r.ba == "MACRO" for r in report if r.step is not None)
    assert rows["MACRO"].ci_lo < rows["MACRO"].ci_hi and rows["view"].ci_lo is None
    assert all(r.coverage >= r.coverage_raw for r in rows.values() if r.delta_mw >= 0)
    assert rows["MACRO"].mase == pytest.approx(0.7806, abs=1e-4) and set(rows) == {"click", "error", "signup", "view", "MACRO"}


def test_every_query_has_sql_or_is_known():
    from gridjobs import queries

    assert set(queries.queries()) - set(queries.oracle_sql()) == {"agg_bootstrap_ci_exact"}
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", ["win_robust_clean", "agg_point_metrics", "job_backtest", "job_hourly_regression", "stream_late_counts", "ingest_write_through", "text_redact_secrets", "join_gen_pivot", "agg_conformal_delta", "job_feature_table", "stream_rolling_24h", "src_zip_csv"])
def test_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "nation", "region", "customer", "supplier", "part", "pages", "embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    rel = c.sql(Q.oracle_sql()[name])
    at = [rel.columns.index(x) for x in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
    assert got == want and got


def prepared(spark):
    both = joins.left_on_ts(A.load_hourly(spark, SF), A.weather(spark, SF))
    idx = series.row_index(series.fill(series.fill(both), "temp_c"))
    return idx, series.split_bounds(idx, *A.SPLITS)


def test_audit_flags_a_leak_and_passes_the_causal_builder(spark):
    idx, meta = prepared(spark)
    origins = audit.audit_origins(meta)
    assert audit.causal_audit(idx, origins, Q._builder(False), ["temp_c", "load_mw"], ["temp_c", "load_mw"]).count() == 0
    bad = audit.causal_audit(idx, origins, Q._builder(True), ["temp_c", "load_mw"], ["temp_c", "wind"]).collect()
    assert {(r.covariate, r.problem) for r in bad} == {("load_mw", "leak"), ("wind", "missing")}


def test_hourly_regression_beats_nothing_and_falls_back(spark):
    rows = spark.sql("SELECT 'A' AS ba, id AS idx, cast(pmod(id, 24) AS int) AS hour, id < 3000 AS is_train, 2.0D * sin(id / 50.0) + pmod(id, 24) AS y, 2.0D * sin((id - 24) / 50.0) + pmod(id, 24) AS lag24, 0.0D AS lag48, 0.0D AS lag168, sin(id / 50.0) AS temp_c, 0.0D AS hour_sin, 0.0D AS hour_cos, 0.0D AS dow_sin, 0.0D AS dow_cos, 0 AS is_weekend, 0 AS is_holiday, 1 AS month FROM range(3500)")
    out = regression.hourly_regression(rows)
    assert out.agg(F.avg(F.abs(F.col("y") - F.col("mean")))).first()[0] < 0.1
    few = regression.hourly_regression(rows.where("idx < 240 OR idx >= 3000")).join(rows.select("idx", "lag24"), "idx")
    assert few.where("mean <> lag24").count() == 0


def test_hourly_regression_equals_a_solver(spark):
    rng = np.random.default_rng(4)
    rows = [("A", i, i % 2, i < 400, float(rng.normal() * 100 + 1000), *(float(x) for x in rng.normal(size=8) * 50 + 900), i % 7 // 5, 0, 1 + i % 3) for i in range(460)]
    df = spark.createDataFrame(rows, "ba string, idx long, hour int, is_train boolean, y double, " + ", ".join(f"{c} double" for c in regression.FEATURES[:8]) + ", is_weekend int, is_holiday int, month int")
    got = {r.idx: r.mean for r in regression.hourly_regression(df).collect()}
    for hour in (0, 1):
        own = np.array([r[4:] for r in rows if r[2] == hour and r[3]], float)
        x, y = own[:, 1:], own[:, 0]
        mu, sd = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        w = np.linalg.solve(((x - mu) / sd).T @ ((x - mu) / sd) + np.eye(11), ((x - mu) / sd).T @ (y - y.mean()))
        for r in rows:
            if r[2] == hour and not r[3]:
                assert got[r[1]] == pytest.approx((np.array(r[5:], float) - mu) / sd @ w + y.mean(), rel=1e-10)


def test_models_agree_with_joins(spark):
    idx, meta = prepared(spark)
    origins = series.rolling_origins(meta, context=48)
    contexts = series.context_rows(idx, origins, 48).groupBy("ba", "origin").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "x"))).alias("v")).select("ba", "origin", F.col("v.x").alias("context"))
    for name, own in (("persistence", series.forecast_persistence(idx, origins, 24)), ("seasonal_naive_24", series.forecast_seasonal_naive(idx, origins, 24))):
        got = {(r.ba, r.origin, r.step): r.mean for r in jobs.run_forecaster(contexts, jobs.MODELS[name], 24).collect()}
        assert got == {(r.ba, r.origin, r.step): r.mean for r in own.collect()}


def test_serving_never_uses_partial_weather(spark):
    idx, _ = prepared(spark)
    from gridjobs.functions.calendar import holiday_table

    future = series.next_hours(idx, 24).withColumn("temp_c", F.lit(1.0)).where("NOT (ba = 'view' AND hour(ts_utc) = 5)")
    rows = jobs.serve_batch(idx, holiday_table(spark), future, 10, 24).collect()
    assert {r.ba for r in rows if r.temp_c is not None} == {r.ba for r in rows} - {"view"}
    assert jobs.serve_batch(idx, holiday_table(spark), future, 10_000, 24).count() == 0


def test_late_revisions_win_in_the_stream(spark):
    from gridjobs.session import scratch_path
    from gridjobs.sources import store

    kind = "ba string, ts_utc timestamp, load_mw double, as_of timestamp, tie long"
    path = scratch_path(spark, "in")
    one = "SELECT 'A' AS ba, timestamp'2024-01-01' AS ts_utc, {}D AS load_mw, timestamp'2024-01-0{}' AS as_of, 1L AS tie"
    for v, day in ((1.0, 2), (3.0, 4), (2.0, 3)):
        spark.sql(one.format(v, day)).coalesce(1).write.mode("append").parquet(path)
    to, check = scratch_path(spark, "out"), scratch_path(spark, "check")

    def run():
        return [r.load_mw for r in streams.latest(streams.source(spark, path, kind, 1), to, check, ["tie"]).collect()]

    assert run() == [3.0]
    files = {f for f in os.listdir(to) if f.startswith("year")}, [r.op for r in store.scan(spark, to, "op int").collect()]
    assert sorted(files[1]) == [-1, 1, 1]  # 1.0 came, went for 3.0; 2.0 is older and changes nothing
    assert run() == [3.0] and store.scan(spark, to, "op int").count() == 3  # a restart changes nothing
    spark.sql(one.format(9.0, 5)).coalesce(1).write.mode("append").parquet(path)
    assert run() == [9.0]  # and goes on with the state it had
    assert sorted(r.op for r in store.scan(spark, to, "op int").collect()) == [-1, -1, 1, 1, 1]


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    from gridjobs.session import scratch_path
    from gridjobs.streaming import progress

    kind = "ba string, ts_utc timestamp, load_mw double, as_of timestamp, tie long"
    path, log = scratch_path(spark, "in"), scratch_path(spark, "log")
    one = "SELECT 'A' AS ba, timestamp'2024-01-{:02} 00:00:00' AS ts_utc, {}D AS load_mw, timestamp'2024-02-01' AS as_of, {}L AS tie"
    for k, days in enumerate(((1, 2), (10,), (20,), (1, 7, 19))):
        spark.sql(" UNION ALL ".join(one.format(day, 10 * k + day, k) for day in days)).coalesce(1).write.mode("append").parquet(path)
    out = []
    progress.run_logged(spark, lambda: out.extend(streams.latest(progress.observed(streams.source(spark, path, kind, 1)), scratch_path(spark, "to"), scratch_path(spark, "check"), ["tie"]).collect()), log)
    assert {r.ts_utc.day: r.load_mw for r in out} == {1: 1.0, 2: 2.0, 10: 20.0, 20: 40.0, 19: 49.0}
    got = sorted((r.batch, r.n_rows, r.late_rows) for r in progress.read_log(spark, log).collect())
    assert got == [(0, 2, 0), (1, 1, 0), (2, 1, 0), (3, 3, 2)]


def test_streamed_demand_takes_revisions_like_the_batch_job(spark):
    from gridjobs.operators import live
    from gridjobs.session import scratch_path

    kind = "ba string, ts_utc timestamp, load_mw double, as_of timestamp, tie long"
    rows = [(b, f"2024-01-31 0{h}:00:00", 100.0 + h, "2024-02-01", 1) for b in "ABC" for h in range(3)]
    later = [("A", "2024-01-31 00:00:00", 700.0, "2024-02-02", 2), ("B", "2024-01-31 01:00:00", -5.0, "2024-02-02", 2), ("C", "2024-01-31 02:00:00", 1.0, "2024-01-15", 9)]
    path, frames = scratch_path(spark, "in"), []
    for part in (rows, later):
        frames.append(spark.createDataFrame(part, "ba string, ts_utc string, load_mw double, as_of string, tie long").selectExpr("ba", "cast(ts_utc as timestamp) ts_utc", "load_mw", "cast(as_of as timestamp) as_of", "tie"))
        frames[-1].coalesce(1).write.mode("append").parquet(path)
    streamed = streams.current_load(streams.source(spark, path, kind, 1), scratch_path(spark, "to"), scratch_path(spark, "check"), 2, ["tie"])
    batch = live.current_load(frames[0].unionAll(frames[1]), 10, 2, ["tie"])
    got = {(str(r.ts_utc), r.total_mw, r.ba_count) for r in streamed.collect()}
    assert got == {(str(r.ts_utc), r.total_mw, r.ba_count) for r in batch.collect()}
    assert ("2024-01-31 00:00:00", 900.0, 3) in got and ("2024-01-31 01:00:00", 202.0, 2) in got


def test_stream_state_has_a_value_for_a_slice_of_an_hour_and_keeps_nulls_and_large_numbers(spark):
    from gridjobs.session import scratch_path
    from gridjobs.streaming import state

    kind = "ba string, ts_utc timestamp, load_mw double, as_of timestamp, tie long"
    path, to = scratch_path(spark, "in"), scratch_path(spark, "out")
    big = (1 << 53) + 1
    first = f"SELECT cast(id AS string) AS ba, timestamp'2024-01-01 05:00:00' AS ts_utc, CASE WHEN id % 2 = 0 THEN id + 0.5D END AS load_mw, CASE WHEN id > 0 THEN timestamp'2024-01-02' END AS as_of, CASE WHEN id % 3 > 0 THEN {big}L + id END AS tie FROM range(500)"
    again = f"SELECT cast(id AS string) AS ba, timestamp'2024-01-01 05:00:00' AS ts_utc, double('NaN') AS load_mw, CASE WHEN id % 2 = 0 THEN timestamp'2024-01-02' END AS as_of, {big}L + 7 AS tie FROM range(10)"
    for part in (first, again):
        spark.sql(part).coalesce(1).write.mode("append").parquet(path)
    check = scratch_path(spark, "check")
    setting, provider = state.PROVIDER
    spark.conf.set(setting, provider)
    try:
        q = state.changes(streams.source(spark, path, kind, 1), "72 hours", ties=["tie"]).writeStream.format("parquet").option("path", to).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(setting)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 2 * state.SLICES  # a value and a timer each, not 500
    got = {int(r.ba): (r.load_mw, r.tie) for r in state.collapse(spark.read.parquet(to)).collect()}
    assert len(got) == 500 and got[11] == (None, big + 11) and got[12] == (12.5, None)
    # of 0 to 9: with an as_of the larger tie wins, without one (1, 3, ...) the held revision stays
    assert [i for i in range(10) if got[i][0] is not None and got[i][0] != got[i][0]] == [0, 2, 4, 6]
    assert got[8] == (8.5, big + 8) and got[1] == (None, big + 1)
