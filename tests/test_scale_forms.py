"""Forms for very long series and very large groups against the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.operators import blocks, conformal, live, metrics, peers, selection, series


@pytest.fixture(scope="module")
def long_series(spark):
    rnd = random.Random(5)
    rows = [(b, f"2024-0{1 + h // 720}-{1 + h // 24 % 30 if h // 720 != 1 else 1 + h // 24 % 28:02} {h % 24:02}:00:00", float(rnd.choice([1, 1, 1, 2, 3])) if rnd.random() < 0.9 else None) for b in "AB" for h in range(1500) if rnd.random() < 0.97]
    return spark.createDataFrame(rows, "ba string, ts string, load_mw double").selectExpr("ba", "cast(ts as timestamp) ts_utc", "load_mw").dropDuplicates(["ba", "ts_utc"])


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_block_positions_equal_the_window(long_series, spark):
    odd = long_series.unionByName(spark.sql("SELECT 'A' AS ba, cast(null AS timestamp) AS ts_utc, 5D AS load_mw"))
    for rows in (long_series, odd):
        same(blocks.row_index(rows).select("ba", "ts_utc", "idx"), series.row_index(rows).select("ba", "ts_utc", "idx"))


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_block_lags_and_runs_equal_the_windows(long_series, block):
    indexed = series.row_index(long_series)
    cols = ["ba", "idx", "load_mw", "lag2", "lag5"]
    same(blocks.seasonal_lags(indexed, (2, 5), block=block).select(cols), series.seasonal_lags(indexed, (2, 5)).select(cols))
    for rows in (indexed, indexed.withColumn("load_mw", F.lit(1.0)), indexed.withColumn("load_mw", F.col("idx").cast("double"))):
        same(blocks.flatline_runs(rows, block=block).select("ba", "longest"), series.flatline_runs(rows).select("ba", "longest"))


@pytest.mark.parametrize("most", [1, 10, 100_000])
def test_exact_quantiles_by_narrowing(spark, most):
    rng = np.random.default_rng(most)
    made = {"ties": np.repeat([3.0, 7.0], [400, 600]), "half": np.repeat([1.0, 2.0], 500), "normal": rng.normal(size=1500), "heavy": np.exp(30 * rng.normal(size=900)), "one": np.array([4.0]), "mixed": np.r_[np.full(700, 5.0), rng.random(50), 6 + rng.random(50)]}
    rows = spark.createDataFrame([(k, float(x)) for k, v in made.items() for x in v] + [("one", None), ("one", float("nan")), ("none", None)], "ba string, v double").repartition(4)
    for level in (0.0, 0.1, 0.5, 0.777, 1.0):
        got = {r.ba: r.quantile for r in selection.exact_quantile(rows, "v", F.lit(level), most=most).collect()}
        assert got == pytest.approx({k: float(np.quantile(v, level)) for k, v in made.items()}, rel=1e-12)


def test_medians_of_large_series_are_the_same(long_series):
    got, want = (series.mad_stats(long_series, most=m).select("ba", "med", "mad") for m in (10, 10_000))
    same(got, want)


def test_conformal_delta_of_one_large_group(spark):
    rows = spark.range(3000).selectExpr("'A' AS ba", "cast(pmod(id * 7919, 3001) AS double) AS y", "1000D AS q_lo", "2000D AS q_hi")
    s = np.array([max(1000 - r.y, r.y - 2000) for r in rows.collect()])
    level = min(np.ceil(3001 * 0.8 - 1e-9) / 3000, 1)
    assert conformal.conformal_delta(rows).first().delta_mw == pytest.approx(np.quantile(s, level))


@pytest.mark.parametrize(("hours", "side"), [(5, 2), (24, 100), (672, 1)])
def test_correlation_by_blocks_equals_pairs(spark, hours, side):
    rng, rows = np.random.default_rng(2), []
    base = rng.normal(size=200)
    for k, b in enumerate("ABCDE"):
        rows += [(b, f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00", 1e4 + float(base[h] * k + rng.normal())) for h in range(200) if rng.random() < 0.8]
    rows += [("flat", f"2024-01-01 {h:02}:00:00", 5.1) for h in range(24)] + [("alone", "2024-02-20 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "ba string, ts string, load_mw double").selectExpr("ba", "cast(ts as timestamp) ts_utc", "load_mw")
    got = {(r.ba, r.peer): r.r for r in peers.peer_correlation(df, "2024-02-01", hours=hours, side=side).collect()}
    by = {b: {t: v for x, t, v in rows if x == b} for b in "ABCDE"}
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a != b:
                want[a, b] = np.corrcoef([by[a][t] for t in both], [by[b][t] for t in both])[0, 1]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("context", "horizon", "stride"), [(48, 24, 12), (5, 3, 7), (4, 1, 1), (10, 9, 4)])
def test_training_windows_from_chunks(long_series, context, horizon, stride):
    indexed = series.row_index(series.fill(long_series))
    meta = series.split_bounds(indexed, "2024-02-01", "2024-02-05", "2024-02-09")
    ends = {r.ba: r.train_end for r in meta.collect()}
    values = {b: [r.load_mw for r in sorted(indexed.where(F.col("ba") == b).collect(), key=lambda r: r.idx)][: ends[b]] for b in "AB"}
    want = {(b, i): (v[i - context : i], v[i : i + horizon]) for b, v in values.items() for i in range(context, len(v) - horizon + 1, stride)}
    got = {(r.ba, r.idx): (r.context, r.target) for r in series.training_pairs(indexed, meta, context, horizon, stride).collect()}
    assert got == want


def test_holdout_codes_are_numbered_over_parts(spark):
    codes = spark.createDataFrame([(f"c{i:03}",) for i in range(57)] * 2, "ba string").repartition(7)
    got = {r.ba for r in metrics.holdout_flags(codes, 0.2).where("holdout").collect()}
    assert got == {f"c{i:03}" for i in range(0, 57, 5)}


def test_current_load_reads_back_until_enough_hours_are_covered(spark):
    rows = [(b, f"2024-01-{1 + h // 24:02} {h % 24:02}:00:00", 100.0 + h, 1) for h in range(600) for b in ("AB" if 50 < h < 560 else "A")]
    df = spark.createDataFrame(rows, "ba string, ts string, load_mw double, as_of int").selectExpr("ba", "cast(ts as timestamp) ts_utc", "load_mw", "as_of", "year(cast(ts as timestamp)) year", "month(cast(ts as timestamp)) month")
    got = [r.total_mw for r in live.current_load(df, 3, 2).collect()]
    assert got == [2 * (100.0 + h) for h in (557, 558, 559)]
    assert live.current_load(df, 1000, 2).count() == 509 and live.current_load(df.limit(0), 5, 1).collect() == []


def test_exact_bootstrap_draws_n_of_n(spark):
    rng = np.random.default_rng(9)
    err = rng.gamma(2.0, size=3000)
    rows = spark.createDataFrame([("A" if i % 2 else "B", i, float(x)) for i, x in enumerate(err)] + [("A", 9999, None)], "ba string, origin int, err double")
    drawn = metrics.exact_draws(rows, 400, 5, block=256)
    got = [(r.b, r.draws, r.mean) for r in drawn.collect()]
    assert sorted(b for b, _, _ in got) == list(range(400)) and {n for _, n, _ in got} == {3000}
    assert sorted(got) == sorted((r.b, r.draws, r.mean) for r in metrics.exact_draws(rows.repartition(5), 400, 5, block=256).collect())
    whole = np.quantile([err[rng.integers(0, 3000, 3000)].mean() for _ in range(4000)], [0.025, 0.975])
    ci = metrics.bootstrap_ci_exact(rows, 2000, 1).first()
    assert (ci.lo, ci.hi, ci.replicates) == (pytest.approx(whole[0], rel=0.01), pytest.approx(whole[1], rel=0.01), 2000)
    assert metrics.bootstrap_ci_exact(rows.limit(0), 10).first().replicates == 0
