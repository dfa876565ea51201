"""Peer series: correlation on the training span, the k strongest, their values as channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = ["n", "sy", "sx", "syy", "sxx", "sxy"]


def pair_moments(rows: DataFrame, hours: int = 672, side: int = 256) -> DataFrame:
    """Rows (ba, peer, n, sy, sx, syy, sxx, sxy) to be added up: sums over the common times of each two series.

    Blocks of ``hours`` hours and about ``side`` by ``side`` series become two matrices (series by time) and their masks,
    whose products are the moments.  What leaves a block has a row for two series, not one for each of their hours.
    ``rows``: ba, ts_utc, x, one a series and time.
    """
    groups = -(-rows.select("ba").distinct().count() // side) or 1
    dealt = rows.where("x IS NOT NULL AND NOT isnan(x) AND ts_utc IS NOT NULL").select("ba", "x", F.expr("unix_micros(ts_utc)").alias("at"), F.expr(f"floor(unix_seconds(ts_utc) / {3600 * hours})").alias("block"), F.expr(f"pmod(xxhash64(ba), {groups})").alias("g"))
    dealt = dealt.withColumn("h", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))).withColumn("i", F.least("g", "h")).withColumn("j", F.greatest("g", "h"))

    def run(key: tuple, some: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        time = np.unique(some.column("at").to_numpy(), return_inverse=True)[1]
        g, codes, x = some.column("g").to_numpy(), np.array(some.column("ba").to_pylist(), object), some.column("x").to_numpy()
        made = []
        for side_ in (i, j):
            own = g == side_
            names, at = np.unique(codes[own], return_inverse=True)
            values, there = np.zeros((len(names), time.max() + 1)), np.zeros((len(names), time.max() + 1))
            values[at, time[own]], there[at, time[own]] = x[own], 1.0
            made.append((names, values, there))
        (a, y, has_y), (b, z, has_z) = made
        sums = {"n": has_y @ has_z.T, "sy": y @ has_z.T, "sx": has_y @ z.T, "syy": (y * y) @ has_z.T, "sxx": has_y @ (z * z).T, "sxy": y @ z.T}
        r, c = np.nonzero((sums["n"] > 0) & (a[:, None] != b[None, :]))
        out = pa.table({"ba": pa.array(a[r], pa.string()), "peer": pa.array(b[c], pa.string()), **{m: pa.array(sums[m][r, c]) for m in MOMENTS}})
        if i == j:
            return out
        turned = out.select(["peer", "ba", "n", "sx", "sy", "sxx", "syy", "sxy"]).rename_columns(["ba", "peer", *MOMENTS])
        return pa.concat_tables([out, turned])

    return dealt.select("block", "i", "j", "g", "ba", "at", "x").groupBy("block", "i", "j").applyInArrow(run, "ba string, peer string, " + ", ".join(f"{m} double" for m in MOMENTS))


def peer_correlation(filled: DataFrame, train_end: str, value: str = "load_mw", hours: int = 672, side: int = 256) -> DataFrame:
    """Rows (ba, peer, r) on the training span; pairs without variance or with a non-finite r are absent.

    Where all series share one grid, filling each series once is the same as filling each pair.  Values count from their
    series' least one, so that sums of squares keep their digits and a constant series has none.
    """
    train = filled.where(F.col("ts_utc") < F.lit(train_end).cast("timestamp"))
    least = train.groupBy("ba").agg(F.min(value).alias("_least"))
    rows = train.join(least, "ba").select("ba", "ts_utc", (F.col(value) - F.col("_least")).cast("double").alias("x"))
    m = pair_moments(rows, hours, side).groupBy("ba", "peer").agg(*(F.sum(c).alias(c) for c in MOMENTS))
    cov, vy, vx = F.expr("sxy - sy * sx / n"), F.expr("syy - sy * sy / n"), F.expr("sxx - sx * sx / n")
    r = F.when((vy > 0) & (vx > 0), cov / F.sqrt(vy * vx))
    return m.withColumn("r", r).where("r IS NOT NULL AND NOT isnan(r)").select("ba", "peer", "r")


def top_peers(correlations: DataFrame, k: int = 8) -> DataFrame:
    """Rows (ba, rank 1..k, peer, r): greatest abs(r); equal ones by code, descending."""
    w = Window.partitionBy("ba").orderBy(F.desc(F.abs("r")), F.desc("peer"))
    return correlations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def peer_channels(filled: DataFrame, peers: DataFrame, k: int = 8, value: str = "load_mw") -> DataFrame:
    """Add nbr1..nbrk to each row: the peers' values at the same timestamp, carried forward, 0 where there is none."""
    side = filled.select(F.col("ba").alias("peer"), "ts_utc", F.col(value).alias("x"))
    wanted = side.join(peers.select("ba", "peer", "rank"), "peer")
    wide = wanted.groupBy("ba", "ts_utc").pivot("rank", list(range(1, k + 1))).agg(F.first("x"))
    met = filled.join(wide, ["ba", "ts_utc"], "left")
    w = Window.partitionBy("ba").orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    return met.select(*filled.columns, *(F.coalesce(F.last(str(i), True).over(w), F.lit(0.0)).alias(f"nbr{i}") for i in range(1, k + 1)))
