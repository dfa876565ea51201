"""Exact quantiles of groups of any size.

A sketch of each group's values (``percentile_approx``, of bounded size) names two values beside the wanted rank; exact
counts below, at and between them tell where the rank lies, and only the values between go on.  Each pass leaves a few
hundredths of a group, whatever its distribution, and values that many rows share fall out by their count.  Once at most
``most`` values are left of a group they are ranked in a window.  No group's values are ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

MOST, CELLS = 50_000, 64


def _between(x: str = "x") -> str:
    return f"(lo IS NULL OR {x} > lo) AND (hi IS NULL OR {x} < hi)"


def _narrowed(rows: DataFrame, big: DataFrame, key: str) -> DataFrame:
    """The targets with narrower bounds, or with their value where a bound has it."""
    ids = [key, "rank", "lo", "hi", "below", "inside"]
    grid = rows.join(big, key).where(_between()).groupBy(*ids).agg(F.percentile_approx("x", [i / CELLS for i in range(CELLS + 1)], 10_000).alias("grid"))
    at = f"(rank - below) / inside * {CELLS}"
    aim = stored(grid.select(*ids, F.expr(f"element_at(grid, int(greatest(1, floor({at}))))").alias("a"), F.expr(f"element_at(grid, int(least({CELLS + 1}, ceil({at}) + 2)))").alias("b")), "aim")
    counts = {"under": "x < a", "at_a": "x = a", "mid": "x > a AND x < b", "at_b": "x = b AND b > a"}
    found = rows.join(aim, key).where(_between()).groupBy(*ids, "a", "b").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in counts.items()))
    t = "(rank - below)"
    place = f"CASE WHEN {t} < under THEN 0 WHEN {t} < under + at_a THEN 1 WHEN {t} < under + at_a + mid THEN 2 WHEN {t} < under + at_a + mid + at_b THEN 3 ELSE 4 END"
    p = found.withColumn("p", F.expr(place))
    pick = lambda *by: F.expr(f"CASE p WHEN 0 THEN {by[0]} WHEN 2 THEN {by[1]} WHEN 4 THEN {by[2]} END")
    return p.select(
        key, "rank", pick("lo", "a", "b").alias("lo"), pick("a", "b", "hi").alias("hi"),
        F.coalesce(pick("below", "below + under + at_a", "below + under + at_a + mid + at_b"), F.lit(0)).alias("below"),
        F.coalesce(pick("under", "mid", "inside - under - at_a - mid - at_b"), F.lit(0)).alias("inside"),
        F.expr("CASE p WHEN 1 THEN a WHEN 3 THEN b END").alias("found"),
    )


def at_ranks(rows: DataFrame, targets: DataFrame, key: str = "ba", most: int = MOST) -> DataFrame:
    """Rows (key, rank, x): the value at each asked rank (from 0) of its group; rows: key, x; targets: key, rank, n."""
    empty = F.lit(None).cast("double")
    todo = targets.select(key, "rank", empty.alias("lo"), empty.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), empty.alias("found"))
    todo = stored(todo, "targets")
    while not (big := todo.where(f"found IS NULL AND inside > {most}")).isEmpty():
        todo = stored(todo.where(f"found IS NOT NULL OR inside <= {most}").unionByName(_narrowed(rows, big.drop("found"), key)), "targets")
    left = rows.join(todo.where("found IS NULL").drop("found"), key).where(_between())
    ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy(key, "rank").orderBy("x")) - 1 + F.col("below"))
    return ranked.where("_r = rank").select(key, "rank", "x").unionByName(todo.where("found IS NOT NULL").select(key, "rank", F.col("found").alias("x")))


def exact_quantile(rows: DataFrame, value: str, level: Column, key: str = "ba", out: str = "quantile", most: int = MOST) -> DataFrame:
    """Rows (key, out): linearly interpolated quantile at a level that may depend on the group's size ``n``.

    Null and NaN values are left out; a group without values has no row.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).cast("double").alias("x"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    at = (F.col("n") - 1) * level
    wanted = stored(sizes.select(key, "n", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part")), "ranks")
    targets = wanted.select(key, "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank"))
    found = at_ranks(rows, targets, key, most).join(wanted, key)
    ends = found.groupBy(key).agg(F.max(F.when(F.col("rank") == F.col("low"), F.col("x"))).alias("a"), F.max(F.when(F.col("rank") == F.col("high"), F.col("x"))).alias("b"), F.max("part").alias("f"))
    return ends.select(key, (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(out))
