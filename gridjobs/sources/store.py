"""Append-only datasets partitioned by year and month, their manifest, compaction, incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import dedupe_latest
from ..schemas import MANIFEST


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The dataset with its year and month; an absent one is empty."""
    full = f"{schema}, year int, month int"
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def with_months(df: DataFrame, ts_col: str) -> DataFrame:
    """Add the partition columns; month is zero-padded on disk and reads back as a number."""
    if ts_col not in df.columns:
        raise ValueError(f"no column {ts_col}")
    return df.withColumn("year", F.year(ts_col)).withColumn("month", F.date_format(ts_col, "MM"))


def append(df: DataFrame, path: str, ts_col: str = "ts_utc", salt: int = 1) -> None:
    """Append to year/month partitions; nothing is written for an empty frame.

    ``salt`` files are written for a month, so that one busy month does not end in one task.
    """
    if df.isEmpty():
        with_months(df, ts_col)
        return
    spread = (F.rand(7) * salt).cast("int") if salt > 1 else F.lit(0)
    with_months(df, ts_col).withColumn("_s", spread).repartition("year", "month", "_s").drop("_s").write.partitionBy("year", "month").mode("append").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, path: str, to: str, schema: str) -> None:
    """Rewrite to one file for each month; rows stay as they are, duplicates included."""
    rows = scan(spark, path, schema).drop("year", "month")
    with_months(rows, "ts_utc").repartition("year", "month").write.partitionBy("year", "month").mode("overwrite").option("compression", "zstd").parquet(to)


def content_hash(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows (*by, n_rows, sha256): a hash of a batch's rows that does not depend on their order.

    Each row is hashed; the hashes' sorted list is hashed.  For batches of pages or months, which fit a task.
    """
    each = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    return df.withColumn("_h", each).groupBy(*by).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_h"))), 256).alias("sha256"))


def record(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Append rows (source, key, fetched_at, n_rows, sha256) to the manifest."""
    from ..schemas import enforce

    enforce(entries, MANIFEST).coalesce(1).write.mode("append").parquet(path)


def skip_known(batches: DataFrame, manifest: DataFrame) -> DataFrame:
    """Batches whose (source, key) the manifest does not have."""
    return batches.join(manifest.select("source", "key").distinct(), ["source", "key"], "left_anti")


def ingest_counts(results: DataFrame) -> DataFrame:
    """Rows (feed, ba, n_rows, failures) of a run's batches (feed, ba, n_rows, error)."""
    return results.groupBy("feed", "ba").agg(F.sum("n_rows").alias("n_rows"), F.count("error").alias("failures"))


def upsert(spark: SparkSession, batch: DataFrame, path: str, to: str, schema: str, keys: list[str] = ("ba", "ts_utc"), ties: list[str] = ()) -> None:
    """Write to ``to`` the months that a batch touches: stored rows of those months and the batch, the latest of each key.

    The caller overwrites the dataset's months with them (dynamic partition overwrite needs another path to read from).
    """
    months = batch.select(F.year("ts_utc").alias("year"), F.month("ts_utc").alias("month")).distinct()
    stored = scan(spark, path, schema).join(months, ["year", "month"], "left_semi").drop("year", "month")
    latest = dedupe_latest(stored.unionByName(batch, allowMissingColumns=True), list(keys), "as_of", list(ties))
    with_months(latest, "ts_utc").repartition("year", "month").write.partitionBy("year", "month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(to)
