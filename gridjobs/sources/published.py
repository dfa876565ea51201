"""Folders that readers see whole or not at all.

Everything that belongs together is a batch with folders of its own below a root; an empty file in ``_commits``, created
last, makes the batch count.  Creating a file is atomic on every store, renaming folders is not.  A run that fails before
leaves nothing that readers see; the next one finishes a batch that was written whole and removes one that was not.
There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, enforce
from .store import content_hash, skip_known, with_months

MARKS = "_commits"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, *parts: str) -> list[str]:
    path, fs = _path(spark, *parts)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def committed(spark: SparkSession, root: str) -> list[str]:
    return _names(spark, root, MARKS)


def commit(spark: SparkSession, root: str, name: str) -> None:
    path, fs = _path(spark, root, MARKS, name)
    fs.createNewFile(path)


def place(root: str, part: str, name: str) -> str:
    return f"{root}/{part}/batch={name}"


def recover(spark: SparkSession, root: str, parts: tuple[str, ...]) -> list[str]:
    """Commit batches of which every part was written to its end, remove other uncommitted ones; the names committed."""
    finished, done = [], set(committed(spark, root))
    for name in sorted({n.removeprefix("batch=") for part in parts for n in _names(spark, root, part)} - done):
        if all(fs.exists(p) for p, fs in (_path(spark, place(root, part, name), "_SUCCESS") for part in parts)):
            commit(spark, root, name)
            finished.append(name)
        else:
            remove(spark, root, name, parts)
    return finished


def remove(spark: SparkSession, root: str, name: str, parts: tuple[str, ...]) -> None:
    """Take a batch away: its mark first, so that it stops counting before its files go."""
    for where in (f"{root}/{MARKS}/{name}", *(place(root, part, name) for part in parts)):
        path, fs = _path(spark, where)
        fs.delete(path, True)


def _read(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    paths = [place(root, part, n) for n in committed(spark, root)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch string").option("basePath", f"{root}/{part}").parquet(*paths).drop("batch")


def scan(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with their year and month."""
    return _read(spark, root, "data", f"{schema}, year int, month int")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "manifest", MANIFEST)


def write_through(rows: DataFrame, root: str, fetched_at, ts_col: str = "ts_utc", after: Callable[[str], None] = lambda step: None) -> str | None:
    """Store the rows of keys (source, key) that the manifest lacks, and record them, in one commit; the batch's name.

    None when every key is known.  ``after`` is called with each step's name once it is done.
    """
    spark = rows.sparkSession
    recover(spark, root, ("data", "manifest"))
    fresh = skip_known(rows.select("source", "key").distinct(), manifest(spark, root))
    mark = fresh.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("source", "key")).alias("x")).first()
    if not mark["n"]:
        return None
    name = f"batch-{len(committed(spark, root)):06d}-{mark['n']:x}-{mark['x'] & (2**64 - 1):016x}"
    new = rows.join(fresh, ["source", "key"], "left_semi")
    with_months(new, ts_col).repartition("year", "month").write.partitionBy("year", "month").mode("overwrite").option("compression", "zstd").parquet(place(root, "data", name))
    after("data")
    stored = spark.read.schema(new.schema).parquet(place(root, "data", name))
    entries = content_hash(stored, ["source", "key"]).withColumn("fetched_at", F.lit(fetched_at).cast("timestamp"))
    enforce(entries, MANIFEST).write.mode("overwrite").parquet(place(root, "manifest", name))
    after("manifest")
    commit(spark, root, name)
    return name


def publish_docs(docs: DataFrame, root: str, keep: int = 2, after: Callable[[str], None] = lambda step: None) -> str | None:
    """Publish a version of the documents: a folder for each BA and one document of them all; its name.

    A BA without a new document keeps its last one.  None, and nothing changes, when there is no document.  The newest
    committed version counts; ``keep`` versions stay for readers that still have an older one open.
    """
    spark = docs.sparkSession
    recover(spark, root, ("by_ba", "combined"))
    if docs.isEmpty():
        return None
    names = committed(spark, root)
    if names:
        last = read_docs(spark, root, docs.schema)
        docs = docs.unionByName(last.join(docs.select("ba"), "ba", "left_anti"))
    name = f"v{int(names[-1][1:]) + 1 if names else 1:08d}"
    docs.withColumn("code", F.col("ba")).repartition("code").write.partitionBy("code").mode("overwrite").json(place(root, "by_ba", name))
    after("by_ba")
    whole = spark.read.schema(docs.schema).json(place(root, "by_ba", name))
    every = F.sort_array(F.collect_list(F.struct(*docs.columns)))  # a document a BA, as many as the registry has
    whole.agg(F.to_json(F.struct(F.max("as_of_utc").alias("as_of_utc"), every.alias("forecasts"))).alias("value")).coalesce(1).write.mode("overwrite").text(place(root, "combined", name))
    after("combined")
    commit(spark, root, name)
    for old in names[: max(0, len(names) + 1 - keep)]:
        remove(spark, root, old, ("by_ba", "combined"))
    return name


def read_docs(spark: SparkSession, root: str, schema, ba: str | None = None) -> DataFrame:
    """The current version's documents, or one BA's."""
    name = committed(spark, root)[-1]
    return spark.read.schema(schema).json(place(root, "by_ba", name) + (f"/code={ba}" if ba else "")).drop("code")


def read_combined(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.text(place(root, "combined", committed(spark, root)[-1]))
