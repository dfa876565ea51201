"""Helpers shared by the corpus operators: scratch tables, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder that the session names in spark.checkpoint.dir.

    Where that setting is absent a temporary folder is made once per session if all runs on one machine; on a cluster its
    absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="gridjobs-")
        root = _own_root[app]
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star round over (u, v) edges."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Connected components of an edge table: rows (node, component), component the smallest node reached.

    Alternating large-star and small-star rounds; each round is a few shuffles of the edges and is written to the
    shared folder.  Nodes without an edge to another node, and edges with a null end, are absent.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(mark) == before or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v")).distinct()
        before = tuple(mark)
        edges = materialize(_star(_star(edges, True), False), "edges")
