"""A corpus pipeline of five stages, each applying one operator to all documents that the stage before kept.

quality -> near duplicates -> repeated passages -> benchmark leaks -> packing.  All stages but the last return the
columns of documents.  Rows with a null doc_id take part in every stage; they count as copies of each other, never of rows
with an id.  Inside a stage a row goes by a key, the hash of all its columns: only rows equal in every column share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm import decontaminate, packing, quality, simhash, suffix
from gridjobs.llm.common import load, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near copies: five words, similarity 0.8.  Candidates share a segment of 25 of 768 bits but for one of its 7 weakest, and
#: differ in at most 148 bits (three deviations over the 116 that similarity 0.8 makes likely); similarity decides.
NEAR = {"shingle": 5, "width": 12, "cut_into": 36, "bits": 25, "delete": 7, "max_diff": 148, "jaccard": 0.8}

#: Learned models and hashes outside SQL take part in the stages; tests/llm compare each with a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose co-trained quality score is at least one half."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the column key, the same in every run."""
    return docs.select(*COLUMNS).withColumn("key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Of its rows without an id one is kept as well.
    """
    docs = keyed(docs)
    groups = simhash.near_duplicates(docs, id_col="key", **NEAR)
    placed = groups.select(F.col("doc_id").alias("key"), "component_id").distinct().join(docs.select("key", "doc_id").distinct(), "key")
    first = placed.groupBy("component_id", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    return docs.join(first, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that occur elsewhere; documents of which nothing is left go.

    A removed passage takes characters that it cuts through with it; n_chars follows the new text.
    """
    docs = docs.select(*COLUMNS)
    found = suffix.remove_repeats(docs, keep=["lang", "source"], as_text=True, words=51).withColumnRenamed("kept", "text")
    return found.where("n_bytes = 0 OR length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    docs = keyed(docs)
    leaks = decontaminate.overlaps(docs, load(spark, sf_dir, "benchmark"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(materialize(leaks, "leaks"), "key", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 4096 tokens."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2, keep_ids=False))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", no_benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
