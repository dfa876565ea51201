"""Sharding through fixed virtual slots.

Every record is hashed into one of thousands of virtual slots; the number of slots never changes.  Bytes and rows are
added up for each slot.  A slot that holds more than the mean (one id or text may hold a third of all rows) is cut into
sub-slots; a record of it takes its sub-slot from a second hash, of its running number, so that even equal records spread.
The versioned map (slot, sub-slot) -> shard is stored as a table.  The first map places sub-slots, largest first, on the
shard with the fewest bytes; a rebalance reads the map, moves only sub-slots that leave an overfull shard, and stores the
next version.  Records themselves only ever look up their slot and sub-slot.

All steps are DataFrame expressions.  The slot and map tables have at most ``2 * n_slots`` rows whatever the input, which
bounds the broadcasts and the array that the placement folds over.  Positions inside a shard come from a row number within
the sub-slot and the rows of the shard's earlier ones, so no shard and no hot key is gathered in one task.

Nulls: a null text has size 1 and CRC 0; a null id is hashed by its text's CRC, so that such rows spread.  Repeated rows
keep their own positions; ties of size are placed by slot, ties inside a sub-slot by running number.  An empty table gives
no rows.  A slot without rows is still in the map.  Running numbers are those of the table ``with_slot`` writes, so every
later step sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize, scratch_path

N_SLOTS = 4096
SLOT = ["vslot", "sub"]


def with_slot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, vslot, number), written once: number counts rows within each partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    rows = rows.withColumn("vslot", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.col("text_crc32"))), F.lit(n_slots)).cast("int"))
    return materialize(rows.withColumn("number", F.monotonically_increasing_id()), "records")


def with_sub(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """The records with their sub-slot: a slot over the mean slot's bytes has as many as it holds means (rows at most)."""
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    mean = sums.agg((F.sum("bytes") / n_slots).alias("mean"))
    cuts = sums.join(F.broadcast(mean)).select("vslot", F.least("n_rows", F.ceil(F.col("bytes") / F.col("mean"))).alias("cuts"))
    return records.join(F.broadcast(cuts), "vslot").withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), "number"), F.col("cuts")).cast("int")).drop("cuts")


def slot_loads(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows (vslot, sub, bytes, n_rows) for all slots, also the empty ones."""
    spark = records.sparkSession
    sums = records.groupBy(*SLOT).agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    return spark.range(n_slots).select(F.col("id").cast("int").alias("vslot")).join(sums, "vslot", "left").fillna(0, ["sub", "bytes", "n_rows"])


def place(loads: DataFrame, shards: int) -> DataFrame:
    """First map (vslot, sub, shard): sub-slots in descending order of bytes, each to the shard with the fewest bytes so far."""
    listed = loads.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), *SLOT))).alias("slots"))
    folded = F.expr(f"""
        aggregate(slots,
            named_struct('held', array_repeat(0L, {shards}), 'map', cast(array() AS array<struct<vslot: int, sub: int, shard: int>>)),
            (a, s) -> named_struct(
                'held', transform(a.held, (h, i) -> IF(i = array_position(a.held, array_min(a.held)) - 1, h - s.less, h)),
                'map', concat(a.map, array(named_struct('vslot', s.vslot, 'sub', s.sub, 'shard', int(array_position(a.held, array_min(a.held)) - 1))))),
            a -> a.map)""")
    return listed.select(F.inline(folded))


def grow(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map edited for one more shard: each shard gives sub-slots up to its excess over the new mean; others stay."""
    held = slot_map.join(loads, SLOT)
    w = Window.partitionBy("shard").orderBy("bytes", *SLOT)
    own = Window.partitionBy("shard")
    total = held.agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    return held.withColumn("given", F.sum("bytes").over(w)).withColumn("own", F.sum("bytes").over(own)).join(F.broadcast(total)).select(*SLOT, F.when(F.col("given") <= F.col("own") - F.col("mean"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Append one version to the map's table; readers take the version they are told or the newest."""
    slot_map.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).drop("version")


def assign(records: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and position (gapless from 0 within each shard) to the records."""
    w = Window.partitionBy("shard").orderBy(*SLOT).rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(loads, SLOT).withColumn("first", F.coalesce(F.sum("n_rows").over(w), F.lit(0))).select(*SLOT, "shard", "first")
    place_in = Window.partitionBy(*SLOT).orderBy("doc_id", "text_crc32", "size", "number")
    return records.withColumn("place", F.row_number().over(place_in) - 1).join(F.broadcast(starts), SLOT).withColumn("position", F.col("first") + F.col("place")).drop("first", "place", "number")


def op8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_sub(with_slot(load(spark, sf_dir, "documents")))
    loads = materialize(slot_loads(records), "loads")
    path = scratch_path(spark, "slotmap")
    save_map(place(loads, 8), path, 1)
    out = assign(records, loads, read_map(spark, path))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("sub").alias("sub_slot"))
