"""Sharding by fixed virtual slots.

Every row hashes into one of a fixed number of virtual slots; bytes and rows are summed for each slot; a small versioned
table maps slots to shards.  Rebalancing edits that table (a few slots change their shard), never the hash.  All steps are
DataFrame expressions.

Law `bytes`: the sizes of the shards are near equal.  The first map hands out slots by decreasing size, each to the lightest
shard so far, so two shards differ by at most the size of the last slots handed out.  One row larger than a whole shard's
share cannot be split and stays one row.

Equal texts are told by their `text_crc32` and `size`; copies with different ids are dealt apart like any other rows, so a
group of copies, however large, fills no shard.

Defined results: a null text has no bytes (size 1, crc32 0); a null id hashes like any value, together with its text, so
neither many null ids nor one repeated id fill a single slot; fully equal rows share a slot and get positions in any order;
an empty table gives an empty result; further columns of the input are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
LAW = "bytes"


def placed(rows: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, size, text_crc32, virtual_slot` for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(placement: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: at most `slots` rows, summed map-side before the exchange."""
    return placement.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: DataFrame, slots: int, shards: int) -> DataFrame:
    """Version 1 of the slot map: `virtual_slot, shard, bytes, rows, version`, all slots included."""
    spark = loads.sparkSession
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    full = every.join(F.broadcast(loads), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
    listed = full.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "rows"))).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owners"))

    def hand_out(state, slot):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads_now = F.transform(state["loads"], lambda load, i: F.when(i == lightest, load - slot["minus"]).otherwise(load))
        return F.struct(loads_now.alias("loads"), F.concat(state["owners"], F.array(lightest)).alias("owners"))

    owners = listed.select("slots", F.aggregate("slots", start, hand_out)["owners"].alias("owners"))
    each = owners.select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
    return each.select(
        F.col("x.slots.virtual_slot"), F.col("x.owners").alias("shard"), (-F.col("x.slots.minus")).alias("bytes"), F.col("x.slots.rows"), F.lit(1).alias("version")
    )


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Store a map in the versioned table at `path` and read that version back.  A version that is there already is replaced, so
    each slot has one row a version; other versions stay."""
    version = slot_map.select("version").limit(1)
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    spark = slot_map.sparkSession
    stored = spark.read.parquet(path)
    return stored.join(F.broadcast(version), "version", "left_semi").select("virtual_slot", "shard", "bytes", "rows", "version")


def rebalanced(slot_map: DataFrame, shards_now: int, shards_next: int) -> DataFrame:
    """The next version for `shards_next` > `shards_now` shards: each old shard gives up slots beyond its new share, and only
    new shards receive them; all other slots keep their shard."""
    share = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    fair = slot_map.agg((F.sum("bytes") / shards_next).alias("fair"))
    load = Window.partitionBy("shard")
    moved = (
        slot_map.crossJoin(F.broadcast(fair))
        .withColumn("surplus", F.sum("bytes").over(load) - F.col("fair"))
        .withColumn("moves", (F.sum("bytes").over(share) - F.col("bytes") / 2 <= F.col("surplus")) & (F.col("bytes") > 0))
    )
    turn = F.row_number().over(Window.partitionBy("moves").orderBy(F.desc("bytes"), "virtual_slot")) - 1
    width = 2 * (shards_next - shards_now)
    there = F.pmod(turn, F.lit(width))
    target = shards_now + F.when(there < width / 2, there).otherwise(width - 1 - there)
    return moved.withColumn("target", target.cast("int")).select(
        "virtual_slot", F.when(F.col("moves"), F.col("target")).otherwise(F.col("shard")).alias("shard"), "bytes", "rows", (F.col("version") + 1).alias("version")
    )


def sharded(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, size, text_crc32, virtual_slot, shard, slot`; `slot` counts the rows of a shard from 0 without gaps.

    A row's position is the rows of the shard's earlier virtual slots plus its rank inside its own slot, so the numbering
    is spread over thousands of small groups instead of one sort for each shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = placed(rows, slots, id_col, text_col).withColumn("inside", inside)
    return ranked.join(F.broadcast(offsets), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("inside")).alias("slot")
    )


def shard_table(rows: DataFrame, map_path: str, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Build, store and apply version 1 of the slot map."""
    stored = store_map(first_map(slot_loads(placed(rows, slots)), slots, shards), map_path)
    return sharded(rows, stored, slots)


def op8(spark: SparkSession, docs: DataFrame, map_path: str) -> DataFrame:
    return shard_table(docs, map_path).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
