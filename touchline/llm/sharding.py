"""Sharding over fixed virtual slots.

Every record hashes into one of a few thousand virtual slots; the slots never change. A small table, the slot
map, says which shard a slot belongs to. The bytes of each slot are summed in one aggregate, and the map deals the
slots to shards so that the shards' bytes come out nearly equal. Rebalancing writes a new version of the map that
moves only as many slots as it must; the records are not hashed again.

The dealing is a fold over one array of ``slots`` entries, so its size is a parameter and does not depend on the data.
Everything is DataFrame and SQL code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, text_or_empty, utf8
from touchline.operators.staging import stage

SLOTS = 4096
SHARDS = 40
RECORD_OVERHEAD = 16


def slot_of(id_col: str, crc: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record. The text's checksum takes part, so that rows without an id spread as well."""
    return F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that holds something: virtual_slot, bytes, n."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _deal(slots_with_load: DataFrame, loads: DataFrame) -> DataFrame:
    """Largest slot first onto the lightest shard. ``loads`` is one row with the array ``loads`` (bytes per shard)."""
    fold = """
        aggregate(
          pile,
          named_struct('loads', loads, 'place', cast(array() as array<int>), 'next', cast(array_position(loads, array_min(loads)) - 1 as int)),
          (acc, x) -> transform(
            array(transform(acc.loads, (v, i) -> if(i = acc.next, v - x.minus, v))),
            l -> named_struct('loads', l, 'place', concat(acc.place, array(acc.next)), 'next', cast(array_position(l, array_min(l)) - 1 as int))
          )[0],
          acc -> acc.place)"""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "n")))
    pile = slots_with_load.agg(order.alias("pile"))
    placed = pile.crossJoin(loads).select("pile", F.expr(fold).alias("place"))  # one row beside one row
    both = F.explode(F.arrays_zip("pile", "place")).alias("z")
    return placed.select(both).select(
        F.col("z.pile.virtual_slot").alias("virtual_slot"),
        F.col("z.place").alias("shard"),
        (-F.col("z.pile.minus")).alias("bytes"),
        F.col("z.pile.n").alias("n"),
    )


def _all_slots(per_slot: DataFrame, slots: int) -> DataFrame:
    every = per_slot.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("bigint")
    return every.join(per_slot, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("n", zero).alias("n")
    )


def first_map(per_slot: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the slot map: version, virtual_slot, shard, bytes, n; empty slots are dealt too."""
    spark = per_slot.sparkSession
    empty = spark.range(1).select(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"))
    return _deal(_all_slots(per_slot, slots), empty).select(F.lit(1).alias("version"), "*")


def edit_map(old: DataFrame, per_slot: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Next version of a slot map for new slot sizes or another number of shards.

    A shard keeps its slots, largest first, while their sum stays within the even share; what is above it, and every
    slot of a shard that is gone, is dealt to the lightest shards. All other slots stay where they are.
    """
    spark = per_slot.sparkSession
    now = _all_slots(per_slot, slots).join(old.select("version", "virtual_slot", "shard"), "virtual_slot", "left")
    share = per_slot.agg((F.coalesce(F.sum("bytes"), F.lit(0)) / shards).alias("share"))
    along = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = now.withColumn("_sum", F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("shard") < shards) & (F.col("_sum") <= F.col("share"))
    judged = held.crossJoin(share).withColumn("_stays", F.coalesce(fits, F.lit(False)))  # one row
    stays = judged.where("_stays").select("virtual_slot", "shard", "bytes", "n")
    loaded = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(
        stays.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard", "left"
    )
    pairs = F.array_sort(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"))))
    loads = loaded.agg(F.transform(pairs, lambda p: p["bytes"]).alias("loads"))
    moved = _deal(judged.where("NOT _stays").select("virtual_slot", "bytes", "n"), loads)
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    return version.crossJoin(stays.unionByName(moved)).select("version", "virtual_slot", "shard", "bytes", "n")  # one row


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the folder of maps; earlier versions stay readable."""
    slot_map.write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest when none is named."""
    maps = spark.read.parquet(folder)
    wanted = version if version is not None else maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == wanted).select("version", "virtual_slot", "shard", "bytes", "n")


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and a fixed overhead), text_crc32 and virtual_slot of every row."""
    data = utf8(text_or_empty(text_col))
    crc = F.crc32(data).cast("bigint")
    size = (F.octet_length(text_or_empty(text_col)) + RECORD_OVERHEAD).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn(
        "virtual_slot", slot_of("doc_id", F.col("text_crc32"), slots)
    )


def place_records(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its place in the shard, counted from 0 without gaps.

    A record's place is the number of rows in earlier slots of its shard plus its rank inside its own slot, so no
    task holds more than one slot's rows.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("_start") + F.col("_rank")).cast("bigint"))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deal all documents to shards 0 .. shards-1 of nearly equal bytes.

    Returns doc_id, size, text_crc32, virtual_slot, shard and slot (place in the shard), one row per input row. A null
    text counts as empty, a null id is hashed by its text; rows that repeat id and text share a slot and get places of
    their own; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    records = stage(records_of(docs, id_col, text_col, slots))
    slot_map = stage(first_map(slot_bytes(records), shards, slots))
    return place_records(records, slot_map).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(documents(spark, folder))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
