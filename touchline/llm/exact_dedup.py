"""Exact deduplication against immutable snapshots.

A snapshot is the digests of a batch that is already stored: one row per distinct text, with the row that stands for
it and its number of rows, cut into slots by digest. Beside each slot lies a static binary fuse filter of its digests
(about nine bits per digest), built once and never changed. An incoming batch is first grouped by digest, so its own
duplicates are settled among themselves; its distinct digests are then screened by the filters of their slot. What a
filter lets through joins the exact slot, and the two texts are compared byte by byte before the groups are merged.

Groups are merged before every shuffle: a text that a third of all rows repeat is one row per task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, free_name, held_out, once, text_or_empty
from touchline.operators.staging import stage

ROWS_PER_SLOT = 250_000


@dataclass(frozen=True)
class Snapshot:
    """An immutable batch: ``digests`` (slot, digest, key, rep_id, size) and ``filters`` (slot, seed, segment, bits)."""

    digests: DataFrame
    filters: DataFrame
    slots: int


# ---------------------------------------------------------------- binary fuse filter


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalising mix of the keys under a seed."""
    x = keys + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(mixed: np.ndarray, segment: int, count: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments: an array of shape (3, keys)."""
    mask = np.uint64(segment - 1)
    first = ((mixed >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((mixed >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (mixed & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_layout(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of starting segments for n keys."""
    if n < 2:
        return 4, 1
    segment = 2 ** int(math.floor(math.log(n) / math.log(3.33) + 2.25))
    segment = min(segment, 2**18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    total = int(round(n * factor))
    return segment, max(1, -(-total // segment) - 2)


def build_fuse(keys: np.ndarray, tries: int = 100) -> tuple[int, int, int, np.ndarray]:
    """Filter of distinct 64-bit keys: seed, segment, starting segments and cells.

    Keys that are alone in some cell are peeled off round by round; cells are then set in the opposite order, so that
    the three cells of a key combine to its print. A seed that leaves keys unpeeled is replaced.
    """
    keys = np.unique(keys.astype(np.uint64))
    segment, count = fuse_layout(len(keys))
    cells = (count + 2) * segment
    for seed in range(1, tries + 1):
        mixed = _mix(keys, seed)
        at = _places(mixed, segment, count)
        load = np.bincount(at.ravel(), minlength=cells).astype(np.int64)
        owner = np.zeros(cells, dtype=np.int64)  # xor of the indexes of a cell's keys
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        gone = np.zeros(len(keys), dtype=bool)
        rounds = []
        front = np.flatnonzero(load == 1)
        while len(front):
            members, first = np.unique(owner[front], return_index=True)
            chosen = front[first]
            rounds.append((members, chosen))
            gone[members] = True
            touched = at[:, members].ravel()
            np.subtract.at(load, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(members, 3))
            touched = np.unique(touched)
            front = touched[load[touched] == 1]
        if gone.all():
            break
    else:
        raise RuntimeError(f"no seed of {tries} orders {len(keys)} keys")
    table = np.zeros(cells, dtype=np.uint8)
    wanted = _prints(mixed)
    for members, chosen in reversed(rounds):
        three = at[:, members]
        others = table[three[0]] ^ table[three[1]] ^ table[three[2]] ^ table[chosen]
        table[chosen] = wanted[members] ^ others
    return seed, segment, count, table


def fuse_holds(keys: np.ndarray, seed: int, segment: int, count: int, table: np.ndarray) -> np.ndarray:
    """True for every key of the filter and for about one foreign key in 256."""
    mixed = _mix(keys.astype(np.uint64), seed)
    at = _places(mixed, segment, count)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == _prints(mixed)


# ---------------------------------------------------------------- snapshots


def grouped_digests(rows: DataFrame, slots: int) -> DataFrame:
    """One row per digest: slot, digest, key (first 60 bits), the largest id and the number of rows."""
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("size"))
    keyed = groups.withColumn("key", key)
    return keyed.select(F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"), "digest", "key", "rep_id", "size")


FILTER_TYPE = "slot int, seed int, segment int, starts int, cells binary"


def _filter_of_slot(part: pd.DataFrame) -> pd.DataFrame:
    seed, segment, count, table = build_fuse(part["key"].to_numpy())
    return pd.DataFrame({"slot": [part["slot"].iloc[0]], "seed": [seed], "segment": [segment], "starts": [count], "cells": [table.tobytes()]})


def take_snapshot(rows: DataFrame, slots: int) -> Snapshot:
    """Freeze a batch of rows (doc_id, digest): its digests and their filters are written once."""
    digests = stage(grouped_digests(rows, slots))
    filters = stage(digests.select("slot", "key").groupBy("slot").applyInPandas(_filter_of_slot, FILTER_TYPE))
    return Snapshot(digests, filters, slots)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of a grouped batch that the snapshot's filters let through: slot, digest, rep_id, size.

    Every digest that the snapshot holds is among them. A slot without a filter lets nothing through.
    """

    def sieve(keys, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return mine.drop(columns="key").iloc[:0]
        f = theirs.iloc[0]
        table = np.frombuffer(f["cells"], dtype=np.uint8)
        held = fuse_holds(mine["key"].to_numpy(), int(f["seed"]), int(f["segment"]), int(f["starts"]), table)
        return mine.drop(columns="key")[held]

    id_type = dict(batch.dtypes)["rep_id"]
    both = batch.select("slot", "digest", "key", "rep_id", "size").groupBy("slot").cogroup(snapshot.filters.groupBy("slot"))
    return both.applyInPandas(sieve, f"slot int, digest string, rep_id {id_type}, size bigint")


def same_bytes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of the pairs (digest, old_id, new_id) whose two texts are equal byte by byte; ``docs`` has doc_id, text.

    Where an id may stand on several texts, ``docs`` has their digest besides, and only texts of the pair's digest are
    compared. A null id has no text to look up: such a pair rests on its digest.
    """
    by = ["doc_id", "digest"] if "digest" in docs.columns else ["doc_id"]
    sides = pairs.select("digest", F.explode(F.array("old_id", "new_id")).alias("doc_id"))
    texts = sides.join(docs, by, "left").select("digest", "text")
    spread = texts.groupBy("digest").agg(F.min("text").alias("_a"), F.max("text").alias("_b"))
    return spread.where(F.coalesce(F.col("_a") == F.col("_b"), F.lit(True))).select("digest")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest (SHA-256 of the UTF-8 bytes, lowercase hex) of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("digest"))


def merge_batch(rows: DataFrame, snapshot: Snapshot, docs: DataFrame) -> DataFrame:
    """Groups of equal texts over a snapshot and a batch of rows: digest, keep_id, group_size, for groups of two and more."""
    batch = stage(grouped_digests(rows, snapshot.slots))
    through = stage(screen(batch, snapshot))
    old = snapshot.digests.select("digest", F.col("rep_id").alias("old_id"), F.col("size").alias("old_size"))
    met = stage(through.select("digest", F.col("rep_id").alias("new_id"), F.col("size").alias("new_size")).join(old, "digest"))
    equal = stage(same_bytes(met.select("digest", "old_id", "new_id"), docs))
    merged = met.join(equal, "digest", "left_semi")
    joint = merged.select(
        "digest", F.greatest("old_id", "new_id").alias("keep_id"), (F.col("old_size") + F.col("new_size")).alias("group_size")
    )
    alone = [
        side.where("size > 1").join(joint, "digest", "left_anti").select("digest", F.col("rep_id").alias("keep_id"), F.col("size").alias("group_size"))
        for side in (snapshot.digests, batch)
    ]
    return joint.unionByName(alone[0]).unionByName(alone[1])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Group all rows with equal texts; of each group the row with the largest id stays.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Half of the rows (by checksum of the id)
    are the stored snapshot, the other half the incoming batch; every row is in one of them. A null text equals the
    empty one. A null id is smaller than any other; a group of null ids only has a null keep_id and keeps its rows.
    Rows that repeat id and text are one document: all of them carry the same answer; rows that repeat an id with
    different texts stay apart. Other columns are not read; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stage(digest_rows(docs, id_col, text_col))
    total = rows.count()
    slots = max(1, -(-total // rows_per_slot), min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    old = held_out("doc_id", 2, 0)
    snapshot = take_snapshot(rows.where(old), slots)
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    groups = stage(merge_batch(rows.where(~old), snapshot, plain.withColumn("digest", F.sha2("text", 256))))
    joined = rows.join(groups, "digest", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text, also where rows repeat id and text."""
    groups = stage(exact_groups(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_sha256", "kept"))
    who, what = free_name(docs, "_gone"), free_name(docs, "_digest")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias(who), F.col("text_sha256").alias(what)).distinct()
    same = docs[id_col].eqNullSafe(F.col(who)) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col(what))
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("who"), F.col("text_sha256").alias("what")).count()
    return once(docs.join(gone, same, "left_anti"), kept.where("count > 1"), id_col, text_col)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
