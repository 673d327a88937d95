"""Sharding by fixed virtual slots.

A record hashes into one of a few thousand virtual slots.  Bytes and rows are added up per slot, and a versioned
map says which shard holds which slot.  The map has ``n_slots`` rows whatever the input holds, so it is the one
thing that passes through the driver.  Rebalancing edits the map: slots move, records never hash anew.

Null texts weigh one byte.  A null id is a value like any other.  The slot comes from the id, the size and the
checksum of the record, so neither rows without an id nor copies of a text meet in one slot; only rows equal in all
three do.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.session import scratch_path

MAP_SCHEMA = "version int, vslot int, shard int, n_bytes bigint, n_rows bigint"


def records(df: DataFrame, id_col: str, text_col: str, n_slots: int) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_weights(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most ``n_slots`` rows."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")).collect()
    return sorted((r["vslot"], r["n_bytes"], r["n_rows"]) for r in found)


def edit_map(
    weights: list[tuple[int, int, int]], n_shards: int, previous: dict[int, int] | None = None
) -> dict[int, int]:
    """Slot to shard.  Slots stay where ``previous`` has them unless their shard is above the mean.

    A shard above the mean gives up slots, the smallest that brings it down or else its largest; the slots given
    up, new ones and those of shards that no longer exist go, largest first, to the lightest shard.
    """
    size = {slot: n_bytes for slot, n_bytes, _ in weights}
    mean = sum(size.values()) / n_shards
    kept: list[list[int]] = [[] for _ in range(n_shards)]
    free: list[int] = []
    for slot in sorted(size):
        at = (previous or {}).get(slot, n_shards)
        (kept[at] if at < n_shards else free).append(slot)
    loads = [sum(size[s] for s in slots) for slots in kept]
    for at, slots in enumerate(kept):
        slots.sort(key=lambda s: (size[s], s))
        while slots and loads[at] > mean:
            over = loads[at] - mean
            gone = next((i for i, s in enumerate(slots) if size[s] >= over), len(slots) - 1)
            if size[slots[gone]] > 2 * over:  # the shard would fall further below the mean than it is above
                break
            loads[at] -= size[slots[gone]]
            free.append(slots.pop(gone))
    heap = [(load, at) for at, load in enumerate(loads)]
    heapq.heapify(heap)
    out = {slot: at for at, slots in enumerate(kept) for slot in slots}
    for slot in sorted(free, key=lambda s: (-size[s], s)):
        load, at = heapq.heappop(heap)
        out[slot] = at
        heapq.heappush(heap, (load + size[slot], at))
    return out


def store_map(
    spark: SparkSession, path: str, version: int, weights: list[tuple[int, int, int]], shard_of: dict[int, int]
) -> None:
    """Add one version to the map kept under ``path``; earlier versions stay readable."""
    rows = [(version, slot, shard_of[slot], n_bytes, n_rows) for slot, n_bytes, n_rows in weights]
    frame = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    frame.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, n_bytes bigint, n_rows bigint").parquet(f"{path}/version={version}")


def rebalance(spark: SparkSession, path: str, version: int, rows: DataFrame, n_shards: int) -> int:
    """Weigh ``rows`` anew, edit version ``version`` of the map for ``n_shards`` and store it as the next version."""
    weights = slot_weights(rows)
    old = {r["vslot"]: r["shard"] for r in load_map(spark, path, version).select("vslot", "shard").collect()}
    store_map(spark, path, version + 1, weights, edit_map(weights, n_shards, old))
    return version + 1


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the place inside the shard, counted from 0 without gaps.

    The place is the number of rows in the shard's earlier virtual slots (from the map) plus the place inside the
    virtual slot, so the window runs over one of thousands of slots and not over a shard.
    """
    ahead = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    known = slot_map.select(
        "vslot", "shard", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)).cast("bigint").alias("_before")
    )
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(known), "vslot")  # at most n_slots rows
        .withColumn("slot", (F.col("_before") + F.col("_at") - 1).cast("bigint"))
        .drop("_before", "_at")
    )


def shard_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, n_slots: int = 4096,
    map_path: str | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, shard, slot`` of every row under a fresh map, stored as version 0."""
    spark = df.sparkSession
    rows = records(df, id_col, text_col, n_slots)
    path = map_path or scratch_path(spark, "slot-map")
    weights = slot_weights(rows)
    store_map(spark, path, 0, weights, edit_map(weights, n_shards))
    return place(rows, load_map(spark, path, 0))
