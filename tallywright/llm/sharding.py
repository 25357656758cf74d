"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots. Bytes are added up per slot, and a versioned table maps
slots to shards. Version 1 deals slots round robin; rebalance() makes the next version by moving and
exchanging slots between the fullest and the emptiest shards. The map has one row per slot, so it
may be collected and broadcast at any size of the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch

SLOTS = 4096


def slot_of(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    """A row without an id is dealt by its text."""
    return F.pmod(F.when(id_col.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(id_col)), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The next version: the slot's shard by slot, edited until sizes are as near as slots allow.

    Slots leave shards above the mean, largest first, for the emptiest shard that the move improves;
    then pairs of slots of the fullest shard and others are exchanged while that lowers its excess.
    """
    owner, load = list(owner), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        held[shard].append(slot)
    mean = sum(load) / shards
    loose = []
    for shard in range(shards):
        held[shard].sort(key=lambda s: (weight[s], s))
        while load[shard] > mean and held[shard]:
            loose.append(slot := held[shard].pop())
            load[shard] -= weight[slot]
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        full, shard = heapq.heappop(heap)
        owner[slot] = shard
        held[shard].append(slot)
        load[shard] = full + weight[slot]
        heapq.heappush(heap, (load[shard], shard))
    for _ in range(8 * shards):  # exchange between the fullest shard and the others
        high = max(range(shards), key=lambda s: (load[s], s))
        best = None
        for low in sorted(range(shards), key=lambda s: (load[s], s))[: max(4, shards // 4)]:
            gap = load[high] - load[low]
            others = sorted((weight[s], s) for s in held[low]) + [(0, -1)]
            for a in held[high]:
                for w, b in _near(others, weight[a] - gap / 2):
                    moved = weight[a] - w
                    if 0 < moved < gap and (best is None or abs(gap - 2 * moved) - gap < best[0]):
                        best = (abs(gap - 2 * moved) - gap, a, b, low)
        if best is None:
            break
        _, a, b, low = best
        for slot, src, dst in ((a, high, low), (b, low, high)):
            if slot >= 0:
                held[src].remove(slot)
                held[dst].append(slot)
                owner[slot] = dst
                load[src] -= weight[slot]
                load[dst] += weight[slot]
    return owner


def _near(pairs: list[tuple[int, int]], want: float) -> list[tuple[int, int]]:
    lo, hi = 0, len(pairs)
    pairs.sort()
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if pairs[mid][0] < want else (lo, mid)
    return pairs[max(0, lo - 1) : lo + 1]


def grow(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The next version with one more shard, which takes slots only into itself."""
    owner, load = list(owner), [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
    goal = sum(load) / (shards + 1)
    for slot in sorted(range(len(owner)), key=lambda s: (-weight[s], s)):
        if load[owner[slot]] - weight[slot] >= goal * 0.98 and load[shards] + weight[slot] <= goal:
            load[owner[slot]] -= weight[slot]
            load[shards] += weight[slot]
            owner[slot] = shards
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Puts a version of the map in the store at path; other versions stay. Saved again, a version is replaced."""
    rows = spark.createDataFrame(list(enumerate(owner)), "vslot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def shard_documents(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot (its place in the shard), vslot, map_version.

    Size is the text's bytes in UTF-8 plus 16. Null text has no bytes and checksum 0. Repeated rows each
    have a place of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    store = store or f"{scratch.top}/map"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), slot_of(F.col(id_col), text, slots).alias("vslot"))
    rows = scratch.save(rows, "rows")
    per_slot = {r.vslot: (r.bytes, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    weight = [per_slot.get(s, (0, 0))[0] for s in range(slots)]
    owner = first_map(slots, shards)
    save_map(spark, store, 1, owner)
    owner = rebalance(owner, weight, shards)
    save_map(spark, store, 2, owner)
    start, before = [], [0] * shards  # places in a shard that its earlier slots take
    for slot, shard in enumerate(owner):
        start.append((slot, before[shard]))
        before[shard] += per_slot.get(slot, (0, 0))[1]
    places = spark.createDataFrame(start, "vslot int, start long")
    placed = load_map(spark, store, 2).join(F.broadcast(places), "vslot")  # one row per slot: at most `slots` rows
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "crc", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(placed), "vslot").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "vslot", F.lit(2).alias("map_version"),
    )
