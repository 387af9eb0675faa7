"""Sharding over fixed virtual slots, in DataFrame operations only.

Records are hashed into a fixed number of virtual slots, far more than shards. The bytes of each slot are
summed, and a versioned map says which shard holds which slot. Rebalancing edits the map: it moves as few
slots as it needs from full shards to free ones and writes the next version; records never hash anew.

The law here is `bytes`: the shards' sizes are near equal, whatever the texts, as the map is made from the
bytes per slot. Equal texts may lie in different shards, so a text that makes up a third of all rows does
not fill one shard.

Defined results: a null text has no bytes, size 1 and the crc32 of the empty string; null doc_ids and
repeated rows are spread by what else tells them apart, their text's crc32; an empty table gives no rows and
a map of empty slots; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table_or_none

SHARDS = 16
SLOTS = 1 << 12
#: rebalancing stops when the fullest shard is within this share of the mean
TOLERANCE = 0.01


def virtual_slot(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def measured(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record; texts go no further."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = documents.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return out.withColumn("vslot", virtual_slot(slots))


def even_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first slot-to-shard map: the largest slot left goes to the emptiest shard."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (load + sizes.get(slot, 0), k))
    return out


def rebalanced_map(sizes: dict[int, int], old: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """The old map, edited: slots of shards that no longer exist, and then slots of the fullest shards, move to the emptiest."""
    out = dict(old)
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    homeless = []
    for slot, k in out.items():
        if k in load:
            load[k] += sizes.get(slot, 0)
            held[k].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        k = min(load, key=lambda x: (load[x], x))
        out[slot] = k
        load[k] += sizes.get(slot, 0)
        held[k].append(slot)
    mean = sum(load.values()) / shards
    for _ in range(len(out)):
        full, free = max(load, key=lambda x: (load[x], -x)), min(load, key=lambda x: (load[x], x))
        if load[full] <= mean * (1 + tolerance) and load[free] >= mean * (1 - tolerance):
            break
        gap = load[full] - load[free]
        fitting = [s for s in held[full] if 0 < sizes.get(s, 0) < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        held[full].remove(slot)
        held[free].append(slot)
        load[full] -= sizes[slot]
        load[free] += sizes[slot]
        out[slot] = free
    return out


def map_table(spark: SparkSession, shards: dict[int, int], sizes: dict[int, int], version: int) -> DataFrame:
    """version, vslot, shard, bytes: one row for each slot."""
    rows = json.dumps([{"vslot": s, "shard": k, "bytes": sizes.get(s, 0)} for s, k in sorted(shards.items())])
    slots = F.explode(F.from_json(F.lit(rows), "array<struct<vslot:int,shard:int,bytes:long>>")).alias("r")
    return spark.range(1).select(slots).select(F.lit(version).alias("version"), "r.vslot", "r.shard", "r.bytes")


def save_map(table: DataFrame, path: str) -> None:
    """Append a version to the map's history."""
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A version of the map, the latest by default; it has one row for each slot."""
    history = spark.read.parquet(path)
    version = history.agg(F.max("version")).first()[0] if version is None else version
    return version, {r.vslot: r.shard for r in history.filter(F.col("version") == version).select("vslot", "shard").collect()}


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes by virtual slot: one number for each of a fixed count of slots."""
    return {r.vslot: r.b for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def shard(documents: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot (the place in the shard, gapless from 0) of every record.

    The map at `path` gets its first version, or a rebalanced next one if it has one. A record's place is
    the number of records in its shard's earlier virtual slots plus its rank in its own; only narrow rows
    are shuffled, by virtual slot. The slot table has SLOTS rows and is broadcast.
    """
    spark = documents.sparkSession
    records = measured(documents, slots)
    stats = {r.vslot: (r.b, r.n) for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    sizes = {s: b for s, (b, _) in stats.items()}
    if table_or_none(spark, path, "vslot int, shard int, bytes long, version int") is None:
        version, held = 0, even_map(sizes, shards, slots)
    else:
        version, old = load_map(spark, path)
        held = rebalanced_map(sizes, old, shards)
    save_map(map_table(spark, held, sizes, version + 1), path)
    places, upto = [], [0] * shards
    for s in range(slots):
        places.append({"vslot": s, "shard": held[s], "first": upto[held[s]]})
        upto[held[s]] += stats.get(s, (0, 0))[1]
    rows = F.explode(F.from_json(F.lit(json.dumps(places)), "array<struct<vslot:int,shard:int,first:long>>")).alias("r")
    table = spark.range(1).select(rows).select("r.vslot", "r.shard", "r.first")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = records.withColumn("rank", rank).join(F.broadcast(table), "vslot")
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(documents, f"{shared_dir(spark)}/factlake/shard-map-{uuid.uuid4().hex}")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
