"""Sharding by longest-processing-time scheduling.

Texts that are equal form a group and stay together. Groups are scheduled largest first, each to
the least-loaded shard through a heap. Groups of one size are a class: the heap takes the c
groups of a class at once, since the least-loaded shard of size-s steps is the next of the values
load + j * s in order, and how many of the c smallest values fall on a shard is found by
halving. So every group is scheduled by its own size, whatever the corpus: the driver sees one
row a distinct size, and d distinct sizes need d * d / 2 bytes of text (100 TB: at most 14 million,
in practice the lengths that texts have). Within a class groups go to the shards in the order
of their keys."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, join_counted, table

SHARDS = 8
#: Slots are numbered in so many parts of each shard, groups of a class in parts of about so many.
PARTS = 1024
PART_GROUPS = 10_000


def take_class(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` units of one size the heap gives each shard: the (load, shard) pairs that
    it pops are the smallest of load + j * size, ties by shard."""
    if count <= 4 * len(loads):
        heap, out = [(load, k) for k, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            out[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        return out
    popped = lambda top: [(top - load) // size + 1 if load <= top else 0 for load in loads]
    low, high = min(loads) - 1, max(loads) + count * size  # popped up to low: at most count; up to high: more
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(popped(middle)) <= count else (low, middle)
    out = popped(low)
    left = count - sum(out)
    for k, load in enumerate(loads):  # those popped next all stand at low + 1
        if left and load + out[k] * size == low + 1:
            out[k] += 1
            left -= 1
    return out


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, count) of the classes -> (size, count, units that each shard gets), largest first."""
    loads, out = [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        given = take_class(loads, size, count)
        loads = [load + size * n for load, n in zip(loads, given, strict=True)]
        out.append((size, count, given))
    return out


def assign(docs: DataFrame, shards: int = SHARDS, part_groups: int = PART_GROUPS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes + 1),
    text_crc32 (unsigned), shard, slot (gapless from 0 in each shard).

    A null text counts as empty: size 1, crc 0, grouped with empty texts. Repeated rows are equal
    texts and stay together, each with its own slot. Null ids are allowed. A group larger than a
    shard's share still stays whole. Texts of any length count by their bytes. An empty table gives
    no rows; further columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))
    rows = checkpoint(rows)
    groups = checkpoint(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    classes = groups.groupBy("bytes").agg(F.count("*").alias("count")).toPandas()  # a row for each distinct size
    plan = schedule(list(zip(classes["bytes"].tolist(), classes["count"].tolist(), strict=True)), shards)
    ends = [np.cumsum(given).tolist() for _, _, given in plan]
    frame = pd.DataFrame({"bytes": [p[0] for p in plan], "parts": [-(-p[1] // part_groups) for p in plan], "ends": ends})
    planned = broadcast_if_small(rows.sparkSession.createDataFrame(frame if plan else [], "bytes long, parts long, ends array<long>"))
    # the rank of a group in its class: parts of a class by hash of the key, then within a part
    parted = groups.join(planned, "bytes").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    counts = parted.groupBy("bytes", "part").agg(F.count("*").alias("n_part"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bytes", "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("key")) - 1
    ranked = parted.withColumn("place", place).join(offsets, ["bytes", "part"])
    shard = F.size(F.filter("ends", lambda end: end <= F.col("first") + F.col("place")))
    of_group = checkpoint(ranked.select("key", "n", shard.cast("int").alias("shard")))
    placed = join_counted(rows, of_group, "key", "n").select("doc_id", "size", "text_crc32", "key", "shard")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # <= shards * PARTS rows
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    out = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
