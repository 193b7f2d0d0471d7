"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups, by falling size, go to the least loaded shard through a heap.
Groups of one size are exchangeable, so the heap runs over the histogram of group sizes: each size says how many of its
groups every shard gets, and the groups, ranked within their size where they are, look their shard up. Sizes that differ
add up to at most all bytes, so there are at most sqrt(2 * bytes) of them on the driver: 14 million at 100 TB.

Copies of one text are summed up before a shuffle; groups of at least 1/HEAVY of all rows (HEAVY at most, by arithmetic) are
broadcast to their rows, the others are joined. Ranks within a size and slots within a shard are counted in PARTS parts, so
no task holds a frequent size or a shard.

Defined results: null text counts as empty (size 1, crc32 0) and stays with empty texts; repeated rows each get a slot; a
row with a null id gets a shard and a slot too; an empty table gives no rows. Groups of one size are ranked by their hash.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import as_table

HEAVY = 10_000
PARTS = 1024
#: So many sizes' rows are broadcast; beyond, they are joined.
BROADCAST_SIZES = 100_000


def longest_first(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """item -> shard, for (item, size) pairs; ties by smaller item and smaller shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        out[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def _many(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets: the heap's picks are the least of load + k * size, in order."""
    taken = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  picks below the level
    low, high = min(loads), max(loads) + size * count
    while high - low > 1:
        level = (low + high) // 2
        if sum(taken(level)) <= count:
            low = level
        else:
            high = level
    out = taken(low)
    left = count - sum(out)
    for shard, load in enumerate(loads):  # picks at the level itself, by shard
        if left and load <= low and (low - load) % size == 0:
            out[shard] += 1
            left -= 1
    return out


def dealt(histogram: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """(size, groups by shard) for (size, groups), longest first: what a heap over the single groups would do."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = []
    for size, count in sorted(histogram, reverse=True):
        own = [0] * n_shards
        if count <= 8 * n_shards:
            for _ in range(count):
                load, shard = heap[0]
                own[shard] += 1
                heapq.heapreplace(heap, (load + size, shard))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            own = _many(loads, size, count)
            heap = [(load + size * k, shard) for shard, (load, k) in enumerate(zip(loads, own, strict=True))]
            heapq.heapify(heap)
        out.append((size, own))
    return out


def _placed(groups: DataFrame, n_shards: int) -> DataFrame:
    """(group, shard) of groups (group, bytes)."""
    spark = groups.sparkSession
    counts = groups.groupBy("bytes").count().toArrow()
    found = dealt(list(zip(counts.column("bytes").to_pylist(), counts.column("count").to_pylist(), strict=True)), n_shards)
    until = [[sum(own[: k + 1]) for k in range(n_shards)] for _, own in found]
    shares = spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in found], pa.int64()), "until": pa.array(until, pa.list_(pa.int64()))}))
    shares = F.broadcast(shares) if len(found) <= BROADCAST_SIZES else shares
    parted = groups.withColumn("part", F.pmod("group", F.lit(PARTS)).cast("int"))
    cells = parted.groupBy("bytes", "part").count()  # PARTS rows of a size at most
    before = (F.sum("count").over(Window.partitionBy("bytes").orderBy("part")) - F.col("count")).alias("before")
    cells = cells.select("bytes", "part", before).join(shares, "bytes")
    own = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("group"))
    ranked = parted.withColumn("own", own).join(cells.hint("shuffle_merge"), ["bytes", "part"])
    rank = F.col("before") + F.col("own") - 1
    return ranked.select("group", F.size(F.filter("until", lambda u: u <= rank)).alias("shard"))


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, sizes of shards near equal."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = as_table(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")),
        "shard-rows",
    )
    groups = as_table(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    placed = as_table(_placed(groups.select("group", "bytes"), n_shards).join(groups.select("group", "n"), "group"), "shard-placed")
    bar = (total + HEAVY - 1) // HEAVY
    heavy = F.broadcast(placed.where(F.col("n") >= bar).select("group", "shard"))
    light = placed.where(F.col("n") < bar).select("group", "shard")
    found = rows.join(heavy, "group").union(rows.join(heavy.select("group"), "group", "left_anti").join(light, "group").select("group", *rows.columns[:-1], "shard"))
    dealt_ = as_table(found.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int").alias("part")), "shard-dealt")
    counts = dealt_.groupBy("shard", "part").count()  # n_shards * PARTS rows at most
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return dealt_.withColumn("own", own).join(F.broadcast(before), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
