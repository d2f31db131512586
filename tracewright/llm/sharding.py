"""Sharding by longest-processing-time scheduling.

Items that must stay together (equal texts) form a group; groups are placed largest first,
each on the shard that is least loaded so far, which a heap finds. Groups of the same bytes
are alike to the schedule, so it is made for sizes and their number of groups: the heap deals
a size's groups to the shards, and where they are more than the shards, the level that they
fill the shards up to gives the same counts at once. A group's place among those of its size
then says which shard it is.

The driver sees one row for each distinct size of a group. Sizes are distinct numbers that add
up to the corpus' bytes at most, so there are fewer than the root of twice the bytes, and in
practice about as many as texts have lengths. All else is grouped aggregation and joins.

Defined results: a null text has no bytes and size 16, and null and empty texts are one
group; a null id is placed as any other row; repeated rows each get a slot; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_by_key
from .util import materialize

OVERHEAD = 16
SLICES = 64


def level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of a size each shard gets, one by one to the least loaded.

    Each shard offers its load, then that plus size, and so on; the least offers are taken.
    """
    taken = lambda t: [max(0, -((x - t) // size)) for x in loads]  # offers below t
    low, high = min(loads), max(loads) + size * (count + 1)
    while low < high:  # the largest t with no more than count offers below it
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(taken(middle)) <= count else (low, middle - 1)
    found = taken(low)
    rest = count - sum(found)
    for s, x in enumerate(loads):
        if rest and x <= low and (low - x) % size == 0:
            found[s] += 1
            rest -= 1
    return found


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """LPT of (size, groups), largest size first: how many of a size's groups each shard gets.
    Ties of load go by shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for size, count in sorted(sizes, reverse=True):
        if count > shards:
            loads = [x for _, x in sorted((s, x) for x, s in heap)]
            dealt = level(loads, size, count)
            heap = [(x + size * n, s) for s, (x, n) in enumerate(zip(loads, dealt, strict=True))]
            heapq.heapify(heap)
        else:
            dealt = [0] * shards
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                dealt[shard] += 1
        placed.append((size, dealt))
    return placed


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, checksum and group key of each row; the text itself goes no further."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("group_key"),
    )


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    rows = materialize(describe(docs, id_col, text_col), "shard-rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.withColumn("slice", F.pmod(F.xxhash64("group_key"), F.lit(SLICES)).cast("int")), "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    placed = []
    for size, dealt in schedule([(r["bytes"], r["n"]) for r in sizes.toLocalIterator()], shards):
        ends, end = [], 0
        for n in dealt:
            end += n
            ends.append(end)
        placed.append((size, ends))
    ends = spark.createDataFrame(placed, "bytes long, ends array<long>")
    # the place of a group among those of its size; a size may have very many groups
    nth = running_by_key(groups, ["bytes"], {"nth": ("sum", F.lit(1).cast("long"))}, ["slice", "group_key"], block=F.col("slice"))
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    homes = materialize(nth.join(ends, "bytes").select("group_key", shard.alias("shard")), "shard-homes")
    return with_slots(rows.join(homes, "group_key").select("doc_id", "size", "text_crc32", "shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is numbered in slices by a hash of the row, whose first numbers follow from a
    count of rows for each slice (shards * SLICES rows), so no task sorts a whole shard.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLICES)).cast("int"))
    sizes = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        sliced.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(first), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
    )
