"""Sharding by minimax contiguous partition (native: DataFrame functions only).

Atomic groups are the texts; rows of equal text never part. Groups are ordered by a 64-bit text hash, and whole
groups fall into at most 2**CELL_BITS hash cells, so that what the driver sees is bounded whatever the input: one
(cell, bytes) pair per occupied cell. Over the ordered cell sizes a binary search finds the smallest capacity for
which a greedy left-to-right fill needs no more than the wanted number of shards, and the cuts are placed there.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

CELL_BITS = 16
SLOT_LANES = 1024


def greedy_cuts(prefix: list[int], capacity: int) -> list[int]:
    """Ends (exclusive) of the shards of a greedy fill; prefix[i] is the size of the first i cells."""
    ends, at = [], 0
    while at < len(prefix) - 1:
        nxt = bisect_right(prefix, prefix[at] + capacity) - 1
        if nxt == at:
            return []
        ends.append(nxt)
        at = nxt
    return ends


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts. No cells: capacity 0 and no cuts."""
    if not sizes:
        return 0, []
    prefix = [0, *accumulate(sizes)]
    low, high = max(max(sizes), -(-prefix[-1] // shards)), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        ends = greedy_cuts(prefix, middle)
        if ends and len(ends) <= shards:
            high = middle
        else:
            low = middle + 1
    return low, even_cuts(prefix, low, shards)


def even_cuts(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts that keep within the capacity; of those, each as near as may be to an even share of what is left, so that the greedy fill's slack doesn't all fall to the last shard."""
    latest = greedy_cuts(prefix, capacity)
    cells, total = len(prefix) - 1, prefix[-1]
    count = min(shards, cells)
    latest += [cells] * (count - len(latest))
    earliest, at = [cells], cells
    for _ in range(count - 1):
        at = bisect_left(prefix, prefix[at] - capacity) if at else 0
        earliest.append(max(at, 0))
    earliest.reverse()
    ends, at = [], 0
    for i in range(count - 1):
        goal = prefix[at] + (total - prefix[at]) / (count - i)
        near = bisect_left(prefix, goal)
        if near and goal - prefix[near - 1] < prefix[min(near, cells)] - goal:
            near -= 1
        reach = bisect_right(prefix, prefix[at] + capacity) - 1
        at = max(at + 1, min(max(near, earliest[i]), reach, latest[i], cells - (count - 1 - i)))
        ends.append(at)
    return [*ends, cells]


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares its group. Shards may stay empty
    where there are fewer groups than shards; an empty table gives an empty result. Rows repeated under one id get
    slots of their own. Null ids are kept. Other columns are ignored, whatever their names.
    """
    text = text_or_empty(docs, text_col)
    base = staged(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-base",
    )
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS)
    # At most 2**CELL_BITS rows reach the driver.
    cells = sorted((r["cell"], r["bytes"]) for r in base.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect())
    _, ends = minimax_cuts([b for _, b in cells], shards)
    last_cells = [cells[e - 1][0] for e in ends[:-1]]
    shard = F.lit(0)
    for last in last_cells:
        shard = shard + (cell > F.lit(last)).cast("int")
    placed = base.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_LANES)).cast("int").alias("lane"))
    # shards * SLOT_LANES rows at most, so the broadcast is bounded.
    lanes = placed.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("shard", "lane", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(lanes), ["shard", "lane"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
