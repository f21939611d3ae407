"""Operator 9: documents into shards by best-fit decreasing.

Documents with equal texts form a group that is never split. Groups enter, largest first, the open shard with the
tightest remaining capacity that still holds them; the shards stand in a balanced tree ordered by remaining capacity.
The driver sees a histogram of group sizes, never the groups: equal sizes are placed in bulk (placing an item in the
tightest shard leaves it the tightest, so a run of equal items fills shard after shard exactly as one by one). The
histogram is bounded: sizes under 2^16 stand for themselves, larger ones are counted upwards in steps of 1/1024.

Null text: no bytes, a group with the empty texts. Null ids order last. Repeated rows keep their own slot each. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, global_rank, order_id

EXACT = 1 << 16


class CapacityTree:
    """Open shards by remaining capacity: a two-level balanced tree (leaves of at most 2 * WIDTH sorted entries under a
    sorted list of their largest), with best fit in O(log n)."""

    WIDTH = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def put(self, room: int, shard: int) -> None:
        entry = (room, shard)
        k = min(bisect_left(self.tops, entry), len(self.leaves) - 1)
        if k < 0:
            self.leaves, self.tops = [[entry]], [entry]
            return
        leaf = self.leaves[k]
        insort(leaf, entry)
        self.tops[k] = leaf[-1]
        if len(leaf) > 2 * self.WIDTH:
            self.leaves[k : k + 1] = [leaf[: self.WIDTH], leaf[self.WIDTH :]]
            self.tops[k : k + 1] = [leaf[self.WIDTH - 1], leaf[-1]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the tightest shard with at least `size` left."""
        k = bisect_left(self.tops, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return entry


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, limit: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """(size, shard, how many) runs in placing order and the number of shards, from (size, count) pairs. A group above the
    capacity gets a shard of its own. With `limit`, None if that many shards don't do."""
    tree, runs, shards = CapacityTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        while count:
            entry = tree.take(size)
            if entry is None:
                if shards == limit:
                    return None
                entry, shards = (max(capacity, size), shards), shards + 1
            room, shard = entry
            n = min(count, room // size)
            runs.append((size, shard, n))
            count -= n
            tree.put(room - n * size, shard)
    return runs, shards


def least_capacity(histogram: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int]], int]:
    """The runs under the smallest capacity (to 1/4096 of the mean) at which best-fit decreasing needs no more than `shards`."""
    total = sum(s * c for s, c in histogram)
    low = max(1, -(-total // shards))
    high = low
    while (found := best_fit_decreasing(histogram, high, shards)) is None:
        high += max(1, high // 64)
    step = max(1, low // 4096)
    while high - low > step:
        middle = (low + high) // 2
        got = best_fit_decreasing(histogram, middle, shards)
        low, high, found = (low, middle, got) if got else (middle, high, found)
    return found[0], high


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row. Either the number of shards is given, and the capacity is the
    least that does, or the capacity, and the shards are as few as best-fit decreasing makes them."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group")))
    whole = F.col("whole")
    shift = F.greatest(F.lit(0), F.length(F.bin(whole)) - 10)
    step = F.expr("shiftleft(1L, shift)")
    coarse = F.when(whole < EXACT, whole).otherwise(F.ceil(whole / step) * step).cast("long")
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("whole")).withColumn("shift", shift).withColumn("bin", coarse).select("group", "bin"))
    histogram = [(int(r[0]), int(r[1])) for r in groups.groupBy("bin").count().collect()]  # bounded, see above
    if not histogram:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    runs = least_capacity(histogram, shards)[0] if capacity is None else best_fit_decreasing(histogram, capacity)[0]
    counts, seen, plan = dict(histogram), {}, []
    base = {}
    at = 0
    for size in sorted(counts):
        base[size], at = at, at + counts[size]
    for size, shard, n in runs:
        b = base[size] + seen.get(size, 0)
        plan.append((size, shard, b, b + n))
        seen[size] = seen.get(size, 0) + n
    plan_df = F.broadcast(spark.createDataFrame(plan, "bin long, shard int, lo long, hi long"))
    ranked = global_rank(groups, ["bin", "group"])
    placed = ranked.join(plan_df, "bin").where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select("group", "shard")
    joined = rows.join(placed, "group").select("doc_id", "size", "text_crc32", "shard", order_id().alias("_o"))
    by_slot = global_rank(joined, ["shard", "_o", "size", "text_crc32"])
    starts, n = [], 0
    for shard, c in sorted((int(r[0]), int(r[1])) for r in by_slot.groupBy("shard").count().collect()) if capacity is None else []:
        starts.append((shard, n))
        n += c
    if capacity is None:
        first = F.broadcast(spark.createDataFrame(starts, "shard int, _first long"))
    else:
        first = by_slot.groupBy("shard").agg(F.min("pos").alias("_first"))
    return by_slot.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_first")).alias("slot"))
