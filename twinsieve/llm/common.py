"""What the operators of this subpackage share: reading tables, cutting lineage, row identity, ranks and token hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import connected_components
from ..session import checkpoint_folder, checkpointed

#: Bytes of text that the vectorised kernels take at a time; one longer document is taken alone.
SLICE_BYTES = 1 << 20
#: Null ids order after all others.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see."""
    return checkpoint_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there, so that neither lost executors nor later
    readers run the plan again."""
    return checkpointed(df)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b); label is the smallest node reachable."""
    return connected_components(links).withColumnRenamed("root", "label")


def order_id(column: Column | str = "doc_id") -> Column:
    """The id as a sort key that is never null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST_ID)).cast("long")


def global_rank(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Adds `pos`, the gapless place of each row in the order of `keys`, without gathering rows in one task: a range
    exchange, the place within the partition, and offsets from one count per partition. The result is a checkpoint."""
    n = partitions or max(1, min(2000, df.sparkSession.sparkContext.defaultParallelism * 4))
    placed = cut(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = sorted(placed.groupBy("_pid").count().collect())  # one row per partition, 2000 at most
    ends = np.cumsum([0] + [c for _, c in counts]).tolist()
    offsets = df.sparkSession.createDataFrame([(int(p), int(o)) for (p, _), o in zip(counts, ends)] or [(0, 0)], "_pid int, _off long")
    return placed.join(F.broadcast(offsets), "_pid").withColumn("pos", F.col("_at") + F.col("_off")).drop("_pid", "_at", "_off")


def with_row_ids(docs: DataFrame, name: str = "_ts_rid") -> DataFrame:
    """`docs` must be a scan or a checkpoint (see `settled`): its rows get the same ids each time it is read."""
    return docs.withColumn(name, F.monotonically_increasing_id())


_SETTLED = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter", "SubqueryAlias", "DataSourceV2Relation", "DataSourceV2ScanRelation"}


def settled(docs: DataFrame) -> DataFrame:
    """`docs` if it is a scan or a checkpoint, or rows and columns chosen from one; else its rows as a checkpoint."""
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in _SETTLED or not plan.deterministic():
            return cut(docs)
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return docs


#: Ids that are broadcast at most, 16 bytes each.
MAX_BROADCAST_IDS = 500_000


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` (settled) without the rows of the ids in `gone` (_ts_rid). Up to MAX_BROADCAST_IDS are broadcast; beyond, a Bloom
    filter of bounded size lets the rows that are surely not among them pass without an exchange."""
    from . import bloom

    gone = cut(gone)
    n = gone.count()
    rid = free_name(docs, "_ts_rid")
    gone, rows = gone.withColumnRenamed("_ts_rid", rid), with_row_ids(docs, rid)
    if n <= MAX_BROADCAST_IDS:
        return rows.join(F.broadcast(gone), rid, "left_anti").drop(rid)
    possible = bloom.membership(gone.select(F.xxhash64(rid).alias("h")), n)
    maybe = possible(F.xxhash64(rid))
    return rows.where(~maybe).unionByName(rows.where(maybe).join(gone, rid, "left_anti")).drop(rid)


#: Rows of a key up to which it never counts as hot.
LEAST_HOT = 100


def by_group(rows: DataFrame, groups: DataFrame, key: str | list[str], many: str, total: int | None = None) -> DataFrame:
    """`rows` left-joined with `groups`, a checkpoint with one row a key and the number of its rows in `many`.

    Groups of more than a thousandth of all rows, which are under a thousand, are broadcast to their rows, so that none meets
    in one task; the others meet by key. Both sides tell the two apart by a hash of the key against the list of hot ones, so
    no join over all rows is needed for it; a key that shares a hot one's hash is dealt as hot on both sides, which changes
    no result. `total` is the number of rows, where it is known. Rows without a key join nothing and stay where they are."""
    keys = [key] if isinstance(key, str) else key
    limit = max(LEAST_HOT, (rows.count() if total is None else total) // 1000)
    hashes = [r[0] for r in groups.where(F.col(many) > limit).select(F.xxhash64(*keys)).distinct().collect()]
    nameless = F.lit(False)
    for k in keys:
        nameless |= F.col(k).isNull()
    hot = F.xxhash64(*keys).isin(hashes)
    out = rows.where(~nameless & ~hot).join(groups.where(~hot), keys, "left")
    if hashes:
        out = out.unionByName(rows.where(~nameless & hot).join(F.broadcast(groups.where(hot)), keys, "left"))
    return out.unionByName(rows.where(nameless), allowMissingColumns=True)


#: Buckets of packed hashes to a shuffle partition at least, and bytes of the table to a bucket.
BUCKETS, BUCKET_BYTES = 4, 32 << 20


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, in the order of hashes."""
    return (h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def buckets_of(docs: DataFrame) -> int:
    """How many buckets of packed hashes a table needs, so that one of them fits in a task at any size of the table: by its
    bytes as the optimiser tells them, and at least BUCKETS to a shuffle partition."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(few, min(1 << 20, size // BUCKET_BYTES) if size < 1 << 60 else few)


# ---------------------------------------------------------------- texts as flat byte buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(17, (n - 1).bit_length())
            b, i = np.full(size, _BASE & _M, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            b[0] = i[0] = 1
            cls.up, cls.down = np.multiply.accumulate(b), np.multiply.accumulate(i)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most `limit` bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words `[^\\x20\\x09-\\x0D]+` of rows laid end to end, and where each row's words begin.

    A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, then mixed with its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


_STEP = [np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64)) for k in range(5)]


def shingles(h: np.ndarray, begins: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: sorted hashes row by row, and where each row's begin. A row with fewer than `width`
    words has its whole sequence as its only shingle; one without words has none."""
    n = len(begins) - 1
    counts = np.diff(begins)
    if len(h) >= width:
        s = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            s += h[k : len(h) - width + 1 + k] * _STEP[k]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(n, np.int64)
    for r in range(n):
        c = int(counts[r])
        if not c:
            continue
        b = int(begins[r])
        if c >= width:
            u = np.sort(s[b : b + c - width + 1])
            if len(u) > 1:
                u = u[np.concatenate(([True], u[1:] != u[:-1]))]
        else:
            u = mix((h[b : b + c] * np.array(_STEP[:c])).sum(keepdims=True) + np.uint64(c))
        sizes[r] = len(u)
        out.append(u)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def row_ids(n: int, state: dict) -> np.ndarray:
    """Ids that no other row of the job has: the partition's number and a running number."""
    at = state.setdefault("at", TaskContext.get().partitionId() << 33)
    state["at"] = at + n
    return np.arange(at, at + n, dtype=np.int64)


def blob(parts, kind=pa.binary()) -> pa.Array:
    """A binary column from arrays."""
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], kind)
