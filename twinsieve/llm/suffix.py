"""Operator 4: repeated passages by suffix arrays with threshold-bounded interval expansion.

A byte is removed when a string of `least` bytes that covers it also starts earlier (in a row with a smaller doc_id, or
earlier in the same row). Strings never cross rows, and are judged on the input.

Where to look: every `least`-byte window takes the smallest hash of its 20-byte strings as its key, so equal windows have
equal keys; neighbouring windows with one key make a segment of some 140 bytes. One pass counts the keys, which travel as
packed sorted arrays; a Bloom filter of bounded size holds those that occur twice. A second pass sends the segments with
such keys to the key's bucket, equal segments of a task once. There the segments that differ are laid end to end in the
order of their occurrence, and a suffix array and its Burrows-Wheeler transform are built. Strings that repeat are found
by breadth-first backward extension: the interval of a string c + w is cut where that of w was cut, level by level, so
common prefixes come out by increasing length, and expansion stops at `least`. What is left are the intervals of repeated
strings of that length; all but the earliest start of each are repeats. Later copies of an equal segment are repeats whole.

A key with more than HOT segments (a short common passage in many surroundings) is split by the text around it: its windows
add the smallest values of EXTRA other hashes to the key, which equal windows have in common too, and which mostly come from
the surroundings. What stays under one key is judged by one task. Buckets follow the size of the table. Equal segments are
told by a 64-bit digest; other comparisons are of bytes.

Null and short texts lose nothing. Repeated rows and ids: rows with one id come in the order of the table; null ids come
last. A row's result never depends on other columns. Empty tables give empty results. A text of any length is one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import LAST_ID, _BASE, _Powers, bucket_of, buckets_of, cut, flat, mix, order_id, settled, slices

GRAM = 20
#: Bytes that a task holds before it sends them, and bytes whose suffixes are sorted at a time.
HOLD, SORT = 6 << 20, 512 << 10
#: Bytes of text whose windows are hashed at a time (some thirty times as many bytes of arrays), and keys that are counted.
SLICE, KEYS = 128 << 10, 1 << 20
MAX_FILTER = 32 << 20
#: Segments from which a key is split, and how many smallest hashes then join it.
HOT, EXTRA = 4096, 3


def sliding(a: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minima (or maxima) of all runs of `width` neighbours."""
    size = 1
    while size * 2 <= width:
        a = of(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return of(a[:-rest], a[rest:]) if rest else a


def segments(data: np.ndarray, offsets: np.ndarray, least: int, hot=None):
    """(row, start in the row, windows, key, digest, start in data, whether a window may repeat within, key before splitting)
    of each segment of rows end to end; `hot` is a filter of the keys to split. Keys are scrambled, since minima crowd at the
    low end and buckets follow the order of keys. Equal windows of one segment have the key's string at two places, with no
    other key's between."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, none.astype(bool), none.view(np.uint64)
    up, down = _Powers.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    reach = least - GRAM + 1
    low = sliding(h, reach)
    pad = np.zeros(reach - 1, np.uint64)
    chosen = np.flatnonzero(h == sliding(np.concatenate((pad, low, pad)), reach, np.maximum))
    tied = h[chosen[1:]][(h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= reach)]
    plain = low
    if hot is not None:
        split = bloom.probe(hot, mix(low).view(np.int64))
        if split.any():
            low = low.copy()
            for k in range(1, EXTRA + 1):
                other = sliding(mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), reach)
                low[split] = mix(low[split] + other[split])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    good = np.arange(len(low)) + least <= offsets[row + 1]
    fresh = good.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~good[:-1]
    start = np.flatnonzero(fresh)
    stop = good.copy()
    stop[:-1] &= (low[1:] != low[:-1]) | ~good[1:]
    windows = np.flatnonzero(stop) + 1 - start
    digest = mix((sums[start + windows + least - 1] - sums[start]) * down[start] + windows.astype(np.uint64) * np.uint64(_BASE))
    inner = np.isin(plain[start], tied) if len(tied) else np.zeros(len(start), bool)
    return row[start], start - offsets[row[start]], windows, mix(low[start]), digest, start, inner, mix(plain[start])


def _key_counts(docs: DataFrame, n: int, least: int) -> DataFrame:
    """(h, hot) of keys that occur twice, and which of them more than about HOT times."""

    def count(batches):
        held, size = [], 0

        def send():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            q = (np.frexp(c.astype(np.float64))[1] - 1).astype(np.uint8)  # the count to a factor of two
            edges = np.searchsorted(bucket_of(u, n), np.arange(n + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(edges))
            cuts = [slice(edges[b], edges[b + 1]) for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (u, q)]], names=["bucket", "all", "counts"])

        for batch in batches:
            data, offsets = flat(batch["text"])
            for lo, hi in slices(offsets, SLICE):
                _, _, _, key, _, _, inner, _ = segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)
                held += [key, key[inner]]  # a key that may repeat within a segment counts as two
                size += len(key)
                if size > KEYS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def twice(batches):
        at, held, counts = None, [], []

        def send():
            u, back = np.unique(np.concatenate(held), return_inverse=True)
            total = np.bincount(back, 2.0 ** np.concatenate(counts), len(u))
            return pa.RecordBatch.from_arrays([pa.array(u[total > 1].view(np.int64)), pa.array(total[total > 1] > HOT)], names=["h", "hot"])

        for batch in batches:
            for bucket, every, q in zip(batch["bucket"].to_pylist(), batch["all"], batch["counts"]):
                if bucket != at and held:
                    yield send()
                    held, counts = [], []
                at = bucket
                held.append(np.frombuffer(every.as_buffer(), np.uint64))
                counts.append(np.frombuffer(q.as_buffer(), np.uint8))
        if held:
            yield send()

    packed = docs.select("text").mapInArrow(count, "bucket int, all binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(twice, "h long, hot boolean")


def suffix_array(text: np.ndarray, least: int) -> np.ndarray:
    """Places in the order of their suffixes as far as the first `least` bytes tell, or more; four bytes a place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : n + k]
    width = 8
    while True:
        order = np.argsort(key).astype(np.int32)
        k = key[order]
        new = np.concatenate(([False], k[1:] != k[:-1]))
        del k
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        if width >= least or rank[order[-1]] == n - 1:
            return order
        del order, new
        key = rank.astype(np.uint64)
        key *= np.uint64(n + 1)
        key[: max(n - width, 0)] += rank[width:].astype(np.uint64) + np.uint64(1)
        width *= 2


def repeated(text: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Which of the window starts have an equal window at an earlier one."""
    text = np.append(text, np.uint8(0))  # no window holds the last place
    n = len(text)
    order = suffix_array(text, least)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    first = text[order]
    # the suffix after each one's first byte: from an interval of w at these places extend the intervals of c + w
    after = place[np.minimum(order + 1, n - 1)]
    bounds = np.ones(n, bool)
    bounds[1:] = first[1:] != first[:-1]
    ended = order == n - 1
    bounds |= ended
    bounds[1:] |= ended[:-1]
    del order, first, ended
    active = np.flatnonzero(~bounds).astype(np.int32)
    left, right = after[active - 1], after[active]
    del after
    for _ in range(1, least):
        interval = np.cumsum(bounds, dtype=np.int32)
        cut_here = interval[left] != interval[right]
        if cut_here.any():
            bounds[active[cut_here]] = True
            keep = ~cut_here
            active, left, right = active[keep], left[keep], right[keep]
        if not len(active):
            break
    interval = np.cumsum(bounds, dtype=np.int32)[place[starts]]
    by = np.argsort(interval, kind="stable")
    out = np.zeros(len(starts), bool)
    out[by[1:]] = interval[by[1:]] == interval[by[:-1]]
    return out


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of flags within a group."""
    a, b = flags.copy(), flags.copy()
    a[1:] &= ~flags[:-1] | (group[1:] != group[:-1])
    b[:-1] &= ~flags[1:] | (group[1:] != group[:-1])
    return np.flatnonzero(a), np.flatnonzero(b) + 1


def _send_segments(docs: DataFrame, n: int, least: int, sieve, hot) -> DataFrame:
    schema = "bucket int, seg binary, bytes binary, occ binary"

    def send(held):
        key, digest, windows, oid, rid, start = (np.concatenate([h[k] for h in held]) for k in range(6))
        at = np.concatenate([h[6] + base for h, base in zip(held, np.cumsum([0] + [len(h[7]) for h in held]))])
        data = np.concatenate([h[7] for h in held])
        order = np.lexsort((start, rid, oid, digest, key))
        key, digest, windows, oid, rid, start, at = (x[order] for x in (key, digest, windows, oid, rid, start, at))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
        first = np.flatnonzero(new)
        seg = np.stack((key[first], digest[first], windows[first].astype(np.uint64), np.diff(np.append(first, len(key))).astype(np.uint64)), 1)
        occ = np.stack((oid, rid, start), 1)
        edges = np.searchsorted(bucket_of(seg[:, 0], n), np.arange(n + 1).astype(np.uint64))
        size = windows[first] // 2 + least - 1
        rows = [[], [], [], []]
        ends = np.append(first, len(key))
        for b in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[b], edges[b + 1]
            total = size[lo:hi]
            take = np.repeat(at[first[lo:hi]] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
            for column, value in zip(rows, (int(b), seg[lo:hi].tobytes(), data[take].tobytes(), occ[ends[lo] : ends[hi]].tobytes())):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["bucket", "seg", "bytes", "occ"])

    def cut_out(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = flat(batch["text"])
            oid, rid = batch["_oid"].to_numpy(), batch["_rid"].to_numpy()
            for lo, hi in slices(offsets, SLICE):
                part = data[offsets[lo] : offsets[hi]]
                row, start, windows, key, digest, at, inner, plain = segments(part, offsets[lo : hi + 1] - offsets[lo], least, hot.value)
                hit = np.flatnonzero(bloom.probe(sieve.value, plain.view(np.int64))) if len(key) else np.zeros(0, np.int64)
                if len(hit):
                    length = windows[hit] + least - 1
                    base = np.concatenate(([0], np.cumsum(length)[:-1]))
                    own = part[np.repeat(at[hit] - base, length) + np.arange(length.sum())]
                    held.append((key[hit], digest[hit], windows[hit] * 2 + inner[hit], oid[lo + row[hit]], rid[lo + row[hit]], start[hit], base, own))
                    size += len(own)
                if size > HOLD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return docs.select("_rid", "_oid", "text").mapInArrow(cut_out, schema)


def _judge(rows: list, least: int):
    """(rid, start, end) of what is repeated, of one bucket's segments."""
    seg = np.concatenate([np.frombuffer(r[0], np.uint64).reshape(-1, 4) for r in rows])
    occ = np.concatenate([np.frombuffer(r[2], np.int64).reshape(-1, 3) for r in rows])
    data = np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows])
    size = (seg[:, 2] // np.uint64(2)).astype(np.int64) + least - 1
    at = np.cumsum(size) - size
    many = seg[:, 3].astype(np.int64)
    owner = np.repeat(np.arange(len(seg)), many)
    order = np.lexsort((occ[:, 2], occ[:, 1], occ[:, 0], seg[owner, 1], seg[owner, 0]))
    occ, owner = occ[order], owner[order]
    key, digest = seg[owner, 0], seg[owner, 1]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
    later = np.flatnonzero(~new)
    out = [(occ[later, 1], occ[later, 2], occ[later, 2] + size[owner[later]])]
    first = np.flatnonzero(new)
    keys, where, count = np.unique(key[first], return_inverse=True, return_counts=True)
    inner = np.bincount(where, seg[owner[first], 2] % np.uint64(2)) > 0
    first = first[((count > 1) | inner)[where]]
    if len(first):
        # keys stay whole; within one, segments stand in the order of their occurrence
        first = first[np.lexsort((occ[first, 2], occ[first, 1], occ[first, 0], key[first]))]
        ends = np.cumsum(size[owner[first]])
        starts_of_keys = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
        stops = np.append(starts_of_keys[1:], len(first))
        lo = 0
        while lo < len(starts_of_keys):
            begin = starts_of_keys[lo]
            base = ends[begin - 1] if begin else 0
            hi = max(lo + 1, int(np.searchsorted(ends[stops - 1], base + SORT, "right")))
            part = first[begin : stops[hi - 1]]
            own = owner[part]
            length = size[own]
            place = np.cumsum(length) - length
            text = data[np.repeat(at[own] - place, length) + np.arange(length.sum())]
            windows = length - least + 1
            of = np.repeat(np.arange(len(part)), windows)
            inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            flags = repeated(text, place[of] + inner, least)
            a, b = _runs(flags, of)
            out.append((occ[part[of[a]], 1], occ[part[of[a]], 2] + inner[a], occ[part[of[a]], 2] + inner[b - 1] + least))
            lo = hi
    return [np.concatenate([o[k] for o in out]) for k in range(3)]


def spans(docs: DataFrame, least: int = 100) -> DataFrame:
    """(_rid, s, e): repeated stretches of bytes, overlapping ones too; `docs` has _rid, _oid and text."""
    spark = docs.sparkSession
    n = buckets_of(docs)
    keys = cut(_key_counts(docs, n, least))
    sieve = spark.sparkContext.broadcast(bloom.build(keys, "h", keys.count(), MAX_FILTER))
    hot = keys.where("hot")
    many = hot.count()
    hot = spark.sparkContext.broadcast(bloom.build(hot, "h", many, MAX_FILTER) if many else None)

    def judge(batches):
        at, rows = None, []
        for batch in batches:
            for bucket, *row in zip(batch["bucket"].to_pylist(), batch["seg"], batch["bytes"], batch["occ"]):
                if bucket != at and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _judge(rows, least)], names=["_rid", "s", "e"])
                    rows = []
                at = bucket
                rows.append([x.as_buffer() for x in row])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _judge(rows, least)], names=["_rid", "s", "e"])

    sent = _send_segments(docs, n, least, sieve, hot)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, "_rid long, s long, e long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by stretches."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], reach[last]


def remove_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the text that is left) for each row; `least` is more than
    GRAM, else there is a ValueError."""
    if least <= GRAM:
        raise ValueError(f"least is {least}, but repeats are found by strings of {GRAM} bytes and must be longer")
    own = settled(docs).select(F.monotonically_increasing_id().alias("_rid"), order_id().alias("_oid"), "text")
    found = cut(spans(own, least).groupBy("_rid").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e")))

    def clean(batches):
        for batch in batches:
            rows = []
            for text, s, e in zip(batch["text"].cast(pa.binary()), batch["s"], batch["e"]):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                removed, count, left = 0, 0, raw
                if s.is_valid and len(s):
                    a, b = merged(s.values.to_numpy(), e.values.to_numpy())
                    removed, count = int((b - a).sum()), len(a)
                    left = b"".join(raw[x:y] for x, y in zip(np.append(0, b), np.append(a, len(raw))))
                rows.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([batch["_oid"], *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=["_oid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # rows that surely have no repeats, by a Bloom filter, stay where they are
    maybe = bloom.membership(found.select(F.xxhash64("_rid").alias("h")), found.count())(F.xxhash64("_rid"))
    no_spans = F.lit(None).cast("array<long>")
    joined = own.where(maybe).join(found, "_rid", "left").select("_oid", "text", "s", "e").unionByName(own.where(~maybe).select("_oid", "text", no_spans.alias("s"), no_spans.alias("e")))
    out = joined.mapInArrow(clean, "_oid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.when(F.col("_oid") != LAST_ID, F.col("_oid")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
