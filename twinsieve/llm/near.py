"""Operator 3: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is that of its distinct five-word shingles. Its signature has 40 symbols of 16 bits, each cut from one
minimum; the distance of two signatures is the number of symbols that differ. Signatures are split into ten chunks of
four symbols. Within 19 differing symbols some chunk has at most one (pigeonhole), so enumerating the four ways to leave
out one symbol of each chunk finds every pair within that distance; pairs at a Jaccard similarity of 0.75 differ in ten
symbols on average, and one misses all 40 keys with a chance of 1.5e-6. Links are confirmed on the full sets.

Equal sets are one class from the start. Under a key all classes are first compared with its hub only, the member whose
keys hold the most, which for altered copies of one text is the text itself. Keys whose members have come together by
then are done. The members of the others are gathered by hub and by size (a link's sizes differ by at most 4/3). There
signatures are compared first, in pairs of blocks of about SCREEN members: only members with a signature within the
distance in another component go on. These are compared in full, in pairs of blocks of about BLOCK members or
BLOCK_SHINGLES shingles, by exact intersections, of which only links come out, one for each two components. Nothing is
capped, and no pair is a row. Keys and groups of many rows are broadcast to them or dealt in blocks, so none meets in one task.

Sets are compared as 64-bit hashes of shingles: two different shingles of one pair of texts are taken for equal with a
chance of under 2^-64 a pair of shingles.

Null and blank texts have no shingles, link with nothing and are kept. Repeated rows and ids: rows are told apart by
their place; a component's id is its smallest doc_id. Null ids come last (component null if there is no other). Empty
tables give empty results; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, compact, release
from . import bloom
from .common import LAST_ID, by_group, components, flat, mix, order_id, settled, shingles, slices, with_row_ids, without_rows, words

SYMBOLS, CHUNK = 40, 4
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Differing symbols (told by four bits each) beyond which a star's pair is not compared; it may still be in the blocks.
FAR = 23
#: Members of a block of the comparison of signatures; members and shingles of one of the final comparison, and columns of
#: it multiplied out at a time.
SCREEN, BLOCK, BLOCK_SHINGLES, WIDE = 4096, 512, 1 << 18, 4096


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint from which no row ids are drawn."""
    return compact(checkpointed(df))


def sketch(batches):
    """Per row: number of shingles, a 128-bit digest of the set, the signature."""
    for batch in batches:
        data, offsets = flat(batch["text"])
        n = batch.num_rows
        sizes, digest, sig = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, SYMBOLS), np.uint16)
        for lo, hi in slices(offsets):
            h, begins = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            s, at = shingles(h, begins)
            own = np.flatnonzero(np.diff(at)) + lo
            sizes[lo:hi] = np.diff(at)
            if len(s):
                first = at[:-1][np.diff(at) > 0]
                digest[own, 0] = np.add.reduceat(mix(s), first)
                digest[own, 1] = np.add.reduceat(mix(s ^ np.uint64(0x5DEECE66D1234567)), first)
                for j, factor in enumerate(_FACTORS):
                    sig[own, j] = mix(np.minimum.reduceat(s * factor, first)).astype(np.uint16)
        empty = sizes == 0
        raw_digest, raw_sig = digest.tobytes(), sig.tobytes()
        w = 2 * SYMBOLS
        yield pa.RecordBatch.from_arrays(
            [batch["_ts_rid"], batch["_oid"], pa.array(sizes), pa.array([None if e else raw_digest[16 * i : 16 * i + 16] for i, e in enumerate(empty)], pa.binary()), pa.array([None if e else raw_sig[w * i : w * i + w] for i, e in enumerate(empty)], pa.binary())],
            names=["_ts_rid", "_oid", "n", "sid", "sig"],
        )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return flat(column)[0].view(np.uint16).reshape(-1, width)


def index_keys(batches):
    """Every signature under each of its chunks with one symbol left out."""
    for batch in batches:
        sig, node = _matrix(batch["sig"], SYMBOLS).astype(np.uint64), batch["node"].to_numpy()
        for lo in range(0, len(node), 20_000):
            part, keys = sig[lo : lo + 20_000], []
            for c in range(SYMBOLS // CHUNK):
                for out in range(CHUNK):
                    key = np.full(len(part), c * CHUNK + out + 1, np.uint64)
                    for k in range(CHUNK):
                        if k != out:
                            key = key << np.uint64(16) | part[:, c * CHUNK + k]
                    keys.append(mix(key).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(node[lo : lo + 20_000], SYMBOLS))], names=["key", "node"])


def packed(batches):
    """The signature's symbols by four bits each, in three longs."""
    for batch in batches:
        low = (_matrix(batch["sig"], SYMBOLS) & np.uint16(15)).astype(np.uint64)
        longs = []
        for at in range(0, SYMBOLS, 16):
            x = np.zeros(len(low), np.uint64)
            for k in range(at, min(at + 16, SYMBOLS)):
                x = x << np.uint64(4) | low[:, k]
            longs.append(pa.array(x.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], *longs], names=["node", "n", "s0", "s1", "s2"])


def _set_of(batches):
    for batch in batches:
        data, offsets = flat(batch["text"])
        sets = []
        for lo, hi in slices(offsets):
            s, at = shingles(*words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            sets += [s[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])


def confirm(batches):
    """The pairs with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(q) < len(p):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            common = int(np.count_nonzero(q[at] == p))
            keep.append(100 * common >= 75 * (len(p) + len(q) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def across(table: pa.Table) -> pa.Table:
    """Links between the components that meet in a pair of blocks, one for each two components, by exact intersections.

    Only shingles of two members or more count; their incidence is multiplied out some thousand columns at a time."""
    label = table["label"].to_numpy()
    a, b = [], []
    if len(np.unique(label)) > 1:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        n = np.array([len(x) for x in sets])
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = df[column] > 1
        renumbered = np.cumsum(df > 1) - 1
        row, column = row[shared], renumbered[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
            at, to = np.searchsorted(column, (lo, lo + WIDE))
            m = np.zeros((len(sets), WIDE), np.float32)
            m[row[at:to], column[at:to] - lo] = 1
            common += m @ m.T
        linked = (100 * common.astype(np.int64) >= 75 * (n[:, None] + n[None] - common.astype(np.int64))) & (label[:, None] < label[None])
        x, y = np.nonzero(linked)
        _, first = np.unique(np.stack((label[x], label[y])), axis=1, return_index=True)
        node = table["node"].to_numpy()
        a, b = node[x[first]], node[y[first]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def screen(table: pa.Table) -> pa.Table:
    """The members of a pair of blocks with a signature within the distance, and of a fitting size, in another component."""
    label, n = table["label"].to_numpy(), table["n"].to_numpy()
    longs = [table[c].to_numpy().view(np.uint64) for c in ("s0", "s1", "s2")]
    hit = np.zeros(len(n), bool)
    ones = np.uint64(0x1111111111111111)
    for lo in range(0, len(n), 256):
        part = slice(lo, lo + 256)
        far = np.zeros((len(n[part]), len(n)), np.uint8)
        for s in longs:
            d = s[part, None] ^ s[None]
            d |= d >> np.uint64(2)
            d |= d >> np.uint64(1)
            far += np.bitwise_count(d & ones)
        m = n[part, None]
        hit[part] = ((far <= FAR) & (label[part, None] != label[None]) & (np.minimum(m, n[None]) * 100 >= np.maximum(m, n[None]) * 75)).any(1)
    return pa.table({c: table[c].filter(pa.array(hit)) for c in ("hub", "band", "node")})


def _near(x: str, y: str) -> F.Column:
    """Sizes and signatures that a link could have."""
    def differing(s: str):
        d = F.expr(f"{x}.{s} ^ {y}.{s}")
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 75) & (differing("s0") + differing("s1") + differing("s2") <= FAR)


def _dealt(members: DataFrame, blocks: F.Column) -> DataFrame:
    """The members of each (hub, band) in pairs (i, j) of blocks; those of one (hub, band) only meet by pair."""
    sizes = cut(members.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("label").alias("l0"), F.max("label").alias("l1")).withColumn("blocks", blocks.cast("int")))
    placed = by_group(members, sizes, ["hub", "band"], "size").where("l0 <> l1")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("mine", mine).withColumn("other", other).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).select(*members.columns, "i", "j")


def _rest(held: DataFrame, label: DataFrame, info: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that have met under a key; `held` has key, node and the key's hub."""
    labelled = held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = cut(labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("many")))
    apart = by_group(labelled, spread, "key", "many").where("l0 <> l1")
    members = apart.select("hub", "node", "label").distinct().join(info, "node")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(4 / 3))).cast("int")
    members = cut(members.withColumn("band", F.explode(F.array(band, band + 1))))
    if not members.limit(1).count():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    near = _dealt(members, F.ceil(F.col("size") / SCREEN)).groupBy("hub", "band", "i", "j").applyInArrow(screen, "hub long, band int, node long")
    members = cut(members.join(near.distinct(), ["hub", "band", "node"]).select("hub", "band", "node", "label", "n"))
    if not members.limit(1).count():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    return _dealt(members, blocks).join(sets, "node").groupBy("hub", "band", "i", "j").applyInArrow(across, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """_ts_rid, _oid, n_shingles, _component (smallest id), _label (of the component), kept for each row of `docs`, a scan or a
    checkpoint."""
    own = with_row_ids(docs).select("_ts_rid", order_id().alias("_oid"), "text")
    rows = cut(own.mapInArrow(sketch, "_ts_rid long, _oid long, n long, sid binary, sig binary"))
    classes = cut(
        rows.where(F.col("sid").isNotNull()).groupBy("sid", "n", "sig").agg(F.min("_oid").alias("mid"), F.min("_ts_rid").alias("_ts_rid"), F.count(F.lit(1)).alias("rows"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    many_classes = classes.count()
    keys = classes.where("n > 2").select("node", "sig").mapInArrow(index_keys, "key long, node long")
    counts = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    live = cut(by_group(keys, counts, "key", "many", SYMBOLS * many_classes).where("many is not null"))
    weight = live.groupBy("node").agg(F.sum("many").alias("w"))
    release(counts)
    weight = cut(weight.select("node", F.shiftleft("w", 24).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit(0xFFFFFF))).alias("weight")))
    n = weight.count()
    label = None
    if n:
        own_nodes = classes.join(weight.select("node"), "node", "left_semi")
        info = cut(own_nodes.select("node", "n", "sig").mapInArrow(packed, "node long, n long, s0 long, s1 long, s2 long"))
        places = own_nodes.select("_ts_rid", "node")
        possible = bloom.membership(places.select(F.xxhash64("_ts_rid").alias("h")), n)
        sets = cut(own.where(possible(F.xxhash64("_ts_rid"))).select("_ts_rid", "text").join(places, "_ts_rid").select("node", "text").mapInArrow(_set_of, "node long, shingles binary"))
        top = live.join(weight, "node").groupBy("key").agg(F.max("weight").alias("weight"), F.max("many").alias("many"))
        top = cut(top.join(weight.groupBy("weight").agg(F.min("node").alias("hub")), "weight").select("key", "hub", "many"))
        held = cut(by_group(live.select("key", "node"), top, "key", "many").select("key", "node", "hub"))
        release(live), release(top)
        pairs = held.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        x, y = info.alias("x"), info.alias("y")
        stars = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_near("x", "y")).select("a", "b")
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        label = cut(components(stars.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")))
        more = cut(_rest(held, label, info, sets))
        if more.limit(1).count():
            label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.select("sid", "node", "mid", "rows")
    named = named.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")) if label is not None else named.withColumn("label", F.col("node"))
    named = cut(named)
    least = cut(named.groupBy("label").agg(F.min("mid").alias("_component"), F.count(F.lit(1)).alias("many")))
    by_set = cut(by_group(named, least, "label", "many").select("sid", "_component", "label", "rows"))
    full = by_group(rows, by_set, "sid", "rows").select("_ts_rid", "_oid", F.col("n").alias("n_shingles"), F.coalesce("_component", "_oid").alias("_component"), F.coalesce("label", -1 - F.col("_ts_rid")).alias("_label"))
    return full.withColumn("kept", F.col("_oid") == F.col("_component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    out = near_groups(settled(docs))
    return out.select(F.when(F.col("_oid") != LAST_ID, F.col("_oid")).alias("doc_id"), "n_shingles", F.when(F.col("_component") != LAST_ID, F.col("_component")).alias("component_id"), "kept")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns; of repeated rows with that id the first. Rows are told apart by their
    place, so `docs` that isn't a scan or a checkpoint is made one."""
    docs = settled(docs)
    out = cut(near_groups(docs))
    stay = out.where("kept").groupBy("_label").agg(F.min("_ts_rid").alias("_ts_rid")).select("_ts_rid")
    return without_rows(docs, out.select("_ts_rid").join(stay, "_ts_rid", "left_anti"))
