"""Exact Hamming joins on 64-bit fingerprints (JN-01 to JN-08, SRT-01, SRT-02, SRT-07, SET-01, SET-07).

Recall is 1 under every strategy. Equal fingerprints are folded before the join, so a fingerprint shared by a third of all
rows is one row of it; rows come back only in the final expansion, which may be left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.hashes import ASPECTS, best_full, best_variant, distance, masks16, percent_of, similarity, slice16

#: Distinct fingerprints up to which comparing all with all is cheapest, instead of bands and instead of slices: 4e8 and
#: 3.6e9 comparisons of two words on all cores against 9 and 548 keys a row that are exchanged.
THETA_ROWS, THETA_ROWS_SLICES = 20_000, 60_000
#: The largest distances of the bands (D + 1 bands of 7 bits at least) and of the slices: among 11 differing bits one of four
#: slices has two at most. Beyond that every partition of 64 bits makes a large share of all pairs candidates (at 16: a
#: quarter for six parts with two errors each, more for others), so a linear scan over the distinct fingerprints is cheaper.
MAX_BANDS, MAX_SLICES = 8, 11
#: The largest distance at which a key is two of D + 2 bands instead of one of D + 1: 21 keys a row instead of 6 then, but of
#: so many more bits that candidates are a fraction, however unevenly the bits are set.
MAX_TWO_BANDS = 5


def band_keys(h: Column, bands: int) -> Column:
    """The fingerprint's bits in so many disjoint bands, each tagged with its number: D differing bits leave one of D + 1 bands equal."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    parts = [F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(k).alias("band"), p.alias("bits")) for k, p in enumerate(parts)])


def first_equal_band(x: Column, y: Column, bands: int) -> Column:
    """The number of the first band in which two fingerprints agree: their pair is kept under that band alone, so no distinct is needed."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    d = x.bitwiseXOR(y)
    equal = [F.shiftrightunsigned(d, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)) == 0 for lo, hi in zip(edges, edges[1:])]
    out = F.when(equal[0], 0)
    for k, e in enumerate(equal[1:], 1):
        out = out.when(e, k)
    return out


def _two_bands(bands: int) -> list[int]:
    """The bits of each two of so many disjoint bands, as signed masks: D differing bits leave two of D + 2 bands equal."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in two) for two in combinations(range(bands), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _mask_keys(h: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("band"), h.bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])


def _first_equal_mask(x: Column, y: Column, masks: list[int]) -> Column:
    """The number of the first mask under which two fingerprints agree."""
    d = x.bitwiseXOR(y)
    out = F.when(d.bitwiseAND(F.lit(masks[0])) == 0, 0)
    for k, m in enumerate(masks[1:], 1):
        out = out.when(d.bitwiseAND(F.lit(m)) == 0, k)
    return out


def _slices(h: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("part"), slice16(h, k).alias("bits")) for k in range(4)])


def _masks(radius: int) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in masks16(radius)]))


def first_near_slice(x: Column, y: Column, radius: int) -> Column:
    """The number of the first 16-bit slice in which two fingerprints differ in so many bits at most."""
    d = x.bitwiseXOR(y)
    out = F.when(F.bit_count(slice16(d, 0)) <= radius, 0)
    for k in range(1, 4):
        out = out.when(F.bit_count(slice16(d, k)) <= radius, k)
    return out


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """By keys to so many partitions that are not joined into fewer: few bytes, many comparisons."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _near_rows(left: DataFrame, right: DataFrame, max_distance: int, strategy: str) -> DataFrame:
    """The columns of both sides, and the distance, for each row of `left` (x, others) and of `right` (y, others) within it."""
    near, columns = distance("x", "y") <= max_distance, [*left.columns, *right.columns]
    out = lambda found: found.select(*columns, distance("x", "y").alias("distance"))
    if max_distance == 0:
        return out(left.join(right, F.col("x") == F.col("y")))
    if strategy == "theta" or max_distance > MAX_SLICES:
        return out(left.repartition(left.sparkSession.sparkContext.defaultParallelism, "x").join(right, near))
    if strategy == "bands" and max_distance <= MAX_TWO_BANDS:
        masks = _two_bands(max_distance + 2)
        a, b = left.select("*", F.inline(_mask_keys(F.col("x"), masks))), right.select("*", F.inline(_mask_keys(F.col("y"), masks)))
        return out(_dealt(a, "band", "bits").join(_dealt(b, "band", "bits"), ["band", "bits"]).where(near & (F.col("band") == _first_equal_mask(F.col("x"), F.col("y"), masks))))
    if strategy == "bands" and max_distance <= MAX_BANDS:
        # from bands of nine bits and fewer a key has a large share of all rows: each key's left rows are then dealt to several tasks
        n, salts = max_distance + 1, 8 if max_distance >= 6 else 1
        a = left.select("*", F.inline(band_keys(F.col("x"), n)), F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int").alias("salt"))
        b = right.select("*", F.inline(band_keys(F.col("y"), n))).select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        keys = ["band", "bits", "salt"]
        return out(_dealt(a, *keys).join(_dealt(b, *keys), keys).where(near & (F.col("band") == first_equal_band(F.col("x"), F.col("y"), n))))
    # among D differing bits one of four slices has D // 4 at most; the asking side enumerates its neighbours within those,
    # and a pair is kept under the first such slice alone
    radius = max_distance // 4
    a = left.select("*", F.inline(_slices("x"))).withColumn("mask", _masks(radius)).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask")))
    b = right.select("*", F.inline(_slices("y")))
    return out(_dealt(a, "part", "bits").join(_dealt(b, "part", "bits"), ["part", "bits"]).where(near & (F.col("part") == first_near_slice(F.col("x"), F.col("y"), radius))))


#: Rows of a fingerprint to a chunk at most, and parts of it that are gathered apart.
CHUNK, PARTS = 64, 16


def _chunks(rows: DataFrame, h: str, name: str) -> DataFrame:
    """(h, array of the other columns as structs): equal fingerprints as one row, or as several of CHUNK rows each."""
    others = F.struct(*[c for c in rows.columns if c != "h"])
    held = rows.groupBy(F.col("h").alias(h), F.pmod(F.xxhash64(others), F.lit(PARTS))).agg(F.collect_list(others).alias("all"))
    return held.select(h, F.explode(F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(CHUNK)), lambda k: F.slice("all", k, CHUNK))).alias(name))


def _once(rows: DataFrame, key: str) -> bool:
    """Whether no key has two rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _chosen(df: DataFrame, max_distance: int, strategy: str) -> str:
    if strategy != "auto":
        return strategy
    most = THETA_ROWS if max_distance <= MAX_BANDS else THETA_ROWS_SLICES
    if max_distance > MAX_SLICES or df.limit(most + 1).count() <= most:
        return "theta"
    return "bands" if max_distance <= MAX_BANDS else "slices"


#: Rows of a block at most; rows of a block below which there is no use in more of them; rows on both sides of one comparison
#: of arrays (16 on the left at most, see the order of pairs); pairs from which on a batch of them is sent.
BLOCK, LEAST_BLOCK, STEP, BATCH = 1 << 18, 1 << 12, (16, 1 << 13), 1 << 16


def _compared(rows: DataFrame, max_distance: int) -> DataFrame:
    """(left_id, right_id, distance) for each two rows (id, h) of different ids within the distance; ids are integers.

    Rows are dealt to blocks by a hash, and each pair of blocks is one task's to compare: a row is exchanged once for each
    block, whatever the distance, and pairs are made in the last step. A core has several pairs of blocks.

    Rows are in the order of their fingerprints, and a step's pairs in that of the side of their left row, their row and their
    distance: one of the two ids and the distance stand still for many pairs, which files of pairs store in less."""
    n, cores, kind = rows.count(), rows.sparkSession.sparkContext.defaultParallelism, rows.schema["id"].dataType.simpleString()
    blocks = max(1, -(-n // BLOCK), min(isqrt(32 * cores), -(-n // LEAST_BLOCK)))
    dealt = rows.select("id", "h", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("id", "h", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        ids, h, mine = t["id"].to_numpy(), t["h"].to_numpy().view(np.uint64), t["mine"].to_numpy()
        order = np.argsort(h)
        ids, h, mine = ids[order], h[order], mine[order]
        (xs, x), (ys, y) = ((ids[mine == k], h[mine == k]) for k in (i, j))
        held, many = [], 0
        for s in range(0, len(x), STEP[0]):
            for k in range(s if i == j else 0, len(y), STEP[1]):
                d = np.bitwise_count(x[s : s + STEP[0], None] ^ y[None, k : k + STEP[1]])
                at = np.flatnonzero(d <= max_distance)
                p, q = np.divmod(at.astype(np.uint32), np.uint32(d.shape[1]))
                a, b = xs[s + p], ys[k + q]
                kept = (a != b) & (s + p < k + q) if i == j else a != b
                if not kept.all():
                    at, a, b = at[kept], a[kept], b[kept]
                p, d = p[kept], d.ravel()[at]
                o = np.argsort((a > b).astype(np.uint16) << 11 | p.astype(np.uint16) << 7 | d, kind="stable")
                a, b, d = a[o], b[o], d[o]
                held.append((np.minimum(a, b), np.maximum(a, b), d.astype(np.int32)))
                many += len(at)
                if many >= BATCH:
                    yield pa.record_batch([np.concatenate(c) for c in zip(*held)], ["left_id", "right_id", "distance"])
                    held, many = [], 0
        if many:
            yield pa.record_batch([np.concatenate(c) for c in zip(*held)], ["left_id", "right_id", "distance"])

    return _dealt(dealt, "i", "j").groupBy("i", "j").applyInArrow(near, f"left_id {kind}, right_id {kind}, distance int")


def hamming_pairs(rows: DataFrame, max_distance: int, strategy: str = "auto") -> DataFrame:
    """JN-01: (left_id, right_id, distance) with left_id < right_id for all pairs of (id, h) within the distance, once per pair
    of ids even where an id has several fingerprints (the smallest distance then). Null fingerprints pair with nothing.

    Other columns of the rows come along as left_* and right_*, if no id has several rows; else they are left out. The rows of
    a fingerprint travel in chunks with it, so pairs are made in the last step and never exchanged, unless ids repeat.

    Beyond MAX_BANDS, where slices cost 548 keys a row and every way leaves a large share of all pairs of texts to compare,
    all rows are compared with all in arrays, unless another strategy is named or other columns come along."""
    rows = rows.where(F.col("h").isNotNull() & F.col("id").isNotNull())
    once = _once(rows, "id")
    others = [c for c in rows.columns if c not in ("id", "h")] if once else []
    rows = rows.select("id", "h", *others)
    if strategy == "auto" and max_distance > MAX_BANDS and not others and isinstance(rows.schema["id"].dataType, IntegralType):
        found = _compared(rows.select("id", F.col("h").cast("long").alias("h")), max_distance)
        return found if once else found.groupBy("left_id", "right_id").agg(F.min("distance").alias("distance"))
    found = _near_rows(_chunks(rows, "x", "xs"), _chunks(rows, "y", "ys"), max_distance, _chosen(rows.select("h").distinct(), max_distance, strategy)).where("x <= y")
    pairs = found.select("x", "y", "distance", F.explode("xs").alias("i"), "ys").select("x", "y", "distance", "i", F.explode("ys").alias("j")).where("i.id <> j.id and (x <> y or i.id < j.id)")
    left, right = F.least("i.id", "j.id").alias("left_id"), F.greatest("i.id", "j.id").alias("right_id")
    if not once:
        return pairs.groupBy(left, right).agg(F.min("distance").alias("distance"))
    ahead = F.col("i.id") < F.col("j.id")
    sides = [F.when(ahead == first, F.col(f"i.{c}")).otherwise(F.col(f"j.{c}")).alias(f"{side}_{c}") for side, first in (("left", True), ("right", False)) for c in others]
    return pairs.select(left, right, "distance", *sides)


def arrivals_in_chunks(batch: DataFrame, history: DataFrame, max_distance: int) -> DataFrame:
    """JN-06: (distance, xs, ys, same) of a batch (id, h) against the history and within itself: arrays of the ids of two
    fingerprints, which are the same or not. No id has several rows in the batch or in the history. `expanded` has the pairs."""
    rows = batch.where(F.col("h").isNotNull() & F.col("id").isNotNull()).select("id", "h")
    known = history.where(F.col("h").isNotNull() & F.col("id").isNotNull()).select("id", "h").join(rows.select("id"), "id", "left_anti")
    own = _near_rows(_chunks(rows, "x", "xs"), _chunks(rows, "y", "ys"), max_distance, _chosen(rows.select("h").distinct(), max_distance, "auto")).where("x <= y")
    old = _near_rows(_chunks(rows, "x", "xs"), _chunks(known, "y", "ys"), max_distance, _chosen(known.select("h").distinct(), max_distance, "auto"))
    made = lambda found, same: found.select("distance", F.col("xs.id").alias("xs"), F.col("ys.id").alias("ys"), same.alias("same"))
    return made(own, F.col("x") == F.col("y")).unionByName(made(old, F.lit(False)))


def expanded(chunks: DataFrame) -> DataFrame:
    """The pairs (left_id, right_id, distance) of chunks (distance, xs, ys, same)."""
    pairs = chunks.select("distance", "same", F.explode("xs").alias("i"), "ys").select("distance", "same", "i", F.explode("ys").alias("j")).where("i <> j and (not same or i < j)")
    return pairs.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "distance")


def hamming_links(rows: DataFrame, max_distance: int, strategy: str = "auto") -> DataFrame:
    """JN-01 for grouping: (a, b) between the smallest ids of distinct fingerprints, and from each id to that smallest one; as
    connected as all pairs, but linear in copies."""
    rows = rows.where(F.col("h").isNotNull() & F.col("id").isNotNull()).select("id", "h")
    first = rows.groupBy("h").agg(F.min("id").alias("first"))
    found = _near_rows(first.select(F.col("h").alias("x"), F.col("first").alias("a")), first.select(F.col("h").alias("y"), F.col("first").alias("b")), max_distance, _chosen(first.select("h"), max_distance, strategy))
    within = rows.join(first, "h").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return found.where("x < y").select("a", "b").unionByName(within)


def hamming_probe(asked: DataFrame, index: DataFrame, max_distance: int, strategy: str = "auto") -> DataFrame:
    """JN-02: (q, id, distance) for each (q, h) asked of the (id, h) indexed."""
    a, b = asked.where(F.col("h").isNotNull()).select("q", "h"), index.where(F.col("h").isNotNull()).select("id", "h")
    once = _once(a, "q") and _once(b, "id")
    found = _near_rows(_chunks(a, "x", "xs"), _chunks(b, "y", "ys"), max_distance, _chosen(b.select("h").distinct(), max_distance, strategy))
    hits = found.select("distance", F.inline("xs"), "ys").select("distance", "q", F.inline("ys"))
    return hits.select("q", "id", "distance") if once else hits.groupBy("q", "id").agg(F.min("distance").alias("distance"))


def hamming_lists(asked: DataFrame, index: DataFrame, max_distance: int) -> DataFrame:
    """JN-03: for each q its hits as an array in the order of (distance, id)."""
    hits = hamming_probe(asked, index, max_distance)
    return hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("hits"))


def _tagged(media: DataFrame, classes: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    """(id, tag, hash) with a tag for each class of fingerprints and each kind."""
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).alias(name)) for k, cols in classes.items() for c in cols])
    return media.select("id", "kind", F.inline(rows)).where(F.col(name) != 0).select("id", F.concat_ws("/", "class", F.col("kind").cast("string")).alias("tag"), name).distinct()


def _variant_classes(media: DataFrame, changed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Files of one kind with equal fingerprints as one row (id: the smallest; kind, fingerprints, new: whether one of them is
    changed), and their (c, ids) in chunks; files without fingerprints are in neither."""
    names = [f"{a}{b}" for b in ("h", *(f"crop_{r}" for r in ASPECTS)) for a in ("", "mirror_")]
    names[1] = "mirror"
    rows = media.where("kind > 0").select("id", "kind", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]).where(reduce(Column.__or__, [F.col(n) != 0 for n in names]))
    if changed is not None:
        rows = rows.join(changed.select("id", F.lit(True).alias("new")).distinct(), "id", "left")
    rows = rows.withColumn("new", F.coalesce("new", F.lit(False)) if changed is not None else F.lit(True))
    classes = rows.groupBy("kind", *names).agg(F.min("id").alias("c"), F.bool_or("new").alias("new"))
    members = rows.join(classes.drop("new"), ["kind", *names]).select(F.col("c").alias("h"), "id", "new")
    return classes.withColumnRenamed("c", "id"), _chunks(members, "c", "ids")


def _class_candidates(classes: DataFrame, max_distance: int) -> DataFrame:
    """(left_id, right_id) of classes that hold candidates, once each; a class also with itself."""
    full = ("h", "mirror")
    crops = {r: (f"crop_{r}", f"mirror_crop_{r}") for r in ASPECTS}
    n = min(max_distance, MAX_BANDS) + 1
    new = classes.select("id", "new")
    asks = _tagged(classes, {"full": full} | crops, "x").join(new, "id").withColumnRenamed("new", "a_new")
    answers = _tagged(classes, {"full": full} | {r: full + c for r, c in crops.items()}, "y").join(new, "id").withColumnRenamed("new", "b_new")
    a, b = asks.groupBy("tag", "x").agg(F.bool_or("a_new").alias("a_new")), answers.groupBy("tag", "y").agg(F.bool_or("b_new").alias("b_new"))
    near = distance("x", "y") <= max_distance
    wanted = F.col("a_new") | F.col("b_new")
    if max_distance > MAX_SLICES:
        found = a.join(b, "tag").where(near & wanted)
    elif max_distance > MAX_BANDS:
        radius = max_distance // 4
        p, q = a.select("tag", "x", "a_new", F.inline(_slices("x"))).withColumn("mask", _masks(radius)), b.select("tag", "y", "b_new", F.inline(_slices("y")))
        p = p.select("tag", "x", "a_new", "part", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"))
        found = p.join(q, ["tag", "part", "bits"]).where(near & wanted & (F.col("part") == first_near_slice(F.col("x"), F.col("y"), radius)))
    else:
        p, q = a.select("tag", "x", "a_new", F.inline(band_keys(F.col("x"), n))), b.select("tag", "y", "b_new", F.inline(band_keys(F.col("y"), n)))
        found = _dealt(p, "tag", "band", "bits").join(_dealt(q, "tag", "band", "bits"), ["tag", "band", "bits"]).where(near & wanted & (F.col("band") == first_equal_band(F.col("x"), F.col("y"), n)))
    left = asks.select(F.col("id").alias("i"), "tag", "x", F.col("a_new").alias("i_new"))
    right = answers.select(F.col("id").alias("j"), "tag", "y", F.col("b_new").alias("j_new"))
    pairs = found.select("tag", "x", "y").join(left, ["tag", "x"]).join(right, ["tag", "y"]).where("i_new or j_new")
    return pairs.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id")).distinct()


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of files of pairs of classes (left_id, right_id, others); the last step, with no exchange after it."""
    others = [c for c in pairs.columns if c not in ("left_id", "right_id")]
    a, b = members.select(F.col("c").alias("left_id"), F.col("ids").alias("xs")), members.select(F.col("c").alias("right_id"), F.col("ids").alias("ys"))
    both = pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", "ys", F.explode("xs").alias("i"), *others)
    both = both.select("left_id", "right_id", "i", F.explode("ys").alias("j"), *others).where("i.id <> j.id and (left_id <> right_id or i.id < j.id) and (i.new or j.new)")
    return both.select(F.least("i.id", "j.id").alias("left_id"), F.greatest("i.id", "j.id").alias("right_id"), *others)


def variant_candidates(media: DataFrame, max_distance: int, changed: DataFrame | None = None) -> DataFrame:
    """JN-04, JN-05, FLT-07: (left_id, right_id) of one kind whose whole or mirrored fingerprints, or crops of one aspect with
    whole ones or with each other, are within the distance. With `changed` (id), only pairs with one of them: the delta join.

    One banded join serves all classes of fingerprints: a class is part of the key, a crop asks among the crops of its aspect
    and the whole ones. Files with equal fingerprints are one row until the last step, so their pairs are never exchanged."""
    classes, members = _variant_classes(media, changed)
    pairs = _expanded(_class_candidates(classes, max_distance), members)
    return pairs if _once(media, "id") else pairs.distinct()


def variant_scores(media: DataFrame, max_distance: int, threshold: float, changed: DataFrame | None = None) -> DataFrame:
    """SIM-03 of the candidates of JN-04: the similarity is that of fingerprints, so files with equal ones are scored once."""
    if not _once(media, "id"):
        return scored_pairs(media, variant_candidates(media, max_distance, changed), threshold)
    classes, members = _variant_classes(media, changed)
    return _expanded(scored_pairs(classes, _class_candidates(classes, max_distance), threshold), members)


def scored_pairs(media: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """SIM-03, FLT-06: the pairs with their best variant similarity, from the threshold up."""
    x, y = media.alias("x"), media.alias("y")
    out = pairs.join(x, F.col("left_id") == F.col("x.id")).join(y, F.col("right_id") == F.col("y.id"))
    return out.select("left_id", "right_id", best_variant("x", "y").alias("percent")).where(F.col("percent") >= threshold)


def query_by_fingerprint(media: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """JN-07: (q, id, percent) of one kind at or over the threshold, by the best of whole and mirrored fingerprints."""
    names = ("h", "mirror")
    index = media.select("id", "kind", F.explode(F.array(*names)).alias("h")).distinct()
    ask = asked.select("q", "kind", F.explode(F.array(*names)).alias("h")).distinct()
    from ..functions.hashes import distance_of

    d = distance_of(threshold)
    parts = [hamming_probe(ask.where(F.col("kind") == k), index.where(F.col("kind") == k), d) for k in (1, 2)]
    pairs = reduce(DataFrame.unionByName, parts).select("q", "id").distinct()
    x, y = asked.alias("x"), media.alias("y")
    out = pairs.join(x, F.col("x.q") == pairs["q"]).join(y, F.col("y.id") == pairs["id"])
    return out.select(pairs["q"], pairs["id"], best_full("x", "y").alias("percent")).where(F.col("percent") >= threshold)


def brute_best(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """JN-08: the best pair of (i, h) with (j, h) at or over the threshold; the smallest (i, j) of the best. The smaller side
    is replicated, and only one row leaves each task."""
    x, y = left.select("i", F.col("h").alias("x")), right.select("j", F.col("h").alias("y"))
    pairs = x.join(y, similarity("x", "y") >= threshold).select("i", "j", similarity("x", "y").alias("percent"))
    return pairs.orderBy(F.desc("percent"), "i", "j").limit(1)


def best_results(pairs: DataFrame, most: int) -> DataFrame:
    """SRT-02, SRT-07: the pairs of the highest percents, ties by their ids, `most` at most; each task keeps as many."""
    return pairs.orderBy(F.desc("percent"), "left_id", "right_id").limit(most)


def canonical(pairs: DataFrame) -> DataFrame:
    """SET-01: unordered pairs as (left, right) with left <= right, once each, with their highest percent."""
    return pairs.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.max("percent").alias("percent"))


__all__ = ["arrivals_in_chunks", "band_keys", "best_results", "brute_best", "canonical", "expanded", "hamming_links", "hamming_lists", "hamming_pairs", "hamming_probe", "percent_of", "query_by_fingerprint", "scored_pairs", "variant_candidates", "variant_scores"]
