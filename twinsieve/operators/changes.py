"""Incremental indexes: what changed, what stays, what goes (JN-09 to JN-16, SRC-11, SRC-15, SNK-01 to SNK-04, SNK-09 to SNK-11, SET-02 to SET-04, AGG-18 to AGG-20, FLT-03, FLT-09, FLT-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CONTENT_BYTES = 512 << 20


def change_diff(previous: DataFrame, current: DataFrame, quick: bool = True) -> DataFrame:
    """JN-09: (path, change) of a full outer join by path: added, deleted, and by size, time and (`quick`) quick hash
    unchanged or modified. FLT-13: without the quick hash this is the fast rescan's test."""
    keys = ["size", "modified"] + (["quick_hash"] if quick else [])
    p = previous.select("path", *[F.col(k).alias(f"p_{k}") for k in keys], F.lit(True).alias("p"))
    c = current.select("path", *[F.col(k).alias(f"c_{k}") for k in keys], F.lit(True).alias("c"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"p_{k}").eqNullSafe(F.col(f"c_{k}"))
    change = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return p.join(c, "path", "full_outer").select("path", change.alias("change"))


def without_ignored(files: DataFrame, ignored: DataFrame, path: str = "path") -> DataFrame:
    """FLT-03: files not on the ignore list."""
    return files.join(ignored.select(F.col(ignored.columns[0]).alias(path)), path, "left_anti")


def removed(indexed: DataFrame, seen: DataFrame, ignored: DataFrame) -> DataFrame:
    """JN-10: indexed paths neither seen by a complete walk nor ignored."""
    return without_ignored(indexed.join(seen.select("path"), "path", "left_anti"), ignored)


def forget(files: DataFrame, pairs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-03, JN-11: files without the ones gone, and pairs neither end of which is gone."""
    g = gone.select("path").distinct()
    left = pairs.join(g, pairs["left"] == g["path"], "left_anti")
    return files.join(g, "path", "left_anti"), left.join(g, left["right"] == g["path"], "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """SNK-01: fresh rows replace stored ones of the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_pairs(pairs: DataFrame) -> DataFrame:
    """SNK-02: the pair set to store: ordered ends, one row a pair, the last percent of repeated ones being the highest."""
    from .hamming import canonical

    return canonical(pairs)


CONTENT = ("size", "quick_hash", "sha256")


def content_identical(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """JN-12: pairs with whether both files hold the same bytes: equal size, quick hash and SHA-256, up to 512 MiB. Pairs that
    carry these columns of both ends (left_*, right_*) are not joined with the files again."""
    if f"left_{CONTENT[0]}" not in pairs.columns:
        for side in ("left", "right"):
            pairs = pairs.join(files.select(F.col("path").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in CONTENT]), side, "left")
    same = F.coalesce((F.col("left_size") <= MAX_CONTENT_BYTES) & reduce(Column.__and__, [F.col(f"left_{c}") == F.col(f"right_{c}") for c in CONTENT]), F.lit(False))
    return pairs.select("left", "right", "percent", same.alias("content_identical"))


def revalidate(pairs: DataFrame, states: DataFrame, current: DataFrame, threshold: float) -> DataFrame:
    """JN-13: stored pairs that still hold: both ends indexed, unchanged on disk and analysed, and similar enough by the
    fingerprints stored now."""
    from ..functions.hashes import similarity

    fresh = states.join(current.select("path", F.col("size").alias("n_size"), F.col("modified").alias("n_modified")), "path").where("size = n_size and modified = n_modified and h <> 0").select("path", "h")
    a, b = fresh.select(F.col("path").alias("left"), F.col("h").alias("x")), fresh.select(F.col("path").alias("right"), F.col("h").alias("y"))
    return pairs.join(a, "left").join(b, "right").select("left", "right", similarity("x", "y").alias("percent")).where(F.col("percent") >= threshold)


def survivors(stored: DataFrame, changed: DataFrame, emitted: DataFrame) -> DataFrame:
    """JN-14, JN-16, SET-02: stored pairs without a changed end, and the ones emitted anew."""
    c = changed.select("path").distinct()
    kept = stored.join(c, stored["left"] == c["path"], "left_anti")
    kept = kept.join(c, kept["right"] == c["path"], "left_anti")
    return replace_pairs(kept.unionByName(emitted))


def included(left_changed: Column, right_changed: Column, changed_set: bool, hybrid_image: Column) -> Column:
    """FLT-09: without a changed set all pairs; images of the hybrid mode with exactly one changed end; others with either."""
    if not changed_set:
        return F.lit(True)
    return F.when(hybrid_image, left_changed != right_changed).otherwise(left_changed | right_changed)


def index_diff(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """JN-15: (path, change) between two indexes by any of the fields; equal rows are left out."""
    x = a.select("path", *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("a"))
    y = b.select("path", *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("b"))
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs, "changed")
    return x.join(y, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-04: keys of one side only, and of which."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def adopt(main: DataFrame, scratch: DataFrame, scope: Column, key: str = "path") -> DataFrame:
    """SNK-11: the main index after adopting a scratch one: rows of the scope that the scratch lacks go, its own replace others."""
    outside = main.where(~scope)
    inside = main.where(scope).join(scratch.select(key), key, "left_semi")
    return upsert(outside.unionByName(inside), scratch, key)


def prune_orphans(cache: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """SNK-09: cache rows whose file is indexed."""
    return cache.join(files.select(key), key, "left_semi")


def lookups(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC-11: for each file asked (path, size, modified, quick_hash) whether it is stored unchanged, its admission time (-1
    when it is not stored) and its content hash, which holds only for an unchanged file."""
    state = ("size", "modified", "quick_hash")
    s = stored.select("path", *[F.col(c).alias(f"s_{c}") for c in state], "admitted_ms", F.col("sha256").alias("held"))
    same = F.lit(True)
    for c in state:
        same &= F.col(c) == F.col(f"s_{c}")
    same = F.coalesce(same, F.lit(False))
    found = asked.select("path", *state).join(s, "path", "left")
    return found.select("path", same.alias("unchanged"), F.coalesce("admitted_ms", F.lit(-1).cast("long")).alias("admitted_ms"), F.when(same, F.col("held")).alias("sha256"))


CACHE_KEY = ("path", "size", "modified", "quick_hash", "cache_version", "policy")


def cache_read(asked: DataFrame, cache: DataFrame, sound: Column) -> DataFrame:
    """SRC-15: the files asked with their cached `payload`, null where the key differs in any part or the payload isn't sound."""
    return asked.join(cache.where(sound).select(*CACHE_KEY, "payload"), list(CACHE_KEY), "left")


def cache_save(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK-10: the cache with fresh payloads in the place of those of the same key."""
    return cache.join(fresh.select(*CACHE_KEY), list(CACHE_KEY), "left_anti").unionByName(fresh)


def purge_versions(cache: DataFrame, version: int) -> DataFrame:
    """SNK-10: the cache without other versions."""
    return cache.where(F.col("cache_version") == version)


def traces(events: DataFrame) -> DataFrame:
    """SNK-04, SRC-10: per path of (path, event, at_ms, outcome): the last admission, the first start since, the last finish;
    finished_ms 0 is unfinished."""
    admitted = events.where("event = 'admit'").groupBy("path").agg(F.max("at_ms").alias("admitted_ms"))
    later = events.join(admitted, "path").where("at_ms >= admitted_ms")
    done = F.max(F.when(F.col("event") == "finish", F.struct("at_ms", "outcome")))
    out = later.groupBy("path", "admitted_ms").agg(F.min(F.when(F.col("event") == "start", F.col("at_ms"))).alias("started_ms"), done.alias("done"))
    return out.select("path", "admitted_ms", F.coalesce("started_ms", F.lit(0)).alias("started_ms"), F.coalesce("done.at_ms", F.lit(0)).alias("finished_ms"), F.coalesce("done.outcome", F.lit("")).alias("outcome"))


def dataset_fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-18: SHA-256 of `rel;size;sha256|` of every file in the order of rel, for each group of `by`.

    The text is put together in one place: it is bounded by the number of files of one dataset, some hundred bytes each."""
    entry = F.concat(F.col("rel"), F.lit(";"), F.col("size").cast("string"), F.lit(";"), F.col("sha256"), F.lit("|"))
    agg = files.groupBy(*(by or [])).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", entry.alias("e")))), lambda x: x["e"]), "").alias("manifest"), F.count(F.lit(1)).alias("files"))
    return agg.select(*(by or []), "files", F.sha2("manifest", 256).alias("fingerprint"))


def manifest_key(files: DataFrame, by: list[str]) -> DataFrame:
    """AGG-19, AGG-20: an order-free key of path, size, time and quick hash, summed in parallel; equal manifests have equal keys."""
    h = F.xxhash64("path", "size", "modified", "quick_hash")
    return files.groupBy(*by).agg(F.bit_xor(h).alias("x"), F.count(F.lit(1)).alias("n")).select(*by, F.sha2(F.concat_ws(";", F.col("x").cast("string"), F.col("n").cast("string")), 256).alias("key"))
