"""Duplicate groups from pairs (AGG-13 to AGG-15, SRT-03, SRT-04, SET-06, FLT-12, WIN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, compact, release

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """AGG-13: (node, root) for every endpoint of (a, b) with a <> b; root is the smallest node of its component.

    Alternating stars: large ones hang a node's larger neighbours on its smallest one, small ones its smaller neighbours.
    Both are a minimum per node, folded before the exchange, and a join, so a hub of any degree needs no task of its own.
    The stars stand after about log2 of the longest path rounds; a round is a checkpoint, and the one before it goes."""
    edges = compact(checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()))
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = compact(checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
        release(edges)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def duplicate_groups(links: DataFrame) -> DataFrame:
    """AGG-13: (component_id, member, size) of the groups of two members or more."""
    at = connected_components(links).select(F.col("root").alias("component_id"), F.col("node").alias("member"))
    sizes = at.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    return at.join(sizes, "component_id").where("size >= 2")


def kind_stats(pairs: DataFrame, groups: DataFrame, kinds: DataFrame) -> DataFrame:
    """AGG-14: pairs, groups and files in groups by media kind; `kinds` is (id, kind)."""
    p = pairs.join(kinds, pairs["left_id"] == kinds["id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"))
    g = groups.join(kinds, groups["member"] == kinds["id"]).groupBy("kind").agg(F.countDistinct("component_id").alias("groups"), F.count(F.lit(1)).alias("files"))
    return kinds.select("kind").distinct().join(p, "kind", "left").join(g, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "groups", "files")])


def possible_pairs(kinds: DataFrame) -> DataFrame:
    """AGG-15: how many pairs of one kind there could be."""
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("possible"))


def reduction(candidates: Column, possible: Column) -> Column:
    """AGG-15: percent of the possible pairs that were never compared."""
    return F.when(possible > 0, (1 - candidates / possible) * 100.0).otherwise(0.0)


def members_in_order(groups: DataFrame, files: DataFrame, best: DataFrame) -> DataFrame:
    """SRT-04: members by best percent, then pixels, then size, all falling, then id; place 0 is the reference file."""
    rows = groups.join(files, groups["member"] == files["id"]).join(best, groups["member"] == best["node"], "left")
    from pyspark.sql import Window

    w = Window.partitionBy("component_id").orderBy(F.desc(F.coalesce("best", F.lit(0.0))), F.desc("pixels"), F.desc("size_bytes"), "member")
    return rows.select("component_id", "member", F.coalesce("best", F.lit(0.0)).alias("best"), "pixels", "size_bytes", (F.row_number().over(w) - 1).alias("place"))


def best_percent(pairs: DataFrame) -> DataFrame:
    """(node, best): the highest percent of a file's pairs."""
    return pairs.select(F.col("left_id").alias("node"), "percent").unionByName(pairs.select(F.col("right_id").alias("node"), "percent")).groupBy("node").agg(F.max("percent").alias("best"))


#: SRT-03: what groups may be sorted by; ties go to the first path.
GROUP_ORDERS = {"size": "total_bytes", "similarity": "best", "name": "first_path", "date": "latest"}


def groups_in_order(summary: DataFrame, by: str, descending: bool = True) -> DataFrame:
    c = F.col(GROUP_ORDERS[by])
    return summary.orderBy(c.desc() if descending else c.asc(), "first_path")


def groups_with(groups: DataFrame, needle: str, path: str = "path") -> DataFrame:
    """FLT-12: groups any of whose paths holds the text, in any case."""
    hit = groups.groupBy("component_id").agg(F.bool_or(F.contains(F.lower(path), F.lit(needle.lower()))).alias("hit")).where("hit").select("component_id")
    return groups.join(hit, "component_id", "left_semi")


def stable_order(roots: DataFrame, previous: DataFrame) -> DataFrame:
    """WIN-12: roots in their previous places (root, place), new ones after them by name."""
    from pyspark.sql import Window

    joined = roots.join(previous, "root", "left")
    w = Window.orderBy(F.col("place").isNull(), "place", "root")
    return joined.select("root", (F.row_number().over(w) - 1).alias("place"))


def distinct_members(pairs: DataFrame) -> DataFrame:
    """SET-06."""
    return pairs.select(F.col("left_id").alias("id")).union(pairs.select("right_id")).distinct()


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("SparkSession", "annotations")]
