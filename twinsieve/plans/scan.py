"""End-to-end scans: folder to index to pairs to groups (the IPC commands that carry data, STR-12, STR-13, AGG-14, AGG-15).

`MediaIndex` has a method for each: scan, load, diff, query, forget, reverify.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import distance_of
from ..operators import changes, groups, hamming
from ..session import checkpointed, ship
from ..sources.media import IndexStore, fingerprint_images, scan_folder

ENGINE_VERSION = "1.0.0"
_CROPS = ", ".join(f"crop_{r} long, mirror_crop_{r} long" for r in ("4x3", "1x1", "9x16"))
FILES = f"path string, size long, modified long, kind int, quick_hash string, width int, height int, analysis_failed boolean, h long, mirror long, {_CROPS}"
PAIRS = "left string, right string, percent double"


class MediaIndex:
    """A media folder's index: files with fingerprints, and similar pairs, both replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str, store: str, threshold: float = 87.5) -> None:
        self.spark, self.root, self.threshold = ship(spark), root, threshold
        self.files = IndexStore(spark, f"{store}/files", "path", FILES)
        self.pairs = IndexStore(spark, f"{store}/pairs", "left", PAIRS)

    def _pairs(self, files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
        rows = checkpointed(files.where("h <> 0").withColumn("id", F.col("path")))
        mark = changed.select(F.col("path").alias("id")) if changed is not None else None
        found = hamming.variant_candidates(rows, distance_of(self.threshold), mark)
        return hamming.scored_pairs(rows, found, self.threshold).select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), "percent")

    def scan(self, mode: str = "full") -> dict[str, int]:
        """START_SCAN: lists the folder, fingerprints what is new or changed, drops what is gone, and matches: all pairs
        (`full`) or only those with a changed file (`delta`), with the same result."""
        stored = checkpointed(self.files.read())
        listed = checkpointed(scan_folder(self.spark, self.root).drop("content"))
        diff = checkpointed(changes.change_diff(stored, listed))
        counts = {r[0]: r[1] for r in diff.groupBy("change").count().collect()}
        fresh = diff.where("change in ('added', 'modified')").select("path")
        content = scan_folder(self.spark, self.root).join(fresh, "path", "left_semi")
        prints = fingerprint_images(content)
        added = listed.join(fresh, "path", "left_semi").join(prints, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("h", "mirror", *(x.split()[0] for x in _CROPS.split(", ")))})
        kept = stored.join(diff.where("change = 'unchanged'").select("path"), "path", "left_semi")
        names = [c.split()[0] for c in FILES.split(", ")]
        files = checkpointed(kept.select(*names).unionByName(added.select(*names)))
        if mode == "delta":
            gone = diff.where("change = 'deleted'").select("path")
            _, old = changes.forget(stored, self.pairs.read(), gone)
            pairs = changes.survivors(old, fresh, self._pairs(files, fresh))
        else:
            pairs = self._pairs(files)
        pairs = checkpointed(pairs)
        self.files.replace(files)
        self.pairs.replace(pairs)
        return {k: counts.get(k, 0) for k in ("added", "modified", "unchanged", "deleted")} | {"pairs": pairs.count()}

    def load(self) -> tuple[DataFrame, DataFrame]:
        """LOAD_INDEX, SNK-18."""
        return self.files.read(), self.pairs.read()

    def duplicate_groups(self) -> DataFrame:
        return groups.duplicate_groups(self.pairs.read().select(F.col("left").alias("a"), F.col("right").alias("b")))

    def forget(self, paths: list[str]) -> None:
        """FORGET_PATHS, SNK-03."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        files, pairs = changes.forget(self.files.read(), self.pairs.read(), gone)
        files, pairs = checkpointed(files), checkpointed(pairs)
        self.files.replace(files)
        self.pairs.replace(pairs)

    def reverify(self) -> int:
        """REVERIFY_INDEX, JN-13: keeps the stored pairs that still hold."""
        states = self.files.read()
        pairs = checkpointed(changes.revalidate(self.pairs.read(), states, states, self.threshold))
        self.pairs.replace(pairs)
        return pairs.count()
