"""Media folders as tables (SRC-01 to SRC-03, SRC-08, SRC-12, SRC-16, SNK-07, SNK-12, FN-10, FN-14)."""

from __future__ import annotations

import configparser
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import media_kind
from ..functions.vision import IMAGE_SCHEMA, image_rows, quick_hash


def scan_folder(spark: SparkSession, root: str, excluded: str | None = None, content: bool = True) -> DataFrame:
    """SRC-01: path, size, modified (ms), kind and quick hash of every media file below a root but not below `excluded`.

    Without `content` only names and sizes are listed (SRC-02); files are split over tasks by size either way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(media_kind("path") > 0)
    if excluded:
        files = files.where(~F.contains("path", F.lit(excluded.rstrip("/") + "/")))
    out = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), media_kind("path").alias("kind"), *(["content"] if content else []))
    return out.withColumn("quick_hash", quick_hash("content")) if content else out


def fingerprint_images(files: DataFrame) -> DataFrame:
    """SRC-12, AGG-22 to AGG-24: fingerprints of the images of (path, content)."""
    return files.where(media_kind("path") == 1).select("path", "content").mapInPandas(image_rows, IMAGE_SCHEMA)


class IndexStore:
    """A keyed table in a folder: reading, upserting, and replacing as a whole (SRC-08, SNK-01, SNK-02, SNK-07, SNK-08, SNK-10).

    A new version is written beside the old one; then an empty file with the next number and the version's name makes it
    current in one step. The version before stays for those who read it; earlier ones go. A crash between the steps leaves
    the old version current."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[str]:
        """Names of pointer files, the newest last; a pointer's name holds its number and its version."""
        fs, path = self._path("")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def _current(self) -> str | None:
        names = self._pointers()
        return names[-1].split("-", 2)[2] if names else None

    def read(self) -> DataFrame:
        """SRC-08."""
        version = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        old = self._pointers()
        number = int(old[-1].split("-", 2)[1]) + 1 if old else 1
        fs, pointer = self._path(f"CURRENT-{number:012d}-{version}")
        fs.create(pointer, False).close()
        for name in old[:-1]:
            fs.delete(self._path(name)[1], False)
            fs.delete(self._path(name.split("-", 2)[2])[1], True)

    def upsert(self, rows: DataFrame) -> None:
        from ..operators.changes import upsert

        self.replace(upsert(self.read(), rows, self.key))


def load_profile(text: str, newest: int = 1) -> dict[str, dict[str, str]] | None:
    """SRC-16, FN-10: a performance profile's sections; None as a whole if a line is malformed or its version is too new."""
    parser = configparser.ConfigParser(interpolation=None, strict=True)
    try:
        parser.read_string(text)
        if parser.getint("profile", "version", fallback=1) > newest:
            return None
    except (configparser.Error, ValueError):
        return None
    return {s: dict(parser[s]) for s in parser.sections()}


def folder_id(root: str, seeds: tuple[int, int] = (0, 0x9E3779B97F4A7C15)) -> str:
    """SNK-12: thirty-two hex digits for a canonical root, from two seeded FNV-1a values."""
    from ..functions.vision import FNV_STANDARD, fnv1a

    clean = re.sub("/{2,}", "/", root.replace("\\", "/")).rstrip("/") or "/"
    return "".join(f"{fnv1a(clean.encode(), FNV_STANDARD ^ seed):016x}" for seed in seeds)


def policy_id(settings: dict, default: dict) -> str:
    """FN-14: `v1` for the default policy, else `custom:` and a digest of what differs, in the order of names."""
    other = sorted((k, v) for k, v in settings.items() if default.get(k) != v)
    return "v1" if not other else "custom:" + hashlib.sha256(repr(other).encode()).hexdigest()[:16]
