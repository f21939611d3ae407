"""The main path: a folder scanned in full and by differences, the index store, caches and recovered journals."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.operators import changes
from twinsieve.plans.scan import MediaIndex
from twinsieve.sources import journal
from twinsieve.sources.media import IndexStore


def write_image(path, pixels):
    with open(path, "wb") as f:
        f.write(b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes())


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    root = tmp_path / "media"
    root.mkdir()
    for k in range(4):
        smooth = rng.integers(0, 200, (8, 8)).repeat(8, 0).repeat(8, 1)
        write_image(root / f"a{k}.png", smooth)
        write_image(root / f"b{k}.png", smooth + 2)
    (root / "broken.png").write_bytes(b"not an image")
    return root


def stored(index):
    files, pairs = index.load()
    return sorted(map(tuple, files.select("path", "size", "h", "analysis_failed").collect())), sorted(map(tuple, pairs.collect()))


def test_delta_scan_equals_full_scan(spark, folder, tmp_path):
    delta, root = MediaIndex(spark, str(folder), str(tmp_path / "delta")), f"file:{folder}"
    first = delta.scan("delta")
    assert (first["added"], first["unchanged"]) == (9, 0)
    names = {(r.left, r.right) for r in delta.load()[1].collect()}
    assert {(f"{root}/a{k}.png", f"{root}/b{k}.png") for k in range(4)} <= names
    (folder / "a0.png").unlink()
    write_image(folder / "b1.png", np.arange(64 * 64).reshape(64, 64) % 251)
    write_image(folder / "c.png", np.arange(64 * 64).reshape(64, 64) % 251)
    second = delta.scan("delta")
    assert [second[k] for k in ("added", "modified", "unchanged", "deleted")] == [1, 1, 7, 1]
    full = MediaIndex(spark, str(folder), str(tmp_path / "full"))
    full.scan("full")
    assert stored(delta) == stored(full)
    assert {(f"{root}/b1.png", f"{root}/c.png")} <= {(r.left, r.right) for r in full.load()[1].collect()}
    delta.forget([f"{root}/c.png"])
    assert not [r for r in delta.load()[1].collect() if "c.png" in r.left + r.right]


def test_store_keeps_the_old_version_until_the_new_is_named(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), "k", "k long, v string")
    assert store.read().count() == 0
    store.replace(spark.createDataFrame([(1, "a")], "k long, v string"))
    before = store.read()
    store.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"))
    assert sorted(map(tuple, store.read().collect())) == [(1, "b"), (2, "c")]
    assert [tuple(r) for r in before.collect()] == [(1, "a")]  # a reader of the version before
    spark.createDataFrame([(9, "x")], "k long, v string").write.parquet(str(tmp_path / "s" / "v-crashed"))  # written, never named
    assert sorted(r.k for r in store.read().collect()) == [1, 2]
    for k in range(3):
        store.replace(spark.createDataFrame([(k, "d")], "k long, v string"))
    assert [r.k for r in store.read().collect()] == [2]
    assert len([n for n in os.listdir(tmp_path / "s") if n.startswith("CURRENT-")]) == 2


def test_lookups_and_cache(spark):
    state = "path string, size long, modified long, quick_hash string"
    asked = spark.createDataFrame([("a", 1, 1, "q"), ("b", 2, 1, "q"), ("n", 1, 1, "q"), ("z", None, 1, "q")], state)
    held = spark.createDataFrame([("a", 1, 1, "q", 5, "s"), ("b", 1, 1, "q", 6, "s"), ("z", None, 1, "q", 7, "s")], state + ", admitted_ms long, sha256 string")
    got = {r.path: (r.unchanged, r.admitted_ms, r.sha256) for r in changes.lookups(asked, held).collect()}
    assert got == {"a": (True, 5, "s"), "b": (False, 6, None), "n": (False, -1, None), "z": (False, 7, None)}
    full = state + ", cache_version int, policy string, payload string"
    cache = spark.createDataFrame([("a", 1, 1, "q", 1, "v1", "old"), ("b", 2, 1, "q", 1, "v1", ""), ("n", 1, 1, "q", 2, "v1", "other")], full)
    cache = changes.purge_versions(changes.cache_save(cache, spark.createDataFrame([("a", 1, 1, "q", 1, "v1", "new")], full)), 1)
    rows = changes.cache_read(asked.withColumns({"cache_version": F.lit(1), "policy": F.lit("v1")}), cache, F.length("payload") > 0).collect()
    assert {r.path: r.payload for r in rows} == {"a": "new", "b": None, "n": None, "z": None}


def lines_of(spark, text):
    return journal.journal_lines(spark.createDataFrame([("j", text)], "journal string, content string"))


def test_recovery_of_one_run_and_refusal_of_corrupt_journals(spark):
    rows = [{"eventType": "run_started", "recordId": f"s{r}", "runId": r} for r in ("r1", "r2")]
    rows += [{"eventType": "case_complete", "recordId": f"c{r}{s}", "runId": r, "caseId": s, "status": s, "elapsedMs": 1230.0} for r in ("r1", "r2") for s in ("SUCCESS", "FAILED")]
    rows += [{"eventType": "run_finished", "recordId": "e1", "runId": "r1"}]
    text = "\n".join(map(json.dumps, rows)) + "\n"
    one = journal.recover(lines_of(spark, text), "r1")
    assert [r.run_id for r in one.collect()] == ["r1"] and journal.recover(lines_of(spark, text)).count() == 2
    assert one.select(journal.console_block()).first()[0] == "cases    2\nsuccess  1\nfailed   1\nseconds  2.46"
    whole = json.loads(journal.summary_json(one).first().json)
    assert whole == {"runId": "r1", "cases": 2, "statuses": {"SUCCESS": 1, "FAILED": 1, "CANCELLED": 0, "SKIPPED": 0}, "totalMs": 2460.0}
    events, _ = journal.replay(lines_of(spark, text))
    assert {r.run_id: r.sound for r in journal.run_records(events).collect()} == {"r1": True, "r2": False}
    with pytest.raises(ValueError, match="corrupt at line 1"):
        journal.recover(lines_of(spark, "nonsense\n" + text))


def test_checkpoint_of_many_partitions_is_few_files(spark):
    from pathlib import Path

    from twinsieve.session import _checkpoint_file, checkpointed

    keys = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        counts = spark.range(5000).selectExpr("id % 700 k").groupBy("k").count().selectExpr("k", "count", "monotonically_increasing_id() at")
        out = checkpointed(counts)
        files = list(Path(_checkpoint_file(out).removeprefix("file:")).glob("part-*"))
        got = {r.k: r["count"] for r in out.collect()}
        assert len(files) <= 25 and out.select("at").distinct().count() == 700
        assert got == {k: 8 if k < 100 else 7 for k in range(700)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
