"""The monitor against batch results, series operators on hand-made values, and the registry."""

import datetime as dt
import os
import subprocess
import sys

from twinsieve.operators import hamming, series
from twinsieve.session import ship
from twinsieve.streaming import monitor


def test_micro_batches_match_as_one_batch_and_replays_change_nothing(spark, tmp_path):
    rows = [(i, 0xFF << (i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, h long")
    m = monitor.IncrementalMatcher(str(tmp_path), 3)
    for k in range(4):
        m(df.where(f"id % 4 = {k}"), k)
    m(df.where("id % 4 = 3"), 3)
    want = {tuple(r) for r in hamming.hamming_pairs(df, 3).collect()}
    got = [tuple(r) for r in m.pairs(spark).collect()]
    assert set(got) == want and len(got) == len(want)


def test_stable_files_removals_and_retries(spark, tmp_path):
    ship(spark)
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", "modify", 1, 1, t(0)), ("a", "modify", 2, 1, t(2)), ("a", "modify", 2, 1, t(6)), ("b", "modify", 1, 1, t(1)), ("b", "remove", None, None, t(2)), ("c", "busy", None, None, t(3))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, monitor.EVENTS).coalesce(1).write.parquet(src)
    events = spark.readStream.schema(monitor.EVENTS).parquet(src)
    q = monitor.settled(events, 3.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.path, r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "Detected"), ("b", "Removed"), ("c", "Deferred")}


def test_backoff_doubles_to_a_limit():
    assert [monitor.backoff(500, n) for n in (1, 2, 3, 6, 9)] == [500, 1000, 2000, 16000, 16000] and monitor.backoff(2000, 9) == 30000


def test_rates_and_averages(spark):
    s = spark.createDataFrame([("k", 0.0, 5.0), ("k", 10.0, 5.0), ("k", 50.0, 1.0)], "key string, t double, units double")
    assert [r.rate for r in series.rolling_rate(s, 30).orderBy("t").collect()] == [-1.0, 1.0, -1.0]
    v = spark.createDataFrame([("k", 1, 2.0), ("k", 2, 4.0), ("k", 3, None), ("k", 4, 8.0)], "key string, t long, value double")
    assert [r.average for r in series.moving_average(v, 2).orderBy("t").collect()] == [2.0, 3.0, None, 8.0]


def test_nearest_takes_the_earliest_of_equals(spark):
    left = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 99.0)], "key string, lid long, t double")
    right = spark.createDataFrame([("k", 7, 11.0), ("k", 8, 9.0), ("k", 9, 20.0)], "key string, rid long, s double")
    assert [tuple(r) for r in series.nearest_join(left, right, 1.5).collect()] == [("k", 1, 8, 1.0)]


def test_kept_frames_one_best_of_each_stretch_first(spark):
    frames = [("v", i, float(i), sd) for i, sd in enumerate([9.0, 1.0, 2.0, 2.0, 1.0, 1.0, 5.0, 8.0])]
    df = spark.createDataFrame(frames, "key string, i long, ts double, sd double")
    assert sorted(r.i for r in series.kept_frames(df, 4).collect()) == [0, 2, 4, 7]
    assert sorted(r.i for r in series.kept_frames(df, 5).collect()) == [0, 2, 4, 6, 7]


def test_aligned_grids_and_credits(spark):
    fine = spark.createDataFrame([("v", float(i)) for i in range(20)], "key string, ts double")
    coarse = spark.createDataFrame([("v", 4.0 * i) for i in range(5)], "key string, ts double")
    assert sorted(r.ts for r in series.aligned_grids(fine, coarse).collect()) == [0.0, 4.0, 8.0, 12.0, 16.0]
    f = [("v", float(i), 20.0 if i >= 180 else 90.0, 1.0, 30.0 if i >= 180 else 4.0, False, 200.0) for i in range(200)]
    got = series.credit_runs(spark.createDataFrame(f, "key string, ts double, mean double, delta double, edge double, low_info boolean, duration double")).first()
    assert (got.start, got.main_end) == (180.0, 175.0)


def test_deviations_fire_on_repetition_only(spark):
    rows = [("k", "p", t, 10.0 if t in (1, 2, 3, 5, 6) else 100.0, 100.0) for t in range(1, 9)]
    df = spark.createDataFrame(rows, "key string, profile string, t long, live double, expected double")
    assert [r.t for r in series.deviation_triggers(df, 0.5, 3).collect()] == [3]


def test_registry_needs_no_session_and_every_twin_has_a_query():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q); print(len(q))"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, timeout=120).returncode == 0


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    from twinsieve import session

    ship(spark)
    assert spark.conf.get(session.BATCH_KEY) == str(session.BATCH_BYTES)
    spark.conf.set(session.BATCH_KEY, "1000000")
    assert session.ship(spark).conf.get(session.BATCH_KEY) == "1000000"
    spark.conf.set(session.BATCH_KEY, str(session.BATCH_BYTES))


def test_pairs_of_arriving_copies_are_stored_by_fingerprint(spark, tmp_path):
    rows = [(i, 0xFF << (i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, h long")
    m = monitor.IncrementalMatcher(str(tmp_path), 3)
    for k in range(2):
        m(df.where(f"id div 60 = {k}"), k)
    got = sorted((r.left_id, r.right_id, r.distance) for r in m.pairs(spark).collect())
    assert got == [(a, b, 0 if (b - a) % 2 == 0 else 2) for a in range(120) for b in range(a + 1, 120)]
    assert spark.read.parquet(str(tmp_path / "pairs")).count() < len(got) / 2
    m(spark.createDataFrame([(0, 0xFF), (200, 0xFF)], "id long, h long"), 2)
    m(spark.createDataFrame([(0, 0x1FF), (201, 0xFF)], "id long, h long"), 3)  # id 0 came again: the history repeats it
    new = {(r.left_id, r.right_id, r.distance) for r in m.pairs(spark).where("right_id = 201").collect()}
    assert {x for x in new if x[0] in (0, 200)} == {(0, 201, 1), (200, 201, 0)}


def test_no_key_of_short_distances_is_one_band(spark):
    """Fingerprints that agree in a quarter of their bits are no candidates for that alone."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.getrandbits(47)) for i in range(300)] + [(300, 0x123456789), (301, 0x123456789 ^ 0b111)]
    df = spark.createDataFrame(rows, "id long, h long")
    keys = df.selectExpr("h x").select(hamming.F.inline(hamming._mask_keys(hamming.F.col("x"), hamming._two_bands(5))))
    assert keys.groupBy("band", "bits").count().agg({"count": "max"}).first()[0] < 100
    assert [(r.left_id, r.right_id) for r in hamming.hamming_pairs(df, 3, "bands").collect()] == [(300, 301)]
