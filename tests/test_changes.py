"""Index changes with the fixture values of the survey."""

from twinsieve.operators import changes

STATE = "path string, size long, modified long, quick_hash string"


def test_diff_with_quick_hash(spark):
    before = spark.createDataFrame([("a.jpg", 100, 10, "x"), ("b.mp4", 200, 20, "y")], STATE)
    now = spark.createDataFrame([("a.jpg", 100, 10, "x"), ("b.mp4", 250, 21, "z"), ("c.png", 300, 30, "q")], STATE)
    assert {tuple(r) for r in changes.change_diff(before, now).collect()} == {("a.jpg", "unchanged"), ("b.mp4", "modified"), ("c.png", "added")}


def test_new_content_under_the_same_stat(spark):
    before = spark.createDataFrame([("a.jpg", 100, 10, "x")], STATE)
    now = spark.createDataFrame([("a.jpg", 100, 10, "other")], STATE)
    assert changes.change_diff(before, now).first().change == "modified"
    assert changes.change_diff(before, now, quick=False).first().change == "unchanged"


def test_pairs_are_stored_in_order(spark):
    pairs = spark.createDataFrame([("b.jpg", "a.jpg", 100.0), ("d.png", "c.png", 87.5), ("a.jpg", "b.jpg", 90.0)], "left string, right string, percent double")
    assert {tuple(r) for r in changes.replace_pairs(pairs).collect()} == {("a.jpg", "b.jpg", 100.0), ("c.png", "d.png", 87.5)}


def test_forget_cascades(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    pairs = spark.createDataFrame([("a", "b", 99.0), ("b", "c", 95.0)], "left string, right string, percent double")
    kept, left = changes.forget(files, pairs, spark.createDataFrame([("a",)], "path string"))
    assert {r.path for r in kept.collect()} == {"b", "c"} and [tuple(r) for r in left.collect()] == [("b", "c", 95.0)]


def test_trace_start_keeps_the_first_and_admission_resets(spark):
    rows = [("p", "admit", 1, None), ("p", "start", 2, None), ("p", "finish", 3, "ok"), ("p", "admit", 5, None), ("p", "start", 6, None), ("p", "start", 7, None)]
    got = changes.traces(spark.createDataFrame(rows, "path string, event string, at_ms long, outcome string")).first()
    assert (got.admitted_ms, got.started_ms, got.finished_ms, got.outcome) == (5, 6, 0, "")


def test_dataset_fingerprint_follows_the_manifest_rule(spark):
    import hashlib

    files = spark.createDataFrame([("b", 2, "bb"), ("a", 1, "aa")], "rel string, size long, sha256 string")
    assert changes.dataset_fingerprint(files).first().fingerprint == hashlib.sha256(b"a;1;aa|b;2;bb|").hexdigest()
