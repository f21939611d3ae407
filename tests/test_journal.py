"""Journal replay: duplicates, torn tails, corruption, commits."""

import json
import re

from twinsieve.operators import cohorts
from twinsieve.sources import journal


def event(kind, rid, run="r1", **more):
    return json.dumps({"eventType": kind, "recordId": rid, "runId": run, **more})


def replayed(spark, text):
    lines = journal.journal_lines(spark.createDataFrame([("j", text)], "journal string, content string"))
    return journal.replay(lines)


START = event("run_started", "1", startedAt="2024-01-01T00:00:00", datasetFingerprint="fp", gitCommit="abc", buildVersion="1")
END = event("run_finished", "9", completedAt="2024-01-01T00:00:05", status="SUCCESS")


def test_round_trip_with_duplicates_and_torn_tail(spark):
    mode = event("mode_result", "2", caseId="c", requestedMode="AUTO", status="SUCCESS", started=True, elapsedMs=7.0)
    commit = event("case_complete", "3", caseId="c", path="x", status="SUCCESS", elapsedMs=8.0)
    changed = event("case_complete", "3", caseId="c", path="y", status="FAILED", elapsedMs=1.0)
    events, anomalies = replayed(spark, "\n".join([START, mode, mode, commit, changed, END, '{"eventType":"mode']))
    assert sorted(r.kind for r in anomalies.collect()) == ["DuplicateConflicting", "DuplicateIdentical", "TruncatedTail"]
    run = journal.runs(events, anomalies).first()
    assert (run.run_class, run.wall_ms, run.dataset_state, run.commit_state) == ("Complete", 5000.0, "Valid", "Known")
    cases, modes = journal.cases_and_modes(events)
    assert [(c.path, c.elapsed_ms) for c in cases.collect()] == [("x", 8.0)]
    m = modes.first()
    assert m.elapsed_ms == 7.0 and m.commit is not None


def test_corruption_stops_the_replay(spark):
    events, anomalies = replayed(spark, "\n".join([START, "not json", END, ""]))
    assert [a.kind for a in anomalies.collect()] == ["MidFileCorruption"] and events.count() == 1
    assert journal.runs(events, anomalies).first().run_class == "Corrupt"


def test_modes_without_commit_and_unstarted_ones(spark):
    mode = event("mode_result", "2", caseId="c", requestedMode="CUDA", status="SKIPPED", started=False, elapsedMs=0.0)
    events, _ = replayed(spark, "\n".join([START, mode, ""]))
    m = journal.cases_and_modes(events)[1].first()
    assert m.commit is None and m.elapsed_ms is None


def test_statistics_of_nothing_are_null_and_p95_is_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 41)], "value double")
    got = df.agg(*cohorts.statistics("value")).first()
    assert (got.n, got["median"], got.p95, got["mean"]) == (40, 20.5, 38.0, 20.5)
    none = df.where("value < 0").agg(*cohorts.statistics("value")).first()
    assert none.n == 0 and none["median"] is None and none.p95 is None


def test_skipped_is_never_counted_as_zero(spark):
    rows = spark.createDataFrame([("d", "s", "b", "Known", "c", "SUCCESS", 10.0, 1), ("d", "s", "b", "Known", "c", "SKIPPED", 0.0, 2), ("d", "s", "b", "Known", "c", "SUCCESS", None, 3)], "dataset_fp string, scope string, build string, commit_state string, commit string, run_status string, wall_ms double, run_id long")
    top = cohorts.rollup(rows).where("level = 'dataset'").first()
    assert (top.observed, top.eligible, top.excluded, top["mean"]) == (3, 1, 2, 10.0)


def test_no_task_gathers_a_journal(spark):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    out = queries()["src05_journal_replay"](spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and not re.search(r"windowspecdefinition\(journal#\d+, specified", plan)
    db = duckdb.connect()
    for name in ("orders", "lineitem", "customer"):
        db.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    row = lambda r: (*r[:-1], round(float(r[-1]), 6))
    assert sorted(row(r) for r in out.collect()) == sorted(row(r) for r in db.sql(oracle_sql()["src05_journal_replay"]).fetchall())
