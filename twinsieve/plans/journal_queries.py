"""Queries of benchmark sessions, run facts and stored sets over whole driver tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, cohorts, hamming
from ..session import checkpointed
from ..sources import journal
from .queries import PAIRS3, QUERIES, SQL, query
from .tables import FACTS_SQL, FILES_SQL, FP_SQL, LATER_SQL, cases, later_media, media, modes, runs, table, text_fingerprints


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: each starts a run; open ones never end, pending ones are cancelled, some end before they start."""
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    begun = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    ended = F.timestamp_seconds(F.unix_timestamp(begun) + c % 100 - 10)
    none = F.lit(None).cast("string")
    both = o.select(
        F.col("o_orderpriority").alias("journal"), F.col("o_orderkey").cast("string").alias("runId"), none.alias("suiteId"), F.col("o_orderstatus").alias("mediaScope"), none.alias("buildVersion"),
        F.when(c % 5 == 0, none).when(c % 5 == 1, "").otherwise("fp").alias("datasetFingerprint"), F.when(c % 3 == 0, "").when(c % 3 == 1, "unknown").otherwise("abc").alias("gitCommit"), none.alias("completionReason"),
        stamp(begun).alias("startedAt"), stamp(ended).alias("completedAt"), F.col("o_orderkey"),
    )
    start = both.select("*", F.lit("run_started").alias("eventType"), none.alias("status"), (F.col("o_orderkey") * 4).alias("line_no"))
    over = both.where("mediaScope <> 'O'")
    end = over.select("*", F.when(F.col("mediaScope") == "P", "run_cancelled").otherwise("run_finished").alias("eventType"), F.lit("SUCCESS").alias("status"), (F.col("o_orderkey") * 4 + 2).alias("line_no"))
    return start.unionByName(end).drop("o_orderkey")


_RUNS = """r AS (SELECT o_orderkey::VARCHAR AS run_id, CASE o_orderstatus WHEN 'O' THEN 'Incomplete' WHEN 'P' THEN 'Cancelled' ELSE 'Complete' END AS run_class, CASE o_custkey % 5 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Empty' ELSE 'Valid' END AS dataset_state,
  CASE o_custkey % 3 WHEN 0 THEN 'Legacy' WHEN 1 THEN 'Unknown' ELSE 'Known' END AS commit_state, CASE WHEN o_orderstatus <> 'O' THEN 'SUCCESS' END AS run_status,
  CASE WHEN o_orderstatus <> 'O' AND o_custkey % 100 >= 10 THEN (o_custkey % 100 - 10) * 1000.0::DOUBLE END AS wall_ms FROM orders)"""


@query(f"WITH {_RUNS} SELECT run_id, run_class, dataset_state, commit_state, run_status FROM r")
def prj01_run_classes(spark, sf):
    """PRJ-01, PRJ-02, SRC-07."""
    return journal.runs(_run_events(spark, sf)).select("run_id", "run_class", "dataset_state", "commit_state", "run_status")


@query(f"WITH {_RUNS} SELECT run_id, wall_ms FROM r")
def prj03_wall_times(spark, sf):
    """PRJ-03."""
    return journal.runs(_run_events(spark, sf)).select("run_id", "wall_ms")


@query("SELECT l_orderkey::VARCHAR AS run_id, l_linenumber::VARCHAR AS case_id, CASE WHEN l_orderkey % 2 = 0 THEN 100 END AS commit, CASE WHEN l_linestatus = 'O' THEN l_quantity END AS elapsed_ms FROM lineitem")
def prj04_mode_times(spark, sf):
    """PRJ-04, WIN-10: line items as mode results, committed in even orders and started where their status is O."""
    l = table(spark, sf, "lineitem")
    none, on = F.lit(None).cast("string"), F.col("l_linestatus") == "O"
    base = (F.lit("j").alias("journal"), F.col("l_orderkey").cast("string").alias("runId"), F.col("l_linenumber").cast("string").alias("caseId"), none.alias("path"), none.alias("media"), F.lit("SUCCESS").alias("status"), none.alias("requestedMode"), none.alias("effectiveMode"), on.alias("started"), on.alias("completed"), F.col("l_quantity").alias("elapsedMs"))
    events = l.select(F.lit("mode_result").alias("eventType"), F.lit(1).alias("line_no"), *base).unionByName(l.where("l_orderkey % 2 = 0").select(F.lit("case_complete").alias("eventType"), F.lit(100).alias("line_no"), *base))
    return journal.cases_and_modes(events)[1].select("run_id", "case_id", "commit", "elapsed_ms")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'measured' WHEN l_returnflag = 'R' THEN 'derived' ELSE 'missing' END AS origin FROM lineitem")
def prj05_value_origins(spark, sf):
    """PRJ-05."""
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", journal.value_origin(F.when(F.col("l_linestatus") == "O", q), F.when(F.col("l_returnflag") == "R", q)).alias("origin"))


@query(f"WITH {_RUNS} SELECT run_id, run_class = 'Complete' AND dataset_state = 'Valid' AS taken FROM r")
def flt14_analysable_runs(spark, sf):
    """FLT-14: the runs taken and the others."""
    taken, others = journal.analysable(checkpointed(journal.runs(_run_events(spark, sf))))
    return taken.select("run_id", F.lit(True).alias("taken")).unionByName(others.select("run_id", F.lit(False).alias("taken")))


@query(f"WITH {FACTS_SQL} SELECT run_id, case_id, requested_mode, effective_mode, elapsed_ms, CASE status WHEN 'FAILED' THEN 'Failed' WHEN 'SKIPPED' THEN 'Skipped' ELSE CASE WHEN elapsed_ms IS NULL THEN 'MissingElapsed' END END AS reason FROM modes")
def flt16_sample_admission(spark, sf):
    """FLT-16."""
    return modes(spark, sf).select("run_id", "case_id", "requested_mode", "effective_mode", "elapsed_ms", cohorts.exclusion("status", "elapsed_ms").alias("reason"))


@query(f"SELECT dimension, eligibility, sum(candidates)::BIGINT AS n FROM ({SQL['jn20_comparison_candidates']}) WHERE eligibility <> 'Eligible' GROUP BY ALL")
def agg11_rejections(spark, sf):
    """AGG-11, JN-22: rejected comparisons by reason."""
    c = cohorts.comparison_candidates(runs(spark, sf), modes(spark, sf), cases(spark, sf))
    return c.where("eligibility <> 'Eligible'").groupBy("dimension", "eligibility").agg(F.count(F.lit(1)).alias("n"))


_SUMMARY = f"WITH {FACTS_SQL}, s AS (SELECT run_id::VARCHAR AS run_id, count(*) AS cases, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in cohorts.STATUSES) + ", sum(elapsed_ms) AS total_ms FROM cases GROUP BY 1)"


def _summary(spark, sf):
    return journal.summary(cases(spark, sf).withColumn("run_id", F.col("run_id").cast("string")))


@query(f"""{_SUMMARY} SELECT run_id, json->>'runId' AS named, (json->'statuses'->>'FAILED')::BIGINT AS failed, (json->>'totalMs')::DOUBLE AS total_ms FROM (SELECT run_id, json_object('runId', run_id, 'statuses', json_object('FAILED', failed), 'totalMs', total_ms) AS json FROM s)""")
def snk06_summary_json(spark, sf):
    """SNK-06: summaries written as JSON and read again."""
    j = journal.summary_json(_summary(spark, sf))
    return j.select("run_id", F.get_json_object("json", "$.runId").alias("named"), F.get_json_object("json", "$.statuses.FAILED").cast("long").alias("failed"), F.get_json_object("json", "$.totalMs").cast("double").alias("total_ms"))


@query("SELECT o_orderpriority AS journal, o_orderkey::VARCHAR AS run_id, 1::BIGINT AS starts, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END::BIGINT AS ends, o_orderstatus <> 'O' AS sound FROM orders")
def snk16_run_records(spark, sf):
    """SNK-16: whether each run has exactly one start and one end."""
    return journal.run_records(_run_events(spark, sf))


@query(f"{_SUMMARY} SELECT * FROM s")
def snk17_recovered(spark, sf):
    """SNK-17: journals of one file a run replayed into summaries, without a scan."""
    c = cases(spark, sf)
    of = lambda kind, rid, *more: F.to_json(F.struct(F.lit(kind).alias("eventType"), rid.alias("recordId"), F.col("run_id").cast("string").alias("runId"), *more))
    commit = of("case_complete", F.col("case_id").cast("string"), F.col("case_id").cast("string").alias("caseId"), F.col("status"), F.col("elapsed_ms").alias("elapsedMs"))
    lines = c.select("run_id", "case_id", commit.alias("line")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "line"))).alias("l"))
    start = of("run_started", F.lit("start"))
    files = lines.select(F.col("run_id").cast("string").alias("journal"), F.concat(start, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    return journal.recover(checkpointed(journal.journal_lines(files)))


@query(f"""{_SUMMARY} SELECT run_id, 'cases    ' || cases || CASE WHEN success > 0 THEN chr(10) || 'success  ' || success ELSE '' END || CASE WHEN failed > 0 THEN chr(10) || 'failed   ' || failed ELSE '' END || CASE WHEN cancelled > 0 THEN chr(10) || 'cancelled ' || cancelled ELSE '' END
|| CASE WHEN skipped > 0 THEN chr(10) || 'skipped  ' || skipped ELSE '' END || CASE WHEN total_ms IS NOT NULL THEN chr(10) || 'seconds  ' || printf('%.2f', total_ms) ELSE '' END AS block FROM s""")
def snk19_console_blocks(spark, sf):
    """SNK-19: with times of thousand milliseconds a unit, so that seconds have no ties to round."""
    return _summary(spark, sf).withColumn("total_ms", F.col("total_ms") * 1000).select("run_id", journal.console_block().alias("block"))


@query(f"WITH {FP_SQL}, {PAIRS3} SELECT left_id AS \"left\", right_id AS \"right\", (64 - distance) * 100.0::DOUBLE / 64 AS percent FROM pairs")
def snk02_replaced_pairs(spark, sf):
    """SNK-02: pairs emitted in both directions, one with a lower percent, as the set to store."""
    p = checkpointed(hamming.hamming_pairs(text_fingerprints(table(spark, sf, "documents")), 3).select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), ((64 - F.col("distance")) * 100.0 / 64).alias("percent")))
    return changes.replace_pairs(p.unionByName(p.select(F.col("right").alias("left"), F.col("left").alias("right"), (F.col("percent") - 1).alias("percent"))))


@query(f"WITH {FILES_SQL}, {LATER_SQL} SELECT path, sha256 FROM files WHERE path IN (SELECT path FROM later)")
def snk09_pruned_cache(spark, sf):
    """SNK-09: content hashes of files that are still indexed."""
    return changes.prune_orphans(media(spark, sf, False).select("path", "sha256"), later_media(spark, sf))


@query(f"SELECT path, admitted_ms, started_ms FROM ({SQL['snk04_traces']}) WHERE finished_ms = 0")
def src10_unfinished_traces(spark, sf):
    """SRC-10."""
    return QUERIES["snk04_traces"](spark, sf).where("finished_ms = 0").select("path", "admitted_ms", "started_ms")


@query(f"WITH {FP_SQL}, {PAIRS3}, c AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT left_id AS \"left\", right_id AS \"right\", (64 - distance) * 100.0::DOUBLE / 64 AS percent FROM pairs WHERE left_id NOT IN (FROM c) AND right_id NOT IN (FROM c)")
def jn16_pruned_pairs(spark, sf):
    """JN-16, SET-02: stored pairs that touch no changed file, and none emitted anew."""
    p = checkpointed(hamming.hamming_pairs(text_fingerprints(table(spark, sf, "documents")), 3).select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), ((64 - F.col("distance")) * 100.0 / 64).alias("percent")))
    changed = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    return changes.survivors(p, changed, p.where("false"))
