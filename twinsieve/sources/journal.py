"""Benchmark journals: JSON lines to facts (SRC-04 to SRC-07, WIN-09, WIN-10, PRJ-01 to PRJ-05, FLT-14, AGG-10, SNK-05, SNK-06, SNK-16, SNK-17, SNK-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import dataset_state, provenance

#: The journal's event types.
EVENT_TYPES = ("run_started", "mode_result", "case_complete", "run_finished", "run_cancelled")
STATUSES = ("SUCCESS", "FAILED", "CANCELLED", "SKIPPED")
SCHEMA = (
    "eventType string, recordId string, suiteId string, runId string, caseId string, timestamp string, mediaScope string, datasetFingerprint string, buildVersion string, gitCommit string, "
    "startedAt string, completedAt string, completionReason string, requestedMode string, effectiveMode string, status string, started boolean, completed boolean, elapsedMs double, "
    "summary struct<scanned:bigint,analyzed:bigint,failed:bigint>, path string, media string, errorMessage string"
)


def read_journals(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-04: (journal, line_no, line) of every runs.jsonl under the folder; a journal ends with a line that has `last`
    set, empty if the file ends with a newline."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "runs.jsonl").text(folder, wholetext=True)
    return journal_lines(files.select(F.col("_metadata.file_path").alias("journal"), F.col("value").alias("content")))


def journal_lines(files: DataFrame) -> DataFrame:
    """Lines of (journal, content)."""
    parts = F.split("content", "\n", -1)
    lines = files.withColumn("n", F.size(parts)).select("journal", "n", F.posexplode(parts).alias("at", "line"))
    return lines.select("journal", (F.col("at") + 1).alias("line_no"), "line", (F.col("at") == F.col("n") - 1).alias("last"))


def field(line: Column | str, key: str) -> Column:
    """SRC-06: one field of a JSON line as text, null where it is absent."""
    return F.get_json_object(F.col(line) if isinstance(line, str) else line, f"$.{key}")


def replay(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-05, WIN-09: typed events and anomalies of each journal.

    An unterminated last line is dropped and told. The first complete line that can't be read or has an unknown type is
    fatal: nothing from it on counts. Of lines with one recordId the first counts, whatever run it is of. `line_no` is any
    column that orders a journal's lines."""
    full = lines.where(~F.col("last") & (F.col("line") != ""))
    tails = lines.where(F.col("last") & (F.col("line") != "")).select("journal", "line_no", F.lit("TruncatedTail").alias("kind"))
    typed = full.withColumn("e", F.from_json("line", SCHEMA))
    bad = F.col("e.eventType").isNull() | F.col("e.recordId").isNull() | ~F.col("e.eventType").isin(*EVENT_TYPES)
    # a minimum folds before its exchange; a window would gather each whole journal in one task
    stops = typed.where(bad).groupBy(F.col("journal").alias("stopped")).agg(F.min("line_no").alias("stop"))
    typed = typed.join(stops, F.col("journal").eqNullSafe(F.col("stopped")), "left").drop("stopped")
    fatal = typed.where("line_no = stop").select("journal", "line_no", F.lit("MidFileCorruption").alias("kind"))
    good = typed.where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    same = Window.partitionBy("journal", F.col("e.recordId")).orderBy("line_no")
    ranked = good.withColumn("rank", F.row_number().over(same)).withColumn("first", F.first("line").over(same))
    again = ranked.where("rank > 1").select("journal", "line_no", F.when(F.col("line") == F.col("first"), "DuplicateIdentical").otherwise("DuplicateConflicting").alias("kind"))
    events = ranked.where("rank = 1").select("journal", "line_no", "e.*")
    return events, tails.unionByName(fatal).unionByName(again)


def runs(events: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """SRC-07, PRJ-01 to PRJ-03: a row for each run that announced itself: its last start record, its last terminal record,
    states of provenance and dataset, wall time and class."""
    start, end = F.col("eventType") == "run_started", F.col("eventType").isin("run_finished", "run_cancelled")
    s = F.max_by(F.struct("suiteId", "datasetFingerprint", "mediaScope", "buildVersion", "gitCommit", "startedAt"), F.when(start, F.col("line_no")))
    e = F.max_by(F.struct("completedAt", "status", "completionReason"), F.when(end, F.col("line_no")))
    out = events.groupBy("journal", "runId").agg(s.alias("s"), e.alias("e"), F.bool_or(start).alias("started"), F.bool_or(end).alias("finished"), F.bool_or(F.col("eventType") == "run_cancelled").alias("cancelled"))
    out = out.where(F.col("started") & (F.col("runId") != ""))
    fatal = F.lit(False)
    if anomalies is not None:
        out = out.join(anomalies.where("kind = 'MidFileCorruption'").select("journal", F.lit(True).alias("fatal")), "journal", "left")
        fatal = F.coalesce("fatal", F.lit(False))
    run_class = F.when(fatal, "Corrupt").when(F.col("cancelled"), "Cancelled").when(~F.col("finished"), "Incomplete").otherwise("Complete")
    return out.select(
        "journal", F.col("runId").alias("run_id"), F.col("s.suiteId").alias("suite_id"), F.col("s.datasetFingerprint").alias("dataset_fp"), dataset_state("s.datasetFingerprint").alias("dataset_state"),
        F.col("s.mediaScope").alias("scope"), F.col("s.buildVersion").alias("build"), F.col("s.gitCommit").alias("commit"), provenance("s.gitCommit").alias("commit_state"),
        F.col("e.status").alias("run_status"), wall_ms("s.startedAt", "e.completedAt").alias("wall_ms"), run_class.alias("run_class"),
    )


def wall_ms(started: str, completed: str) -> Column:
    """PRJ-03: milliseconds between two local one-second stamps; null if unreadable or negative."""
    t = lambda c: F.unix_timestamp(F.try_to_timestamp(F.substring(F.col(c), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    ms = (t(completed) - t(started)) * 1000.0
    return F.when(ms >= 0, ms)


def cases_and_modes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN-10, PRJ-04: committed cases, and mode results with the line that commits them (null: an incomplete case). A mode
    that never started has no elapsed time."""
    w = Window.partitionBy("journal", "runId", "caseId").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    both = events.where(F.col("eventType").isin("mode_result", "case_complete"))
    both = both.withColumn("commit", F.min(F.when(F.col("eventType") == "case_complete", F.col("line_no"))).over(w))
    cases = both.where("eventType = 'case_complete'").select("journal", F.col("runId").alias("run_id"), F.col("caseId").alias("case_id"), "line_no", "path", "media", "status", F.col("elapsedMs").alias("elapsed_ms"))
    modes = both.where("eventType = 'mode_result'").select(
        "journal", F.col("runId").alias("run_id"), F.col("caseId").alias("case_id"), F.col("commit"), F.col("requestedMode").alias("requested_mode"), F.col("effectiveMode").alias("effective_mode"), "status", "started", "completed",
        F.when(F.col("started"), F.col("elapsedMs")).alias("elapsed_ms"),
    )
    return cases, modes


def value_origin(measured: Column, derived: Column) -> Column:
    """PRJ-05: where a value comes from."""
    return F.when(measured.isNotNull(), "measured").when(derived.isNotNull(), "derived").otherwise("missing")


def analysable(runs_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-14: complete runs on a valid dataset, and the others."""
    good = (F.col("run_class") == "Complete") & (F.col("dataset_state") == "Valid")
    return runs_.where(good), runs_.where(~good)


def summary(cases: DataFrame) -> DataFrame:
    """AGG-10, SNK-06: per run committed cases, counts by status and total time."""
    count = lambda s: F.count_if(F.col("status") == s)
    return cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases"), *[count(s).alias(s.lower()) for s in STATUSES], F.sum("elapsed_ms").alias("total_ms"))


def summary_json(rows: DataFrame) -> DataFrame:
    """SNK-06: each run's summary as a JSON text; a time that is absent has no field."""
    statuses = F.struct(*[F.col(s.lower()).alias(s) for s in STATUSES])
    return rows.select("run_id", F.to_json(F.struct(F.col("run_id").alias("runId"), "cases", statuses.alias("statuses"), F.col("total_ms").alias("totalMs"))).alias("json"))


def console_block() -> Column:
    """SNK-19: a summary's lines for a console: cases, the statuses that occur, and seconds with two decimals if known."""
    line = lambda name, value: F.concat(F.lit(f"{name:<9}" if len(name) < 9 else name + " "), value)
    counts = [F.when(F.col(s.lower()) > 0, line(s.lower(), F.col(s.lower()).cast("string"))) for s in STATUSES]
    seconds = F.when(F.col("total_ms").isNotNull(), line("seconds", F.format_string("%.2f", F.col("total_ms") / 1000)))
    return F.concat_ws("\n", line("cases", F.col("cases").cast("string")), *counts, seconds)


def run_records(events: DataFrame) -> DataFrame:
    """SNK-16: per run its start and end records; a session is sound with exactly one of each."""
    starts, ends = F.count_if(F.col("eventType") == "run_started"), F.count_if(F.col("eventType").isin("run_finished", "run_cancelled"))
    counted = events.groupBy("journal", F.col("runId").alias("run_id")).agg(starts.alias("starts"), ends.alias("ends"))
    return counted.withColumn("sound", (F.col("starts") == 1) & (F.col("ends") == 1))


def recover(lines: DataFrame, run: str | None = None) -> DataFrame:
    """SNK-17, SNK-16: the summary of journals replayed, of one run if it is named. A journal corrupt in its middle is refused."""
    events, anomalies = replay(lines)
    broken = anomalies.where("kind = 'MidFileCorruption'").select("journal", "line_no").first()
    if broken:
        raise ValueError(f"journal {broken[0]} is corrupt at line {broken[1]}")
    return summary(cases_and_modes(events if run is None else events.where(F.col("runId") == run))[0])


def record_id(*parts: Column | str) -> Column:
    """SNK-05: the same record always has the same id."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def write_journal(events: DataFrame, path: str) -> None:
    """SNK-05: events as JSON lines; Spark's committer makes the folder appear whole or not at all (SNK-07)."""
    events.write.mode("append").json(path)
