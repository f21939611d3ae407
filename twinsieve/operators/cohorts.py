"""Benchmark analytics: statistics, cohorts, comparison (AGG-01 to AGG-09, AGG-11, AGG-12, JN-20 to JN-22, FLT-16, PRJ-06, SRT-08).

Facts: runs(run_id, dataset_fp, scope, build, commit_state, commit, run_status, wall_ms), cases(run_id, case_id, path,
status, elapsed_ms), modes(run_id, case_id, requested_mode, effective_mode, status, elapsed_ms). Absent is never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..session import checkpointed

STATUSES = ("SUCCESS", "FAILED", "CANCELLED", "SKIPPED")
#: Order of modes.
MODE_RANK = {"AUTO": 0, "CPU": 1, "CUDA": 2}
GROUPING_KEY = ("dataset_fp", "scope", "build", "commit_state", "commit")
STATISTICS = ("min", "max", "mean", "median", "p95")


def exclusion(status: Column | str, value: Column | str) -> Column:
    """FLT-16: why a sample doesn't count; null if it does."""
    s = F.col(status) if isinstance(status, str) else status
    v = F.col(value) if isinstance(value, str) else value
    return F.when(s.isNull(), "Invalid").when(s != "SUCCESS", F.initcap(F.lower(s))).when(v.isNull(), "MissingElapsed")


def case_exclusion(case_status: str, mode_status: str) -> Column:
    """AGG-05: of a case seen under a mode: the case's own status first, then the mode's."""
    return F.coalesce(exclusion(case_status, F.lit(0)), exclusion(mode_status, F.lit(0)))


def statistics(value: Column | str) -> list[Column]:
    """AGG-01: of the values that are not null: count, extremes, mean, median (mean of the middle two), p95 by nearest rank."""
    v = value if isinstance(value, str) else "value"
    return [
        F.count(v).alias("n"), round6(F.min(v)).alias("min"), round6(F.max(v)).alias("max"), round6(F.avg(v)).alias("mean"),
        round6(F.median(v)).alias("median"), round6(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {v})")).alias("p95"),
    ]


def accounting(reason: str = "reason") -> list[Column]:
    """AGG-04: observed = eligible + excluded."""
    r = F.col(reason)
    return [F.count(F.lit(1)).alias("observed"), F.count_if(r.isNull()).alias("eligible"), F.count_if(r.isNotNull()).alias("excluded")]


def grouped(runs: DataFrame) -> GroupedData:
    """PRJ-06: runs by all that tells their cohorts apart; nulls are a value of their own."""
    return runs.groupBy(*GROUPING_KEY)


def rollup(runs: DataFrame) -> DataFrame:
    """AGG-02, AGG-04: wall times of runs by dataset, by (dataset, scope) and by (dataset, scope, build, commit state, commit)."""
    rows = runs.withColumn("reason", exclusion("run_status", "wall_ms")).withColumn("value", F.when(F.col("reason").isNull(), F.col("wall_ms")))
    cols = [F.col(k) for k in GROUPING_KEY]
    out = rows.groupingSets([cols[:1], cols[:2], cols], *cols).agg(F.grouping_id().alias("gid"), *accounting(), *statistics("value"))
    level = F.when(F.col("gid") == 15, "dataset").when(F.col("gid") == 7, "scope").otherwise("build")
    return out.withColumn("level", level).drop("gid")


def mode_stats(modes: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG-02: elapsed times of mode results at build level."""
    rows = modes.join(runs.select("run_id", "dataset_fp", "scope", "build"), "run_id").withColumn("reason", exclusion("status", "elapsed_ms")).withColumn("value", F.when(F.col("reason").isNull(), F.col("elapsed_ms")))
    return rows.groupBy("dataset_fp", "scope", "build", "requested_mode", "effective_mode").agg(*accounting(), *statistics("value"))


def status_tally(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """AGG-03: counts by status."""
    return rows.groupBy(*by, F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def exclusion_tally(rows: DataFrame, by: list[str]) -> DataFrame:
    """AGG-04, AGG-11: excluded samples by reason."""
    return rows.where("reason is not null").groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def case_rollup(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG-06: per (dataset, case) statistics and the first path that isn't empty, by run."""
    rows = cases.join(runs.select("run_id", "dataset_fp"), "run_id").withColumn("reason", exclusion("status", "elapsed_ms")).withColumn("value", F.when(F.col("reason").isNull(), F.col("elapsed_ms")))
    first = F.min_by("path", F.when(F.coalesce("path", F.lit("")) != "", F.col("run_id"))).alias("path")
    return rows.groupBy("dataset_fp", "case_id").agg(first, *accounting(), *statistics("value"))


def colliding_runs(runs: DataFrame) -> DataFrame:
    """AGG-07: runs, distinct run ids, and rows that share their run id with another."""
    per = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("distinct_runs"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))


def cohort_members(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """AGG-08: per cohort its sorted distinct members."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("members"))


def case_status(modes: DataFrame) -> DataFrame:
    """AGG-09: a case's status from its modes: cancelled before failed before success before skipped."""
    is_ = lambda s: F.bool_or(F.col("status") == s)
    return modes.groupBy("run_id", "case_id").agg(F.when(is_("CANCELLED"), "CANCELLED").when(is_("FAILED"), "FAILED").when(is_("SUCCESS"), "SUCCESS").otherwise("SKIPPED").alias("status"))


def _pairs(side: DataFrame, same: list[str], differ: list[str], metric: str, dimension: str) -> DataFrame:
    """Pairs of cohorts equal in `same`, in order of `differ`, with null-safe equality."""
    keys = same + differ
    a = side.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("n").alias("l_n"))
    b = side.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("n").alias("r_n"))
    on = reduce(lambda x, y: x & y, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in same])
    before = F.struct(*[F.col(f"l_{k}") for k in differ]) < F.struct(*[F.col(f"r_{k}") for k in differ])
    return a.join(b, on & before).withColumn("metric", F.lit(metric)).withColumn("dimension", F.lit(dimension))


def eligibility(dimension: Column, same_build: Column, commits_known: Column, l_n: Column, r_n: Column, same_mode: Column) -> Column:
    """JN-22: whether two sides of one dataset, scope and metric may be compared, and if not why."""
    empty = (l_n == 0) | (r_n == 0)
    build = F.when(~same_mode, "MismatchedMode").when(same_build, "SameProvenance").when(~commits_known, "MissingProvenance").when(empty, "NoComparableSamples").otherwise("Eligible")
    mode = F.when(~same_build, "MismatchedMode").when(same_mode, "SameProvenance").when(empty, "NoComparableSamples").otherwise("Eligible")
    return F.when(dimension == "BuildProvenance", build).otherwise(mode)


def comparison_candidates(runs: DataFrame, modes: DataFrame, cases: DataFrame) -> DataFrame:
    """JN-20: pairs worth comparing within a dataset and scope: builds by run time, builds by one mode's time, modes within a
    build by mode time and by case time, builds by case time of a mode. Cohorts are aggregated, each kind once, before they
    are paired: as a checkpoint, a row a cohort."""
    build = ["build", "commit_state", "commit"]
    base = ["dataset_fp", "scope"]
    mode = ["requested_mode", "effective_mode"]
    r = runs.withColumn("ok", exclusion("run_status", "wall_ms").isNull())
    run_side = r.groupBy(*base, *build).agg(F.count_if("ok").alias("n"))
    m = modes.join(runs.select("run_id", *base, *build), "run_id")
    mode_side = checkpointed(m.groupBy(*base, *build, *mode).agg(F.count_if(exclusion("status", "elapsed_ms").isNull()).alias("n")))
    c = m.withColumnRenamed("status", "m_status").drop("elapsed_ms").join(cases.select("run_id", "case_id", F.col("status").alias("c_status")), ["run_id", "case_id"])
    case_side = checkpointed(c.groupBy(*base, *build, *mode).agg(F.count_if(case_exclusion("c_status", "m_status").isNull()).alias("n")))
    parts = [
        _pairs(run_side, base, build, "RunWall", "BuildProvenance"),
        _pairs(mode_side, base + mode, build, "ModeElapsed", "BuildProvenance"),
        _pairs(mode_side, base + build, mode, "ModeElapsed", "ModeSemantics"),
        _pairs(case_side, base + build, mode, "CaseElapsed", "ModeSemantics"),
        _pairs(case_side, base + mode, build, "CaseElapsed", "BuildProvenance"),
    ]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    same_mode = F.col("l_requested_mode").eqNullSafe(F.col("r_requested_mode")) & F.col("l_effective_mode").eqNullSafe(F.col("r_effective_mode"))
    same_build = F.col("l_build").eqNullSafe(F.col("r_build")) & F.col("l_commit_state").eqNullSafe(F.col("r_commit_state")) & F.col("l_commit").eqNullSafe(F.col("r_commit"))
    known = (F.col("l_commit_state") == "Known") & (F.col("r_commit_state") == "Known")
    return both.withColumn("eligibility", eligibility(F.col("dimension"), same_build, known, F.col("l_n"), F.col("r_n"), same_mode))


def comparison_metrics(pairs: DataFrame) -> DataFrame:
    """AGG-12, JN-21: of pairs with l_ and r_ statistics, for each statistic the difference, the difference in percent of the
    left and the ratio; a left value of 0 has a difference only; absent values leave all null and say why."""
    stacked = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"l_{s}").alias("left_value"), F.col(f"r_{s}").alias("right_value")) for s in STATISTICS]))
    keys = [c for c in pairs.columns if c not in {f"{p}_{s}" for p in "lr" for s in STATISTICS}]
    rows = pairs.select(*keys, stacked.alias("x")).select(*keys, "x.*")
    l, r = F.col("left_value"), F.col("right_value")
    over = F.when(l != 0, l)
    why = F.when(l.isNull() & r.isNull(), "BothStatisticsAbsent").when(l.isNull(), "LeftStatisticAbsent").when(r.isNull(), "RightStatisticAbsent").when(l == 0, "ZeroLeftReference")
    return rows.select(*keys, "statistic", "left_value", "right_value", F.round(r - l, 6).alias("delta_ms"), F.round((r - l) / over * 100.0, 6).alias("delta_percent"), F.round(r / over, 6).alias("ratio"), why.alias("unavailable"))


def mode_order(mode: Column | str) -> Column:
    """SRT-08: AUTO before CPU before CUDA."""
    m = F.col(mode) if isinstance(mode, str) else mode
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MODE_RANK.items() for x in kv]), m), F.lit(99))
