"""Scalar functions on paths, versions, times, durations and settings (FLT-01, FLT-02, FLT-08, FLT-10, FLT-11, FLT-15, FN-04..09, FN-11..13,
FN-15, FN-18..20, FN-22, FN-23, PRJ-02, PRJ-07, PRJ-08, SNK-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import col

#: File extensions by media kind.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "wmv")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "gif", "tif", "tiff")
UNKNOWN, IMAGE, VIDEO = 0, 1, 2


def media_kind(path: Column | str) -> Column:
    """FLT-01: 1 image, 2 video, 0 neither, by the extension in any case."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./\\]*)$", 1))
    return F.when(ext.isin(*VIDEO_EXTENSIONS), VIDEO).when(ext.isin(*IMAGE_EXTENSIONS), IMAGE).otherwise(UNKNOWN)


def in_scope(kind: Column | str, scope: str) -> Column:
    """FLT-02: whether a file belongs to a scan of `images`, `videos` or `all` media."""
    k = col(kind)
    return {"images": k == IMAGE, "videos": k == VIDEO}.get(scope, k != UNKNOWN)


def duration_gate(a: Column | str, b: Column | str) -> Column:
    """FLT-08: unknown, under a second, or at most four times as long."""
    a, b = col(a), col(b)
    short, long = F.least(a, b), F.greatest(a, b)
    return (short <= 0) | (short < 1.0) | (long / short <= 4.0)


def duration_band(a: Column | str, b: Column | str) -> Column:
    """FLT-10: 90 s apart at most if either lasts under 20 minutes, else a ratio of at most 1.2; unknown ones fail."""
    a, b = col(a), col(b)
    short, long = F.least(a, b), F.greatest(a, b)
    return (short > 0) & F.when(short < 1200, long - short <= 90).otherwise(long / short <= 1.2)


def low_information(sd: Column | str) -> Column:
    """FLT-11: too flat a frame to match."""
    return col(sd) < 6.0


def canonical_path(path: Column | str) -> Column:
    """FN-05: forward slashes, none doubled or at the end, no leading ./"""
    p = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "(?<=.)/$", "")


def within_root(path: Column | str, root: Column | str) -> Column:
    """FLT-15: the root itself or below it."""
    p, r = canonical_path(path), canonical_path(root)
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def source_label(root: Column | str) -> Column:
    """FN-06: the last part of a path in letters, digits, dot, dash and underscore, others as underscores, none of them or
    of dots at the end, 48 characters at most; 'root' if nothing is left."""
    base = F.regexp_extract(col(root), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(F.when(base == "", "root").otherwise(base), r"[^A-Za-z0-9._-]", "_"), r"[_.]+$", "")
    return F.substring(F.when(clean == "", "root").otherwise(clean), 1, 48)


def safe_suite(suite: Column | str) -> Column:
    """FN-06: whether a suite id may name a folder."""
    return F.coalesce(col(suite).rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def semver(version: Column | str) -> Column:
    """FN-07: three numbers; what can't be read counts as 0."""
    parts = F.split(F.coalesce(col(version), F.lit("")), r"\.")
    return F.array(*[F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), F.lit(0)) for k in (1, 2, 3)])


def semver_less(a: Column | str, b: Column | str) -> Column:
    return semver(a) < semver(b)


def stamp(text: Column | str) -> Column:
    """FN-08: strict UTC stamps as epoch seconds, else null."""
    t = F.when(col(text).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.replace(F.replace(col(text), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")))
    return F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))


def json_string(text: Column | str) -> Column:
    """FN-09: a JSON string literal of the text, null as null."""
    whole = F.to_json(F.struct(col(text).alias("t")))
    return F.when(col(text).isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def round6(x: Column | str) -> Column:
    """FN-11: six decimals, half away from zero; what isn't finite is 0."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.round(x, 6))


#: Longest video (seconds) and seconds between its samples; cohort limits in seconds; frames kept by cohort.
SAMPLING_TIERS = ((10, 1), (60, 2), (240, 4), (960, 8), (3840, 16))
COHORT_LIMITS = (15, 60, 180, 600, 1500, 3600, 9000)
KEPT_FRAMES = (5, 8, 9, 12, 11, 10, 12, 14)


def sampling_step(duration: Column | str) -> Column:
    """FN-12: seconds between samples, doubling with the length of the video; 32 beyond the tiers."""
    d = col(duration)
    out = F.when(d <= 0, 0)
    for limit, step in SAMPLING_TIERS:
        out = out.when(d <= limit, step)
    return out.otherwise(32)


def sampling_grid(duration: Column | str) -> Column:
    """FN-12: sample times in steps from 0, and the end if the last step falls short of it by a millisecond."""
    d, step = col(duration).cast("double"), sampling_step(duration)
    n = F.ceil(d / F.when(step > 0, step)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k * step).cast("double"))
    full = F.when(F.element_at(grid, -1) < d - 0.001, F.concat(grid, F.array(d))).otherwise(grid)
    return F.when(d > 0, full).otherwise(F.array().cast("array<double>"))


def sample_union(plans: Column | str, duration: Column | str, cap: int = 10_000) -> Column:
    """SET-05: times of several plans, clamped to the video, in order, those within a millisecond of the one before left
    out, `cap` at most."""
    d = col(duration).cast("double")
    clamped = F.array_sort(F.transform(F.flatten(col(plans)), lambda t: F.least(F.greatest(t, F.lit(0.0)), d)))
    merged = F.aggregate(clamped, F.array().cast("array<double>"), lambda out, t: F.when((F.size(out) > 0) & (t - F.try_element_at(out, F.lit(-1)) < 1e-3), out).otherwise(F.concat(out, F.array(t))))
    return F.slice(merged, 1, cap)


def duration_cohort(duration: Column | str) -> Column:
    """FN-13: cohort 0 (G1, also unknown) to 7 (G8) by length."""
    d = col(duration)
    out = F.when(~(d > 0), 0)
    for k, limit in enumerate(COHORT_LIMITS):
        out = out.when(d <= limit, k)
    return out.otherwise(len(COHORT_LIMITS))


def kept_target(duration: Column | str) -> Column:
    """FN-13: frames to keep in a cohort."""
    return F.element_at(F.array(*[F.lit(x) for x in KEPT_FRAMES]), duration_cohort(duration) + 1)


def anchor_plan(duration: Column | str) -> Column:
    """FN-15: one anchor a second for four hours at most, and the end."""
    d = col(duration).cast("double")
    n = F.ceil(F.least(d, F.lit(14400.0))).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k.cast("double"))
    full = F.when(F.element_at(grid, -1) < d - 1e-3, F.concat(grid, F.array(d))).otherwise(grid)
    return F.when(d > 0, full).otherwise(F.array().cast("array<double>"))


def provenance(commit: Column | str) -> Column:
    """PRJ-02: a commit's state."""
    c = col(commit)
    return F.when(c.isNull() | (c == ""), "Legacy").when(c == "unknown", "Unknown").otherwise("Known")


def dataset_state(fingerprint: Column | str) -> Column:
    """PRJ-02: a dataset identity's state."""
    f = col(fingerprint)
    return F.when(f.isNull(), "Missing").when(f == "", "Empty").otherwise("Valid")


def human_size(n: Column | str) -> Column:
    """PRJ-08: bytes with a unit: KB with one decimal, MB and GB with two."""
    n = col(n).cast("double")
    return F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def ellipsis_middle(text: Column | str, width: int) -> Column:
    """PRJ-08: the ends of a text too long for the width."""
    t, left = col(text), (width - 3 + 1) // 2
    right = width - 3 - left
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, left), F.lit("..."), F.right(t, F.lit(right)) if right else F.lit("")))


def load_class(cpu: Column | str, memory: Column | str, gpu: Column | str) -> Column:
    """FN-20: the machine's load from percentages; a negative one of the GPU is unknown."""
    c, m, g = col(cpu), col(memory), F.greatest(col(gpu), F.lit(0))
    peak = F.greatest(c, g)
    return (
        F.when((m >= 95) | (c >= 92) | (g >= 95), "Critical").when((peak >= 80) | (m >= 90), "Heavy")
        .when((peak >= 55) | (m >= 80), "Busy").when((peak >= 25) | (m >= 65), "Light").otherwise("Idle")
    )


def analysis_allowed(cpu, memory, gpu, cpu_budget, gpu_budget, gaming: bool = False) -> Column:
    """FN-20: light load, and room for the reserve under the policy's budgets."""
    reserve, load = (20.0 if gaming else 10.0), load_class(cpu, memory, gpu)
    room = (col(cpu) + reserve <= F.greatest(F.lit(5.0), col(cpu_budget))) & ((col(gpu) < 0) | (col(gpu) + reserve <= F.greatest(F.lit(5.0), col(gpu_budget))))
    return (col(memory) < 90) & room & ((load == "Idle") | ((load == "Light") & F.lit(not gaming)))


#: CPU and GPU budgets in percent by resource mode.
BUDGETS = {"Maximum": (90, 90), "High": (75, 75), "Balanced": (55, 60), "Gaming": (25, 25)}


def cpu_budget(mode: Column | str) -> Column:
    """FN-19: a mode's CPU budget; null for a custom one."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in BUDGETS.items() for x in (k, v[0])]), col(mode))


def workers(budget: Column | str, threads: Column | str) -> Column:
    """FN-19: threads within the budget, rounded up, one at least."""
    t = F.greatest(col(threads), F.lit(1))
    return F.greatest(F.lit(1), F.least(t, F.floor((t * col(budget) + 99) / 100)))


def gpu_batch(budget: Column | str, base: Column | str) -> Column:
    """FN-19: batch size within the budget, rounded up, one at least."""
    b = F.greatest(col(base), F.lit(1))
    return F.greatest(F.lit(1), F.floor((b * col(budget) + 99) / 100))


def verdict_score(valid_main: Column | str, consistent: Column | str, ending: Column | str) -> Column:
    """FN-23: 40 for each of up to two main segments, 10 for agreeing offsets, 10 for the ending; 100 at most."""
    score = F.least(col(valid_main), F.lit(2)) * 40.0 + col(consistent).cast("int") * 10.0 + col(ending).cast("int") * 10.0
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def verdict(valid_main, consistent, covered_failed, drifted, thin, odd_ratio, score) -> Column:
    """FN-23: drift, odd ratios, partial hits and thin evidence are never forced either way."""
    v = col(valid_main)
    return (
        F.when(col(drifted) | col(odd_ratio), "Uncertain").when((v >= 2) & col(consistent) & ~col(covered_failed) & (col(score) >= 87.5), "Dup")
        .when((v > 0) & col(covered_failed) | col(thin), "Uncertain").when(v == 0, "Diff").otherwise("Uncertain")
    )


def profile_match(known: Column, same_gpu_presence: Column, same_gpu: Column, cpu_disagrees: Column, expired: Column, same_rest: Column) -> Column:
    """FN-22: how far a stored performance profile fits this machine."""
    return F.when(~known, "Missing").when(~same_gpu_presence | ~same_gpu | cpu_disagrees, "Hard").when(expired, "Stale").when(~same_rest, "Soft").otherwise("Exact")


def seek_decision(codec_supported, codec_blocked, gop_confidence, gop_frames, fps, duration, samples) -> dict[str, Column]:
    """FN-18: sparse or sequential reading, why, and on what evidence: capability first, then confidence, then cost."""
    total, sparse = F.when(col(fps) > 0, col(fps) * col(duration)).otherwise(0.0), col(samples) * col(gop_frames) * 0.5
    conf, vague = col(gop_confidence), ~(col(gop_frames) > 0)
    rules = [
        (~col(codec_supported), "SparseSeekUnavailable", "SparseUnsupported", "EvidenceStrong"),
        (col(codec_blocked), "SequentialPreferred", "HEVCFallback", "EvidenceStrong"),
        (conf == "Unavailable", "SequentialPreferred", "GOPUnknown", "EvidenceMissing"),
        (conf == "Estimated", "SequentialPreferred", "GOPUnknown", "EvidenceLimited"),
        (vague, "SequentialPreferred", "ExactnessUnverified", "EvidenceLimited"),
        ((total <= 0) | (col(samples) == 0), "SequentialPreferred", "CostNotAdvantageous", "EvidenceMissing"),
        (sparse >= total, "SequentialPreferred", "CostNotAdvantageous", "EvidenceStrong"),
        (F.lit(True), "SparseSeekCandidate", "ExactSparseVerified", "EvidenceStrong"),
    ]

    def pick(k: int) -> Column:
        out = F.when(rules[0][0], rules[0][k])
        for r in rules[1:]:
            out = out.when(r[0], r[k])
        return out

    return {"decision": pick(1), "reason": pick(2), "evidence": pick(3), "sequential_work": total, "sparse_work": sparse}


def gpu_share(enabled, available, cpu_rate, gpu_rate, cpu_load, gpu_load, floor: float = 0.25, kill_at: float = 0.1) -> Column:
    """FN-21: percent of the work for the GPU: rates scaled by what load leaves of each; none at or under `kill_at`."""
    cpu = col(cpu_rate) * F.least(F.greatest((100 - col(cpu_load)) / 100, F.lit(floor)), F.lit(1.0))
    room = F.least(F.greatest((100 - col(gpu_load)) / 100, F.lit(0.0)), F.lit(1.0))
    gpu = col(gpu_rate) * room
    return F.when(~col(enabled) | ~col(available) | (col(gpu_rate) <= 0) | (room <= kill_at), 0.0).otherwise(gpu * 100.0 / (cpu + gpu))


def stale_index(root_exists: Column | str, last_scan_age_days: Column | str, folder_age_days: Column | str) -> Column:
    """SNK-13: whether an index may be deleted: its root gone, and a week since scan and change; unknown ages keep it."""
    a, b = col(last_scan_age_days), col(folder_age_days)
    return F.coalesce(~col(root_exists) & (a >= 7) & (b >= 7), F.lit(False))
