"""Time-series operators (WIN-01 to WIN-08, WIN-11, WIN-13, JN-17 to JN-19, AGG-26, SIM-16, STR-14 in batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import similarity


def scene_changes(frames: DataFrame, threshold: float = 25.0) -> DataFrame:
    """WIN-01: frames (key, ts, h) less similar than the threshold to the one before."""
    w = Window.partitionBy("key").orderBy("ts")
    return frames.withColumn("before", F.lag("h").over(w)).where(F.col("before").isNotNull() & (similarity("before", "h") < threshold)).select("key", "ts")


def frame_deltas(frames: DataFrame) -> DataFrame:
    """WIN-02: mean absolute difference of the arrays `pixels` of neighbouring frames; 0 for the first."""
    w = Window.partitionBy("key").orderBy("ts")
    before = F.lag("pixels").over(w)
    total = F.aggregate(F.zip_with("pixels", F.col("before"), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    return frames.withColumn("before", before).select("key", "ts", F.when(F.col("before").isNull(), 0.0).otherwise(total / F.size("pixels")).alias("delta"))


def rolling_rate(samples: DataFrame, seconds: int = 30) -> DataFrame:
    """WIN-03: at each sample (key, t seconds, units) the units of the last seconds over their span; -1 under two samples or without span."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-seconds, 0)
    span = F.col("t") - F.min("t").over(w)
    return samples.withColumn("rate", F.when((F.count(F.lit(1)).over(w) >= 2) & (span > 0), F.sum("units").over(w) / span).otherwise(-1.0))


def moving_average(samples: DataFrame, n: int) -> DataFrame:
    """WIN-04: mean of the last n known values (key, t, value); an unknown one clears the history and has none."""
    order = Window.partitionBy("key").orderBy("t")
    island = F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).over(order)
    last = Window.partitionBy("key", "island").orderBy("t").rowsBetween(1 - n, 0)
    return samples.withColumn("island", island).withColumn("average", F.when(F.col("value").isNotNull(), F.avg("value").over(last))).drop("island")


def kept_frames(frames: DataFrame, target: Column | int) -> DataFrame:
    """WIN-05: of (key, i, ts, sd) the frames to keep: the highest deviation of each of up to four equal stretches of time,
    the earliest on ties, then by falling deviation until the target."""
    n = F.lit(target) if isinstance(target, int) else target
    parts = F.least(F.lit(4), n)
    whole = Window.partitionBy("key")
    rows = frames.withColumn("n", n).withColumn("t0", F.min("ts").over(whole)).withColumn("t1", F.max("ts").over(whole))
    seg = F.when((F.col("t1") <= F.col("t0")) | (parts <= 1), 0).otherwise(F.least(parts - 1, F.floor((F.col("ts") - F.col("t0")) / (F.col("t1") - F.col("t0")) * parts)))
    rows = rows.withColumn("seg", seg.cast("int"))
    best = F.row_number().over(Window.partitionBy("key", "seg").orderBy(F.desc("sd"), "i")) == 1
    rows = rows.withColumn("best", best)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best"), F.desc("sd"), "i"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n")).select("key", "i", "ts", "sd")


def kept_by_windows(frames: DataFrame, target: int, floor: float = 6.0) -> DataFrame:
    """WIN-06: as WIN-05 with detected windows (key, i, ts, sd, win), in their order, and never a frame under the floor."""
    rows = frames.where(F.col("sd") >= floor)
    rows = rows.withColumn("best", (F.row_number().over(Window.partitionBy("key", "win").orderBy(F.desc("sd"), "i")) == 1) & (F.col("win") < target))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best"), F.desc("sd"), "i"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= target).select("key", "i", "ts", "sd")


def kept_by_variance(frames: DataFrame, target: int, floor: float = 6.0) -> DataFrame:
    """WIN-07: frames over the floor, all if they are under 30 percent, the highest `target` if they are more."""
    w = Window.partitionBy("key")
    rows = frames.withColumn("good", F.col("sd") >= floor)
    rows = rows.withColumn("percent", F.floor(F.sum(F.col("good").cast("int")).over(w) * 100 / F.count(F.lit(1)).over(w)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("good"), F.desc("sd"), "i")))
    return rows.where((F.col("percent") < 30) | F.col("good") & (F.col("rank") <= target)).select("key", "i", "ts", "sd")


def cut_threshold(deltas: DataFrame) -> DataFrame:
    """AGG-26: per key of (key, delta) max(8, median + 3 * median absolute deviation)."""
    med = deltas.groupBy("key").agg(F.median("delta").alias("med"))
    dev = deltas.join(med, "key").withColumn("dev", F.abs(F.col("delta") - F.col("med")))
    return dev.groupBy("key").agg(F.first("med").alias("med"), F.median("dev").alias("mad")).select("key", "med", "mad", F.greatest(F.lit(8.0), F.col("med") + 3 * F.col("mad")).alias("threshold"))


def scene_boundaries(deltas: DataFrame, threshold: DataFrame) -> DataFrame:
    """WIN-08: (key, ts) where the delta reaches the threshold a second or more after the boundary before; the first frame is
    one. A boundary depends on the last one, so each key's times are folded in order, the frames of one video."""
    rows = deltas.join(threshold.select("key", "threshold"), "key")
    ordered = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", (F.col("delta") >= F.col("threshold")).alias("cut")))).alias("f"))
    folded = F.aggregate("f", F.array().cast("array<double>"), lambda out, x: F.when((F.size(out) == 0) | x["cut"] & (x["ts"] - F.try_element_at(out, F.lit(-1)) >= 1.0), F.concat(out, F.array(x["ts"].cast("double")))).otherwise(out))
    return ordered.select("key", F.explode(folded).alias("ts"))


def deviation_triggers(samples: DataFrame, threshold: float, repetitions: int) -> DataFrame:
    """WIN-11: (key, t) at every `repetitions`-th deviation in a row of (key, profile, t, live, expected); agreeing or invalid
    samples and another profile begin anew."""
    valid = (F.col("live") > 0) & (F.col("expected") > 0)
    off = F.coalesce(valid & (F.abs(F.col("live") - F.col("expected")) / F.col("expected") > threshold), F.lit(False))
    order = Window.partitionBy("key").orderBy("t")
    rows = samples.withColumn("off", off).withColumn("fresh", F.when(~F.col("off") | ~F.col("profile").eqNullSafe(F.lag("profile").over(order)), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order))
    run = F.sum(F.col("off").cast("int")).over(Window.partitionBy("key", "island").orderBy("t"))
    return rows.withColumn("run", run).where(F.col("off") & (F.col("run") % repetitions == 0)).select("key", "t")


def stride_anchors(frames: Column | str, most: int = 16) -> Column:
    """WIN-13: up to `most` fingerprints of an array at an even stride, zeros left out."""
    f = F.col(frames) if isinstance(frames, str) else frames
    stride = F.greatest(F.lit(1), F.ceil(F.size(f) / most)).cast("int")
    return F.filter(F.filter(f, lambda x, i: i % stride == 0), lambda x: x != 0)


def nearest_join(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """JN-17: for each left (key, lid, t) the nearest right (key, rid, s) within the tolerance, the earliest on ties.

    Times fall into buckets as wide as the tolerance, so a match is in the same bucket or a neighbour: an equi-join on
    (key, bucket), whose hot keys split by time, and a minimum per left row that folds before its exchange."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    a = left.withColumn("bucket", F.explode(F.array(bucket("t") - 1, bucket("t"), bucket("t") + 1)))
    b = right.withColumn("bucket", bucket("s"))
    hits = a.join(b, ["key", "bucket"]).where(F.abs(F.col("t") - F.col("s")) <= tolerance)
    best = hits.groupBy("key", "lid").agg(F.min(F.struct(F.abs(F.col("t") - F.col("s")).alias("d"), "s", "rid")).alias("m"))
    return best.select("key", "lid", F.col("m.rid").alias("rid"), F.col("m.d").alias("gap"))


def aligned_grids(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """JN-18: fine frames (key, ts) at a coarse time, to the millisecond, of the keys where the fine step is a whole part of the
    coarse one, three are kept and four fifths of the coarse times but the last are met."""
    step = lambda df, name: df.groupBy("key").agg((F.get(F.array_sort(F.collect_list("ts")), F.lit(1)) - F.min("ts")).alias(name))
    ratio = step(fine, "f").join(step(coarse, "c"), "key").where("f > 0").withColumn("k", F.col("c") / F.col("f")).where((F.col("k") >= 2) & (F.abs(F.col("k") - F.round("k")) <= 0.01)).select("key")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    last = coarse.groupBy("key").agg(F.max("ts").alias("end"), (F.count(F.lit(1)) - 1).alias("core"))
    c = coarse.join(last, "key").select("key", ms("ts").alias("ms"), (F.col("ts") < F.col("end")).alias("is_core"), "core")
    met = fine.withColumn("ms", ms("ts")).join(c, ["key", "ms"]).join(ratio, "key", "left_semi")
    good = met.groupBy("key").agg(F.count(F.lit(1)).alias("kept"), F.count_if("is_core").alias("hit"), F.first("core").alias("core")).where("kept >= 3 and core > 0 and hit * 5 >= core * 4").select("key")
    return met.join(good, "key", "left_semi").select("key", "ts")


def merged_plans(a: DataFrame, b: DataFrame) -> DataFrame:
    """JN-19: times of two plans (key, ts) in one, tagged 1, 2 or 3 for both; times equal to the millisecond are one."""
    ms = F.round(F.col("ts") * 1000).cast("long")
    x = a.select("key", ms.alias("ms"), F.col("ts").alias("a"))
    y = b.select("key", ms.alias("ms"), F.col("ts").alias("b"))
    tag = F.when(F.col("b").isNull(), 1).when(F.col("a").isNull(), 2).otherwise(3)
    return x.join(y, ["key", "ms"], "full_outer").select("key", F.coalesce("a", "b").alias("ts"), tag.alias("tag"))


def credit_runs(frames: DataFrame, least: float = 10.0) -> DataFrame:
    """SIM-16: the first stretch of at least ten seconds in the last two minutes of (key, ts, mean, delta, edge, low_info,
    duration) that is dark, still and rich in edges against the median of the first four fifths: (key, start, main_end)."""
    order = Window.partitionBy("key").orderBy("ts")
    rows = frames.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    head = rows.where((F.col("i") < F.floor(F.col("n") * 4 / 5)) & ~F.col("low_info")).groupBy("key").agg(F.expr("sort_array(collect_list(edge))").alias("e"))
    base = head.select("key", F.get("e", F.floor(F.size("e") / 2).cast("int")).alias("base"))
    tail = rows.where("ts >= duration - 120").join(base, "key")
    tail = tail.withColumn("dark", (F.col("mean") < 45) & (F.col("delta") < 3) & ~F.col("low_info") & (F.col("base") > 0.5) & (F.col("edge") > 1.5 * F.col("base")))
    tail = tail.withColumn("island", F.sum(F.when(F.col("dark"), 0).otherwise(1)).over(order)).withColumn("next", F.coalesce(F.lead("ts").over(order), F.col("duration")))
    runs = tail.where("dark").groupBy("key", "island").agg(F.min("ts").alias("start"), F.max("next").alias("stop")).where(F.col("stop") - F.col("start") >= least)
    return runs.groupBy("key").agg(F.min("start").alias("start")).select("key", "start", F.greatest(F.lit(0.0), F.col("start") - 5).alias("main_end"))


def published(changes: DataFrame, hold: float) -> DataFrame:
    """STR-14: (key, t, value) that differ from the value published last, `hold` seconds after it at the earliest. Each key's
    samples are folded in order."""
    ordered = changes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
    kind = "array<struct<t:double,value:string>>"
    last = lambda out: F.try_element_at(out, F.lit(-1))
    folded = F.aggregate("s", F.array().cast(kind), lambda out, x: F.when((F.size(out) == 0) | (last(out)["value"] != x["value"]) & (x["t"] - last(out)["t"] >= hold), F.concat(out, F.array(F.struct(x["t"].cast("double").alias("t"), x["value"].alias("value"))))).otherwise(out))
    return ordered.select("key", F.inline(folded))
