"""The real-time monitor on Structured Streaming (STR-01 to STR-15, JN-06).

File events come in as rows (path, action, size, modified, t) and are folded per path: a path is stable once its size and
time have not changed for some seconds of event time; a removal after it takes it out. State is one row per pending path
in the state store, restored from the checkpoint after a loss. Stable files are probed against the static index in
`foreachBatch`, which is idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "path string, action string, size long, modified long, t timestamp"
OUTPUT = "path string, event_type string, size long, modified long, t timestamp, detail string"
STATE = "size long, modified long, since double, tries int, due double"


def file_events(spark: SparkSession, folder: str, per_trigger: int = 256) -> DataFrame:
    """STR-01, STR-10: new files under a folder as events; `per_trigger` bounds what one batch takes, which is the queue's
    back-pressure."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", F.lit("modify").alias("action"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.current_timestamp().alias("t"))


def backoff(base_ms: int, tries: int) -> float:
    """STR-04: milliseconds until the next try: doubled each time up to 32 times the base, 30 s at most."""
    return min(30_000, base_ms * 2 ** min(5, max(0, tries - 1)))


def _settle(stable_seconds: float, base_ms: int, max_retries: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, out = key[0], []

        def emit(kind: str, t, size=None, modified=None, detail: str = "") -> None:
            out.append((path, kind, size, modified, t, detail))

        size, modified, since, tries, due = state.get if state.exists else (None, None, None, 0, 0.0)
        if state.hasTimedOut:
            emit("Detected", pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), size, modified)
            state.remove()
        else:
            events = pd.concat(list(batches)).sort_values(["t", "action"], kind="stable")
            for e in events.itertuples():
                now = e.t.timestamp()
                if e.action == "remove":  # STR-02, STR-06: takes the place of whatever was pending
                    emit("Removed", e.t)
                    size = modified = since = None
                    tries = 0
                elif e.action == "busy":  # STR-04: could not be read; try again later
                    tries += 1
                    if max_retries and tries > max_retries:
                        emit("Error", e.t, detail="retry limit reached")
                        size = modified = since = None
                        tries = 0
                    else:
                        due = now + backoff(base_ms, tries) / 1000
                        emit("Deferred", e.t, detail=f"try {tries}")
                elif since is None or (e.size, e.modified) != (size, modified):  # STR-03: any change starts anew
                    size, modified, since = int(e.size), int(e.modified), now
                elif now - since >= stable_seconds and now >= due:
                    emit("Detected", e.t, size, modified)
                    size = modified = since = None
                    tries, due = 0, 0.0
            if since is None and not tries:
                if state.exists:
                    state.remove()
            else:
                state.update((size, modified, since, tries, due))
                if since is not None:
                    state.setTimeoutTimestamp(int(max(since + stable_seconds, due) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"size": "Int64", "modified": "Int64"})

    return step


def settled(events: DataFrame, stable_seconds: float = 3.0, late: str = "10 seconds", base_ms: int = 500, max_retries: int = 5) -> DataFrame:
    """STR-02 to STR-05, STR-08: per path Detected once stable (by a later event or when the watermark passes), Removed,
    Deferred and Error."""
    marked = events.withWatermark("t", late)
    return marked.groupBy("path").applyInPandasWithState(_settle(stable_seconds, base_ms, max_retries), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def probe(fresh: DataFrame, index: DataFrame, percent: float = 90.0) -> DataFrame:
    """STR-07, JN-07: (q, id, percent) of new fingerprints (q, h) against indexed ones (id, h), surest first per file."""
    from ..functions.hashes import distance_of
    from ..operators.hamming import hamming_probe

    hits = hamming_probe(fresh, index, distance_of(percent))
    return hits.select("q", "id", ((64 - F.col("distance")) * 100.0 / 64).alias("percent")).where(F.col("percent") >= percent)


def match_new(batch: DataFrame, history: DataFrame, max_distance: int) -> DataFrame:
    """JN-06: pairs of a batch (id, h) with the history and within itself, each once."""
    from ..operators.hamming import hamming_pairs, hamming_probe

    old = hamming_probe(batch.select(F.col("id").alias("q"), "h"), history.join(batch.select("id"), "id", "left_anti"), max_distance)
    old = old.select(F.least("q", "id").alias("left_id"), F.greatest("q", "id").alias("right_id"), "distance")
    return old.unionByName(hamming_pairs(batch, max_distance))


class IncrementalMatcher:
    """STR-11 to STR-13, JN-06: matches arrivals in micro-batches; the pairs equal those of one batch over everything.

    Each batch writes its rows and pairs under its own id, replacing what an interrupted try has left, and reads only
    batches of smaller ids as history, so a replayed batch gives the same result. Pairs are stored by fingerprints, as chunks
    of ids whose pairs are made when they are read."""

    def __init__(self, folder: str, max_distance: int = 3) -> None:
        self.folder, self.max_distance = folder, max_distance

    def _read(self, spark: SparkSession, kind: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema + ", batch long").parquet(f"{self.folder}/{kind}")
        except Exception as e:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema + ", batch long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("id", "h").dropDuplicates(["id"]).persist()
        history = self._read(spark, "index", "id long, h long").where(F.col("batch") < batch_id).select("id", "h")
        from ..operators.hamming import _once, arrivals_in_chunks

        if _once(history, "id"):
            pairs = arrivals_in_chunks(fresh, history, self.max_distance)
        else:  # an id that came again with another fingerprint: the smallest distance counts
            pairs = match_new(fresh, history, self.max_distance).select("distance", F.array("left_id").alias("xs"), F.array("right_id").alias("ys"), F.lit(False).alias("same"))
        pairs.write.mode("overwrite").parquet(f"{self.folder}/pairs/batch={batch_id}")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/index/batch={batch_id}")
        fresh.unpersist()

    def pairs(self, spark: SparkSession) -> DataFrame:
        from ..operators.hamming import expanded

        return expanded(self._read(spark, "pairs", "distance int, xs array<long>, ys array<long>, same boolean"))


def rolling_units(samples: DataFrame, seconds: int = 30) -> DataFrame:
    """WIN-03, AGG-25 on a stream of (key, t timestamp, units): sums, counts and means per sliding window."""
    w = F.window("t", f"{seconds} seconds", f"{max(1, seconds // 3)} seconds")
    return samples.withWatermark("t", f"{seconds} seconds").groupBy("key", w).agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("samples"), F.avg("units").alias("mean"))


def stalls(beats: DataFrame, seconds: int) -> DataFrame:
    """STR-15: sessions of activity of (key, t): a gap of the given length ends one; its end is when the stall began."""
    s = F.session_window("t", f"{seconds} seconds")
    out = beats.withWatermark("t", f"{seconds} seconds").groupBy("key", s).agg(F.count(F.lit(1)).alias("beats"), F.max("t").alias("last"))
    return out.select("key", F.col("last").alias("stalled_after"), "beats")


def start(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """STR-09: runs a stream into `sink`; stopping it and starting with the same checkpoint is pause and resume."""
    w = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if once else w.start()


