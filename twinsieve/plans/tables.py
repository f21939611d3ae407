"""Driver tables as the engine's inputs: documents as media files, orders and line items as benchmark facts, events as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import ASPECTS, fingerprint_of, simhash60
from ..functions.scalars import media_kind
from ..session import checkpointed

MIRROR = 0x0F0F0F0F0F0F0F0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores dealt evenly over the cores. Such a scan is small (a core's share of
    spark.sql.files.maxPartitionBytes each at most); a larger one is left as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def text_fingerprints(docs: DataFrame) -> DataFrame:
    """(id, h): a 60-bit bit vote over the words `[a-z0-9]+` of each document, as a checkpoint, since joins use it on both
    sides. A document without such words (another script, blank or null) has no row.

    Votes fold in the task that reads the text, so one short row a document is exchanged, never its words."""
    words = spread(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    votes = words.groupBy("id").agg(F.count(F.lit(1)).alias("many"), *simhash60(F.col("w")))
    return checkpointed(votes.select("id", fingerprint_of("many").alias("h")))


def media(spark: SparkSession, sf_dir: str, hashes: bool = True) -> DataFrame:
    """Documents as files: id, path, kind, size, modified, quick_hash, sha256, duration, pixels; with `hashes` also fingerprints,
    and as a checkpoint, since joins use it on both sides."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "JPG", "de", "png", "fr", "mp4", "es", "mkv")]), F.col("lang"))
    files = d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("modified"), F.substring(F.md5("text"), 1, 16).alias("quick_hash"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("pixels"),
    )
    files = files.withColumn("kind", media_kind("path")).withColumn("duration", F.when(F.col("kind") == 2, F.col("pixels") / 10.0).otherwise(0.0))
    if not hashes:
        return files
    fp = text_fingerprints(d)
    out = files.join(fp, "id", "left").withColumn("h", F.coalesce("h", F.lit(0).cast("long"))).withColumn("mirror", F.col("h").bitwiseXOR(F.lit(MIRROR)))
    for k, r in enumerate(ASPECTS, 1):
        out = out.withColumn(f"crop_{r}", F.shiftrightunsigned("h", k)).withColumn(f"mirror_crop_{r}", F.shiftrightunsigned("mirror", k))
    return checkpointed(out)


def later_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files later: those labelled low in quality rewritten, toxic ones moved to quarantine."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    m = media(spark, sf_dir, hashes=False).join(labels, "id", "left")
    poor, moved = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    return m.select("id", F.when(moved, F.concat(F.lit("quarantine/"), "path")).otherwise(F.col("path")).alias("path"), "kind", F.when(poor, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified", "quick_hash", "sha256", "pixels", "duration")


def item_status():
    return F.when(F.col("l_returnflag") == "N", "SUCCESS").when(F.col("l_returnflag") == "R", "FAILED").otherwise("SKIPPED")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: dataset by the customer's market segment, scope by status, build by priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    commit = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).when(F.col("o_orderpriority") == "2-HIGH", "unknown").otherwise(F.substring(F.md5("o_orderpriority"), 1, 8))
    status = F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("SUCCESS")
    from ..functions.scalars import provenance

    return j.select(F.col("o_orderkey").alias("run_id"), F.col("c_mktsegment").alias("dataset_fp"), F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("build"), provenance(commit).alias("commit_state"), F.coalesce(commit, F.lit("")).alias("commit"), status.alias("run_status"), F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice")).alias("wall_ms"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as cases; several line items of one part are one case."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("case_id")).agg(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.min(item_status()).alias("status"), F.sum("l_quantity").alias("elapsed_ms"))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mode results: the mode asked for by line status, the one taken by the month of shipping."""
    l = table(spark, sf_dir, "lineitem")
    asked = F.when(F.col("l_linestatus") == "O", "AUTO").otherwise("CPU")
    taken = F.when(F.month("l_shipdate") <= 6, "CPU").otherwise("CUDA")
    return l.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("case_id"), asked.alias("requested_mode"), taken.alias("effective_mode"), item_status().alias("status"), F.when(F.col("l_quantity") > 2, F.col("l_quantity") * F.col("l_discount") * 100).alias("elapsed_ms"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, type, t seconds, value) of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), "value")


# ---------------------------------------------------------------- the same in DuckDB SQL

_BIT = " + ".join(f"(CASE WHEN sum(CASE WHEN (d >> {i}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(60))
FP_SQL = f"""
words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
counted AS (SELECT id, w, count(*)::BIGINT AS n, ('0x' || substr(md5(w), 1, 15))::BIGINT AS d FROM words GROUP BY ALL),
fp AS (SELECT id, {_BIT} AS h FROM counted GROUP BY id)"""
FILES_SQL = """
files0 AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'JPG' WHEN 'de' THEN 'png' WHEN 'fr' THEN 'mp4' ELSE 'mkv' END AS path,
  CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 2 END AS kind, strlen(text)::BIGINT AS size, doc_id * 1000 AS modified, substr(md5(text), 1, 16) AS quick_hash, sha256(text) AS sha256, n_chars AS pixels FROM documents),
files AS (SELECT *, CASE WHEN kind = 2 THEN pixels / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS duration FROM files0)"""
MEDIA_SQL = f"""{FP_SQL}, {FILES_SQL},
media AS (SELECT *, xor(h, {MIRROR}) AS mirror, h >> 1 AS crop_4x3, h >> 2 AS crop_1x1, h >> 3 AS crop_9x16, xor(h, {MIRROR}) >> 1 AS mirror_crop_4x3, xor(h, {MIRROR}) >> 2 AS mirror_crop_1x1,
  xor(h, {MIRROR}) >> 3 AS mirror_crop_9x16 FROM (SELECT f.*, coalesce(fp.h, 0) AS h FROM files f LEFT JOIN fp USING (id)))"""
LATER_SQL = """
later AS (SELECT f.id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'quarantine/' || f.path ELSE f.path END AS path, f.kind, f.size + CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS size, f.modified, f.quick_hash, f.sha256
  FROM files f LEFT JOIN labels l ON f.id = l.doc_id)"""
_STATUS_SQL = "CASE l_returnflag WHEN 'N' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' ELSE 'SKIPPED' END"
_COMMIT_SQL = "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 'unknown' ELSE substr(md5(o_orderpriority), 1, 8) END"
FACTS_SQL = f"""
runs AS (SELECT o_orderkey AS run_id, c_mktsegment AS dataset_fp, o_orderstatus AS scope, o_orderpriority AS build,
  CASE WHEN {_COMMIT_SQL} IS NULL THEN 'Legacy' WHEN {_COMMIT_SQL} = 'unknown' THEN 'Unknown' ELSE 'Known' END AS commit_state, coalesce({_COMMIT_SQL}, '') AS commit,
  CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'SUCCESS' END AS run_status, CASE WHEN o_totalprice >= 1000 THEN o_totalprice END AS wall_ms FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
cases AS (SELECT l_orderkey AS run_id, l_partkey AS case_id, 'part/' || l_partkey AS path, min({_STATUS_SQL}) AS status, sum(l_quantity) AS elapsed_ms FROM lineitem GROUP BY ALL),
modes AS (SELECT l_orderkey AS run_id, l_partkey AS case_id, CASE WHEN l_linestatus = 'O' THEN 'AUTO' ELSE 'CPU' END AS requested_mode, CASE WHEN month(l_shipdate) <= 6 THEN 'CPU' ELSE 'CUDA' END AS effective_mode,
  {_STATUS_SQL} AS status, CASE WHEN l_quantity > 2 THEN l_quantity * l_discount * 100 END AS elapsed_ms FROM lineitem)"""
SERIES_SQL = "series AS (SELECT user_id AS key, event_id AS id, event_type AS type, epoch_us(ts) / 1000000.0::DOUBLE AS t, value FROM events)"
