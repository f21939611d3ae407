"""Queries of scalar functions, filters, orders and point lookups over whole driver tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import scalars as S
from ..operators import changes, cohorts, hamming, series
from .queries import PAIRS3, query
from .tables import FACTS_SQL, FILES_SQL, FP_SQL, LATER_SQL, MEDIA_SQL, SERIES_SQL, event_series, later_media, media, modes, runs, table, text_fingerprints

_QUERY_FP = f"{FP_SQL}, asked AS (SELECT id AS q, h FROM fp WHERE id % 20 = 0)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query(f"WITH {FILES_SQL} SELECT id, path, kind = 1 AS as_images, kind = 2 AS as_videos, kind > 0 AS as_all FROM files")
def flt02_scopes(spark, sf):
    """FLT-02."""
    m = media(spark, sf, False)
    return m.select("id", "path", *[S.in_scope("kind", s).alias(f"as_{s}") for s in ("images", "videos", "all")])


@query(f"WITH {FP_SQL} SELECT id, bit_count(h) >= 8 AND h <> 0 AS usable FROM fp")
def flt04_usable(spark, sf):
    """FLT-04."""
    return text_fingerprints(table(spark, sf, "documents")).select("id", H.usable("h").alias("usable"))


@query("SELECT o_orderkey, 100.0::DOUBLE - 100.0::DOUBLE * least(64, o_custkey % 80) / 64 AS percent, floor(64 * (100.0::DOUBLE - o_custkey % 101) / 100)::BIGINT AS distance FROM orders")
def flt05_percent_and_distance(spark, sf):
    """FLT-05: both ways."""
    return table(spark, sf, "orders").select("o_orderkey", H.percent_at(F.col("o_custkey") % 80).alias("percent"), H.distance_at(F.col("o_custkey") % 101).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 50 THEN l_quantity * 2 ELSE 0 END AS score FROM lineitem")
def flt06_threshold(spark, sf):
    """FLT-06."""
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", H.passed(F.col("l_quantity") * 2, 50.0).alias("score"))


@query(f"""WITH {FILES_SQL}, {LATER_SQL}, d AS (SELECT f.id, f.kind, f.size <> l.size OR f.path <> l.path AS changed FROM files f JOIN later l USING (id))
SELECT a.id, a.kind = b.kind AS same_kind, true AS everything, CASE WHEN a.kind = 1 THEN a.changed <> b.changed ELSE a.changed OR b.changed END AS hybrid, a.changed OR b.changed AS delta FROM d a JOIN d b ON b.id = a.id + 1""")
def flt09_included(spark, sf):
    """FLT-07, FLT-09: of each file and the next, whether a scan of all, a hybrid one and a delta one compare them."""
    old, new = media(spark, sf, False), later_media(spark, sf).select("id", F.col("size").alias("n"), F.col("path").alias("p"))
    d = old.join(new, "id").select("id", "kind", ((F.col("size") != F.col("n")) | (F.col("path") != F.col("p"))).alias("changed"))
    a, b = d.alias("a"), d.select(F.col("id") - 1, "kind", "changed").toDF("id", "next_kind", "next_changed")
    x, y, image = F.col("changed"), F.col("next_changed"), F.col("kind") == 1
    return a.join(b, "id").select("id", (F.col("kind") == F.col("next_kind")).alias("same_kind"), changes.included(x, y, False, image).alias("everything"), changes.included(x, y, True, image).alias("hybrid"), changes.included(x, y, True, F.lit(False)).alias("delta"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity * 60 - 120 AS a, l_quantity * 50 + l_linenumber AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN least(a, b) <= 0 THEN false WHEN least(a, b) < 1200 THEN abs(a - b) <= 90 ELSE greatest(a, b) / least(a, b) <= 1.2 END AS passes FROM d""")
def flt10_duration_bands(spark, sf):
    """FLT-10."""
    d = _lines(spark, sf)
    return d.select("l_orderkey", "l_linenumber", S.duration_band(F.col("l_quantity") * 60 - 120, F.col("l_quantity") * 50 + F.col("l_linenumber")).alias("passes"))


@query("SELECT event_id, value / 8 < 6 AS flat FROM events")
def flt11_flat_frames(spark, sf):
    """FLT-11: values as deviations."""
    return table(spark, sf, "events").select("event_id", S.low_information(F.col("value") / 8).alias("flat"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '[^/\\]*$') AS base FROM pages),
c AS (SELECT page_id, base, regexp_replace(regexp_replace(CASE WHEN base = '' THEN 'root' ELSE base END, '[^A-Za-z0-9._-]', '_', 'g'), '[_.]+$', '') AS clean FROM p)
SELECT page_id, left(CASE WHEN clean = '' THEN 'root' ELSE clean END, 48) AS label, coalesce(regexp_full_match(base, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}'), false) AS safe FROM c""")
def fn06_source_labels(spark, sf):
    """FN-06: labels of URLs as roots, and whether their last parts may name a suite."""
    return table(spark, sf, "pages").select("page_id", S.source_label("url").alias("label"), S.safe_suite(F.regexp_extract("url", r"([^/\\]*)$", 1)).alias("safe"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber || '.' || l_quantity::BIGINT || CASE WHEN l_returnflag = 'N' THEN '.x' ELSE '.' || l_suppkey END AS v FROM lineitem),
p AS (SELECT *, [coalesce(try_cast(split_part(v, '.', k) AS INTEGER), 0) FOR k IN [1, 2, 3]] AS n FROM v)
SELECT l_orderkey, l_linenumber, n[1] AS major, n[2] AS minor, n[3] AS patch, n < [3, 10, 5] AS older FROM p""")
def fn07_versions(spark, sf):
    """FN-07."""
    tail = F.when(F.col("l_returnflag") == "N", ".x").otherwise(F.concat(F.lit("."), F.col("l_suppkey").cast("string")))
    v = _lines(spark, sf).select("l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("long").cast("string"), tail).alias("v"))
    n = v.select("l_orderkey", "l_linenumber", S.semver("v").alias("n"), S.semver_less("v", F.lit("3.10.5")).alias("older"))
    return n.select("l_orderkey", "l_linenumber", *[F.col("n")[k].alias(c) for k, c in enumerate(("major", "minor", "patch"))], "older")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 THEN epoch(date_trunc('day', o_orderdate))::BIGINT + o_orderkey % 60 END AS seconds FROM orders""")
def fn08_stamps(spark, sf):
    """FN-08: order dates as stamps, some without zone or of an impossible day."""
    o, day = table(spark, sf, "orders"), F.date_format(F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderdate")), "yyyy-MM-dd")
    text = F.concat(F.coalesce(day, F.lit("2021-02-30")), F.lit("T00:00:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.when(F.col("o_orderstatus") == "P", "").otherwise("Z"))
    return o.select("o_orderkey", S.stamp(text).alias("seconds"))


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS json FROM documents""")
def fn09_json_strings(spark, sf):
    """FN-09."""
    return table(spark, sf, "documents").select("doc_id", S.json_string("text").alias("json"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE sign(l_orderkey - 500) * floor(abs(l_orderkey - 500) / 128.0::DOUBLE * 1000000 + 0.5) / 1000000 END AS v FROM lineitem")
def fn11_rounded(spark, sf):
    """FN-11: ties at the seventh decimal, and values that are not finite."""
    x = F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(float("-inf"))).otherwise((F.col("l_orderkey") - 500) / 128.0)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", S.round6(x).alias("v"))


@query(f"""WITH {FILES_SQL}, c AS (SELECT id, CASE WHEN duration <= 15 THEN 0 WHEN duration <= 60 THEN 1 WHEN duration <= 180 THEN 2 WHEN duration <= 600 THEN 3 WHEN duration <= 1500 THEN 4 WHEN duration <= 3600 THEN 5 WHEN duration <= 9000 THEN 6 ELSE 7 END AS cohort FROM files)
SELECT id, cohort, [5, 8, 9, 12, 11, 10, 12, 14][cohort + 1] AS kept FROM c""")
def fn13_cohorts(spark, sf):
    """FN-13."""
    return media(spark, sf, False).select("id", S.duration_cohort("duration").alias("cohort"), S.kept_target("duration").alias("kept"))


@query(f"""WITH {FILES_SQL}, p AS (SELECT id, duration AS d, ceil(least(duration, 14400))::BIGINT AS n FROM files)
SELECT id, CASE WHEN d > 0 THEN n + CASE WHEN n - 1 < d - 0.001 THEN 1 ELSE 0 END ELSE 0 END AS anchors, CASE WHEN d > 0 THEN CASE WHEN n - 1 < d - 0.001 THEN d ELSE n - 1 END END AS last FROM p""")
def fn15_anchor_plans(spark, sf):
    """FN-15."""
    p = media(spark, sf, False).select("id", S.anchor_plan("duration").alias("p"))
    return p.select("id", F.size("p").cast("long").alias("anchors"), F.try_element_at("p", F.lit(-1)).alias("last"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS supported, l_linenumber = 7 AS blocked, CASE l_returnflag WHEN 'N' THEN 'Exact' WHEN 'R' THEN 'Estimated' ELSE 'Unavailable' END AS conf,
  l_partkey % 5 AS gop, l_suppkey % 3 AS fps, l_quantity AS d, l_linenumber * 2 - 2 AS n FROM lineitem),
w AS (SELECT *, CASE WHEN fps > 0 THEN fps * d ELSE 0 END AS total, n * gop * 0.5::DOUBLE AS sparse FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT supported THEN 'SparseSeekUnavailable' WHEN blocked OR conf <> 'Exact' OR gop <= 0 OR total <= 0 OR n = 0 OR sparse >= total THEN 'SequentialPreferred' ELSE 'SparseSeekCandidate' END AS decision,
CASE WHEN NOT supported THEN 'SparseUnsupported' WHEN blocked THEN 'HEVCFallback' WHEN conf <> 'Exact' THEN 'GOPUnknown' WHEN gop <= 0 THEN 'ExactnessUnverified' WHEN total <= 0 OR n = 0 OR sparse >= total THEN 'CostNotAdvantageous' ELSE 'ExactSparseVerified' END AS reason,
CASE WHEN NOT supported OR blocked THEN 'EvidenceStrong' WHEN conf = 'Unavailable' THEN 'EvidenceMissing' WHEN conf = 'Estimated' OR gop <= 0 THEN 'EvidenceLimited' WHEN total <= 0 OR n = 0 THEN 'EvidenceMissing' ELSE 'EvidenceStrong' END AS evidence,
total AS sequential_work, sparse AS sparse_work FROM w""")
def fn18_seek_plans(spark, sf):
    """FN-18."""
    conf = F.when(F.col("l_returnflag") == "N", "Exact").when(F.col("l_returnflag") == "R", "Estimated").otherwise("Unavailable")
    plan = S.seek_decision(F.col("l_linestatus") == "O", F.col("l_linenumber") == 7, conf, F.col("l_partkey") % 5, F.col("l_suppkey") % 3, F.col("l_quantity"), F.col("l_linenumber") * 2 - 2)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in plan.items()])


_MODE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Maximum' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Balanced' WHEN '5-LOW' THEN 'Gaming' ELSE 'Custom' END"


@query(f"""WITH m AS (SELECT o_orderkey, CASE {_MODE_SQL} WHEN 'Maximum' THEN 90 WHEN 'High' THEN 75 WHEN 'Balanced' THEN 55 WHEN 'Gaming' THEN 25 END AS budget, o_custkey % 33 AS threads, o_custkey % 9 * 16 AS base FROM orders)
SELECT o_orderkey, budget, greatest(1, least(greatest(threads, 1), (greatest(threads, 1) * coalesce(budget, 40) + 99) // 100)) AS workers, greatest(1, (greatest(base, 1) * coalesce(budget, 40) + 99) // 100) AS batch FROM m""")
def fn19_resources(spark, sf):
    """FN-19: a mode for each priority, custom ones at 40 percent."""
    p = F.col("o_orderpriority")
    mode = F.when(p == "1-URGENT", "Maximum").when(p == "2-HIGH", "High").when(p == "3-MEDIUM", "Balanced").when(p == "5-LOW", "Gaming").otherwise("Custom")
    budget = S.cpu_budget(mode)
    share = F.coalesce(budget, F.lit(40))
    return table(spark, sf, "orders").select("o_orderkey", budget.alias("budget"), S.workers(share, F.col("o_custkey") % 33).cast("long").alias("workers"), S.gpu_batch(share, F.col("o_custkey") % 9 * 16).cast("long").alias("batch"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS enabled, l_returnflag <> 'R' AS available, l_quantity AS gr, l_quantity / 2 + 1 AS cr, l_linenumber * 14.0::DOUBLE AS cl, l_partkey % 100 AS gl FROM lineitem),
s AS (SELECT *, cr * least(greatest((100 - cl) / 100, 0.25::DOUBLE), 1.0::DOUBLE) AS cpu, least(greatest((100 - gl) / 100, 0.0::DOUBLE), 1.0::DOUBLE) AS room FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT enabled OR NOT available OR gr <= 0 OR room <= 0.1::DOUBLE THEN 0.0 ELSE round(gr * room * 100.0 / (cpu + gr * room), 9) END AS percent FROM s""")
def fn21_shares(spark, sf):
    """FN-21."""
    q = F.col("l_quantity")
    share = S.gpu_share(F.col("l_linestatus") == "O", F.col("l_returnflag") != "R", q / 2 + 1, q, F.col("l_linenumber") * 14.0, F.col("l_partkey") % 100)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", F.round(share, 9).alias("percent"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 6 THEN 'Missing' WHEN l_returnflag = 'R' OR l_partkey % 9 = 0 OR l_suppkey % 5 = 0 THEN 'Hard' WHEN l_quantity > 40 THEN 'Stale' WHEN l_linestatus = 'O' THEN 'Soft' ELSE 'Exact' END AS fit FROM lineitem""")
def fn22_profile_fits(spark, sf):
    """FN-22."""
    fit = S.profile_match(F.col("l_linenumber") <= 6, F.col("l_returnflag") != "R", F.col("l_partkey") % 9 != 0, F.col("l_suppkey") % 5 == 0, F.col("l_quantity") > 40, F.col("l_linestatus") != "O")
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", fit.alias("fit"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS v, l_suppkey % 3 <> 0 AS same, l_linestatus = 'O' AS ending, l_partkey % 5 = 0 AS failed, l_partkey % 11 = 0 AS drift, l_quantity < 5 AS thin, l_quantity > 48 AS odd FROM lineitem),
s AS (SELECT *, least(greatest(least(v, 2) * 40.0::DOUBLE + same::INT * 10.0::DOUBLE + ending::INT * 10.0::DOUBLE, 0), 100) AS score FROM e)
SELECT l_orderkey, l_linenumber, score, CASE WHEN drift OR odd THEN 'Uncertain' WHEN v >= 2 AND same AND NOT failed AND score >= 87.5 THEN 'Dup' WHEN v > 0 AND failed OR thin THEN 'Uncertain' WHEN v = 0 THEN 'Diff' ELSE 'Uncertain' END AS kind FROM s""")
def fn23_verdicts(spark, sf):
    """FN-23."""
    v, same = F.col("l_partkey") % 4, F.col("l_suppkey") % 3 != 0
    score = S.verdict_score(v, same, F.col("l_linestatus") == "O")
    kind = S.verdict(v, same, F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 11 == 0, F.col("l_quantity") < 5, F.col("l_quantity") > 48, score)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", score.alias("score"), kind.alias("kind"))


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F' AND o_custkey % 15 >= 7 AND CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey % 15 END >= 7, false) AS stale FROM orders")
def snk13_stale_indexes(spark, sf):
    """SNK-13: ages in days; an unknown one keeps the index."""
    age = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey") % 15)
    return table(spark, sf, "orders").select("o_orderkey", S.stale_index(F.col("o_orderstatus") != "F", F.col("o_custkey") % 15, age).alias("stale"))


@query(f"WITH {FP_SQL}, {PAIRS3} SELECT p.left_id || chr(9) || p.right_id || chr(9) || printf('%.1f', (64 - distance) * 100.0::DOUBLE / 64) || chr(9) || lpad(lower(hex(a.h)), 16, '0') AS line FROM pairs p JOIN fp a ON a.id = p.left_id")
def prj07_result_rows(spark, sf):
    """PRJ-07."""
    fp = text_fingerprints(table(spark, sf, "documents"))
    pairs = hamming.hamming_pairs(fp, 3).join(fp.withColumnRenamed("id", "left_id"), "left_id")
    return pairs.select(F.concat_ws("\t", F.col("left_id").cast("string"), F.col("right_id").cast("string"), F.format_string("%.1f", (64 - F.col("distance")) * 100.0 / 64), H.hex16("h")).alias("line"))


def _best_sql(terms, guarded):
    one = "(64 - bit_count(xor({0}, {1}))) * 100.0::DOUBLE / 64"
    term = "CASE WHEN {0} <> 0 AND bit_count({0}) >= 8 AND {1} <> 0 AND bit_count({1}) >= 8 THEN " + one + " ELSE 0 END" if guarded else one
    return "greatest(" + ", ".join(term.format(f"a.{x}", f"b.{y}") for x, y in terms) + ")"


_FOUR = [(x, y) for x in ("h", "mirror") for y in ("h", "mirror")]


@query(f"WITH {MEDIA_SQL} SELECT a.id, (64 - bit_count(xor(a.h, b.h))) * 100.0::DOUBLE / 64 AS percent, {_best_sql(_FOUR, True)} AS best, {_best_sql(_FOUR, False)} AS frame, {_best_sql(_FOUR, False)} >= 87.5 AS passes FROM media a JOIN media b ON b.id = a.id + 1")
def sim02_best_full(spark, sf):
    """SIM-01, SIM-02, SIM-11: each file with the next, as images and as anchor frames."""
    m = media(spark, sf).select("id", "h", "mirror", F.struct(F.col("h").alias("phash"), "mirror").alias("f"))
    pairs = m.alias("x").join(m.alias("y"), F.col("y.id") == F.col("x.id") + 1)
    frame = H.frame_score("x.f", "y.f")
    return pairs.select(F.col("x.id").alias("id"), H.similarity("x.h", "y.h").alias("percent"), H.best_full("x", "y").alias("best"), frame.alias("frame"), (frame >= 87.5).alias("passes"))


@query(f"WITH {_QUERY_FP} SELECT q, fp.id, bit_count(xor(asked.h, fp.h))::BIGINT AS distance, row_number() OVER (PARTITION BY q ORDER BY bit_count(xor(asked.h, fp.h)), fp.id) AS place FROM asked JOIN fp ON bit_count(xor(asked.h, fp.h)) <= 8")
def srt01_ordered_candidates(spark, sf):
    """SRT-01, SRT-02: for every twentieth document its hits by distance and id, which is by falling percent."""
    fp = text_fingerprints(table(spark, sf, "documents"))
    hits = hamming.hamming_probe(fp.where("id % 20 = 0").select(F.col("id").alias("q"), "h"), fp, 8)
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    return hits.select("q", "id", F.col("distance").cast("long").alias("distance"), place.cast("long").alias("place"))


@query(f"WITH {FP_SQL}, {PAIRS3} SELECT left_id, right_id, (64 - distance) * 100.0::DOUBLE / 64 AS percent FROM pairs ORDER BY distance, left_id, right_id LIMIT 100")
def srt07_bounded_results(spark, sf):
    """SRT-07: the feature is the limit: the hundred most similar pairs."""
    pairs = hamming.hamming_pairs(text_fingerprints(table(spark, sf, "documents")), 3)
    return hamming.best_results(pairs.select("left_id", "right_id", ((64 - F.col("distance")) * 100.0 / 64).alias("percent")), 100)


@query(f"WITH {FILES_SQL}, {LATER_SQL} SELECT l.path, coalesce(f.size = l.size AND f.modified = l.modified AND f.quick_hash = l.quick_hash, false) AS unchanged, coalesce(f.id, -1) AS admitted, CASE WHEN f.size = l.size AND f.modified = l.modified AND f.quick_hash = l.quick_hash THEN f.sha256 END AS sha256 FROM later l LEFT JOIN files f ON f.path = l.path")
def src11_lookups(spark, sf):
    """SRC-11: files of now looked up in the index of before."""
    stored = media(spark, sf, False).withColumn("admitted_ms", F.col("id"))
    return changes.lookups(later_media(spark, sf), stored).select("path", "unchanged", F.col("admitted_ms").alias("admitted"), "sha256")


@query(f"WITH {FILES_SQL}, {LATER_SQL} SELECT f.id, f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.path = f.path)")
def set03_except(spark, sf):
    """SET-03."""
    return changes.without_ignored(media(spark, sf, False).select("id", "path"), later_media(spark, sf).select("path"))


@query(f"""WITH {FILES_SQL}, {LATER_SQL}, v AS (SELECT f.*, id % 3 AS version, md5(text) AS payload FROM files f JOIN documents d ON d.doc_id = f.id),
a AS (SELECT l.*, 1 AS version FROM later l) SELECT a.path, v.payload FROM a LEFT JOIN v ON v.path = a.path AND v.size = a.size AND v.modified = a.modified AND v.quick_hash = a.quick_hash AND v.version = a.version AND strlen(v.payload) = 32""")
def src15_cached_fingerprints(spark, sf):
    """SRC-15, SNK-10: payloads of one version kept in a cache and read for the files of now; a changed file misses."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("payload"))
    key = ("path", "size", "modified", "quick_hash")
    saved = media(spark, sf, False).join(d, "id").select(*key, (F.col("id") % 3).alias("cache_version"), F.lit("v1").alias("policy"), "payload")
    asked = later_media(spark, sf).select(*key, F.lit(1).cast("long").alias("cache_version"), F.lit("v1").alias("policy"))
    cache = changes.purge_versions(changes.cache_save(saved.where("false"), saved), 1)
    return changes.cache_read(asked, cache, F.length("payload") == 32).select("path", "payload")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fn04_content_sha256(spark, sf):
    """FN-04."""
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {SERIES_SQL}, p AS (SELECT key, t, [value, value * 2, abs(value - 50)] AS p FROM series), b AS (SELECT *, lag(p) OVER (PARTITION BY key ORDER BY t) AS b FROM p) SELECT key, t AS ts, CASE WHEN b IS NULL THEN 0 ELSE round((0.0::DOUBLE + abs(p[1] - b[1]) + abs(p[2] - b[2]) + abs(p[3] - b[3])) / 3, 9) END AS delta FROM b")
def win02_frame_deltas(spark, sf):
    """WIN-02: frames of three pixels."""
    v = F.col("value")
    f = event_series(spark, sf).select("key", F.col("t").alias("ts"), F.array(v, v * 2, F.abs(v - 50)).alias("pixels"))
    return series.frame_deltas(f).withColumn("delta", F.round("delta", 9))


@query(f"""WITH {SERIES_SQL}, f AS (SELECT key, id AS i, t AS ts, value AS sd, floor(t / 3600)::BIGINT AS hour FROM series WHERE value >= 6),
w AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY hour) - 1 AS win FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY key, win ORDER BY sd DESC, i) = 1 AND win < 5 AS best FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY best DESC, sd DESC, i) AS r FROM b) SELECT key, i, ts, sd FROM r WHERE r <= 5""")
def win06_kept_by_windows(spark, sf):
    """WIN-06: hours with a frame over the floor as windows."""
    f = event_series(spark, sf).where("value >= 6").select("key", F.col("id").alias("i"), F.col("t").alias("ts"), F.col("value").alias("sd"))
    win = F.dense_rank().over(Window.partitionBy("key").orderBy(F.floor(F.col("ts") / 3600))) - 1
    return series.kept_by_windows(f.withColumn("win", win), 5)


@query("""WITH f AS (SELECT conv_id, turn, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM conversations)
SELECT conv_id, count(*) AS frames, ('0x' || substr(sha256(string_agg(lpad(lower(hex(h)), 16, '0'), '' ORDER BY turn, h)), 1, 15))::BIGINT AS folded FROM f GROUP BY conv_id""")
def agg16_folded_hashes(spark, sf):
    """AGG-16: conversations as videos whose frames are turns."""
    h = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("long")
    frames = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("frames"), F.array_sort(F.collect_list(F.struct("turn", h.alias("h")))).alias("f"))
    return frames.select("conv_id", "frames", H.folded(F.transform("f", lambda x: x["h"])).alias("folded"))


_CREDIT_FRAMES = """f AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY t, id) - 1) * 5.0::DOUBLE AS ts, value AS mean, value % 4 AS delta, 100 - value AS edge, value < 2 AS low FROM series),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, max(ts) OVER (PARTITION BY key) + 5 AS duration FROM f)"""


@query(f"""WITH {SERIES_SQL}, {_CREDIT_FRAMES}, b AS (SELECT key, list_sort(list(edge)) AS e FROM n WHERE i < floor(n * 4 / 5) AND NOT low GROUP BY key),
t AS (SELECT n.*, e[len(e) // 2 + 1] AS base FROM n JOIN b USING (key) WHERE ts >= duration - 120), d AS (SELECT *, mean < 45 AND delta < 3 AND NOT low AND base > 0.5 AND edge > 1.5 * base AS dark FROM t),
s AS (SELECT *, sum(CASE WHEN dark THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts) AS island, coalesce(lead(ts) OVER (PARTITION BY key ORDER BY ts), duration) AS next FROM d),
r AS (SELECT key, island, min(ts) AS start, max(next) AS stop FROM s WHERE dark GROUP BY ALL) SELECT key, min(start) AS start, greatest(0, min(start) - 5) AS main_end FROM r WHERE stop - start >= 10 GROUP BY key""")
def sim16_credit_runs(spark, sf):
    """SIM-16: each user's events as frames five seconds apart."""
    e = event_series(spark, sf)
    ts = (F.row_number().over(Window.partitionBy("key").orderBy("t", "id")) - 1) * 5.0
    v = F.col("value")
    f = e.select("key", ts.alias("ts"), v.alias("mean"), (v % 4).alias("delta"), (100 - v).alias("edge"), (v < 2).alias("low_info"))
    return series.credit_runs(f.withColumn("duration", F.max("ts").over(Window.partitionBy("key")) + 5))


@query("""WITH k AS (SELECT doc_id AS key, 4 + doc_id % 30 AS n, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 2.25 ELSE 0.5 END::DOUBLE AS c FROM documents),
fine AS (SELECT key, unnest(range(n)) * 0.5::DOUBLE AS ts FROM k), coarse AS (SELECT key, unnest(range(1 + key % 9)) * c AS ts FROM k),
ok AS (SELECT key, c, greatest(key % 9, 0) AS core, (key % 9) * c AS finish FROM k WHERE key % 9 >= 1 AND c / 0.5 >= 2 AND abs(c / 0.5 - round(c / 0.5)) <= 0.01),
met AS (SELECT f.key, f.ts, f.ts < finish AS is_core, core FROM fine f JOIN coarse c ON c.key = f.key AND round(c.ts * 1000) = round(f.ts * 1000) JOIN ok ON ok.key = f.key),
good AS (SELECT key FROM met GROUP BY key HAVING count(*) >= 3 AND any_value(core) > 0 AND count(*) FILTER (WHERE is_core) * 5 >= any_value(core) * 4)
SELECT key, ts FROM met WHERE key IN (FROM good)""")
def jn18_aligned_grids(spark, sf):
    """JN-18: a grid of half seconds and one of a step by document."""
    d = F.col("doc_id")
    k = table(spark, sf, "documents").select(d.alias("key"), (4 + d % 30).alias("n"), F.when(d % 4 == 0, 1.0).when(d % 4 == 1, 1.5).when(d % 4 == 2, 2.25).otherwise(0.5).alias("c"))
    fine = k.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("key", (F.col("i") * 0.5).alias("ts"))
    coarse = k.select("key", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("key") % 9)).alias("i")).select("key", (F.col("i") * F.col("c")).alias("ts"))
    return series.aligned_grids(fine, coarse)


_RANK = "CASE {0} WHEN 'AUTO' THEN 0 WHEN 'CPU' THEN 1 WHEN 'CUDA' THEN 2 ELSE 99 END"


@query(f"WITH {FACTS_SQL}, m AS (SELECT DISTINCT run_id, requested_mode, effective_mode FROM modes) SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_RANK.format('requested_mode')}, {_RANK.format('effective_mode')}) AS place FROM m")
def srt08_ordered_modes(spark, sf):
    """SRT-08: each run's modes in their order."""
    m = modes(spark, sf).select("run_id", "requested_mode", "effective_mode").distinct()
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(cohorts.mode_order("requested_mode"), cohorts.mode_order("effective_mode")))
    return m.withColumn("place", place.cast("long"))


@query(f"WITH {FACTS_SQL} SELECT dataset_fp, scope, build, commit_state, commit, count(*) AS runs FROM runs GROUP BY ALL")
def prj06_grouping_keys(spark, sf):
    """PRJ-06."""
    return cohorts.grouped(runs(spark, sf)).agg(F.count(F.lit(1)).alias("runs"))
