"""Registered queries on the driver's tables, each over whole tables, with their DuckDB twins.

A query's name begins with the id of the operator it shows; its docstring is its operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import scalars as S
from ..operators import changes, cohorts, groups, hamming, series
from ..session import checkpointed
from .tables import FACTS_SQL, FILES_SQL, FP_SQL, LATER_SQL, MEDIA_SQL, SERIES_SQL, cases, event_series, later_media, media, modes, runs, table, text_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _documents(spark, sf):
    return text_fingerprints(table(spark, sf, "documents"))


PAIRS3 = "pairs AS (SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM fp a JOIN fp b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3)"


# ---------------------------------------------------------------- fingerprints and Hamming joins


@query(f"WITH {FP_SQL} SELECT id, h, bit_count(h)::BIGINT AS bits, h <> 0 AND bit_count(h) >= 8 AS usable, (h >> 16) & 65535 AS part1, lpad(lower(hex(h)), 16, '0') AS hex FROM fp")
def fn01_fingerprint_parts(spark, sf):
    d = _documents(spark, sf)
    return d.select("id", "h", F.bit_count("h").cast("long").alias("bits"), H.usable("h").alias("usable"), H.slice16("h", 1).cast("long").alias("part1"), H.hex16("h").alias("hex"))


@query("SELECT count(*)::BIGINT AS masks, sum(m)::BIGINT AS total, max(m)::BIGINT AS largest FROM range(65536) t(m) WHERE bit_count(m) <= 2")
def fn02_radius_two_masks(spark, sf):
    m = spark.range(65536).where(F.bit_count("id") <= 2).withColumnRenamed("id", "m")
    return m.agg(F.count(F.lit(1)).alias("masks"), F.sum("m").alias("total"), F.max("m").alias("largest"))


def _near(strategy, d=3):
    def run(spark, sf):
        p = hamming.hamming_pairs(_documents(spark, sf), d, strategy)
        return p.select("left_id", "right_id", F.col("distance").cast("long").alias("distance"), ((64 - F.col("distance")) * 100.0 / 64).alias("percent"))

    return run


_NEAR_SQL = f"WITH {FP_SQL}, {PAIRS3} SELECT *, (64 - distance) * 100.0::DOUBLE / 64 AS percent FROM pairs"
for _s in ("theta", "bands", "slices"):
    QUERIES[f"jn01_hamming_pairs_{_s}"], SQL[f"jn01_hamming_pairs_{_s}"] = _near(_s), _NEAR_SQL
QUERIES["near_duplicate_pairs"], SQL["near_duplicate_pairs"] = _near("auto"), _NEAR_SQL
QUERIES["jn01_hamming_pairs_d8"] = _near("bands", 8)
SQL["jn01_hamming_pairs_d8"] = _NEAR_SQL.replace("<= 3", "<= 8")


@query(f"WITH {FP_SQL} SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM fp a JOIN fp b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 10")
def jn01_hamming_pairs_beyond_eight(spark, sf):
    return hamming.hamming_pairs(_documents(spark, sf), 10).withColumn("distance", F.col("distance").cast("long"))


_ASK = "ask AS (SELECT b.item_id AS q, fp.h FROM benchmark b JOIN bfp fp ON b.item_id = fp.id)"
BFP_SQL = FP_SQL.replace("words AS", "bwords AS").replace("FROM words", "FROM bwords").replace("counted AS", "bcounted AS").replace("FROM counted", "FROM bcounted").replace("fp AS", "bfp AS").replace("doc_id AS id", "item_id AS id").replace("FROM documents", "FROM benchmark")


def _asked(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return text_fingerprints(b).withColumnRenamed("id", "q")


@query(f"WITH {FP_SQL}, {BFP_SQL}, {_ASK} SELECT q, id, bit_count(xor(ask.h, fp.h))::BIGINT AS distance FROM ask JOIN fp ON bit_count(xor(ask.h, fp.h)) <= 16")
def jn02_benchmark_probe(spark, sf):
    return hamming.hamming_probe(_asked(spark, sf), _documents(spark, sf), 16).withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH {FP_SQL}, {BFP_SQL}, {_ASK} SELECT q, list(id ORDER BY d, id) AS ids FROM (SELECT q, id, bit_count(xor(ask.h, fp.h)) AS d FROM ask JOIN fp ON bit_count(xor(ask.h, fp.h)) <= 16) GROUP BY q")
def jn03_benchmark_lists(spark, sf):
    return hamming.hamming_lists(_asked(spark, sf), _documents(spark, sf), 16).select("q", F.transform("hits", lambda x: x["id"]).alias("ids"))


_FULL = ("h", "mirror")


def _guard(pairs):
    return ", ".join(f"CASE WHEN x.{a} <> 0 AND bit_count(x.{a}) >= 8 AND y.{b} <> 0 AND bit_count(y.{b}) >= 8 THEN (64 - bit_count(xor(x.{a}, y.{b}))) * 100.0::DOUBLE / 64 ELSE 0 END" for a, b in pairs)


_VARIANTS = [(a, b) for a in _FULL for b in _FULL]
_CANDIDATE = [(a, b) for a in _FULL for b in _FULL]
for _r in H.ASPECTS:
    _c = (f"crop_{_r}", f"mirror_crop_{_r}")
    _VARIANTS += [(a, b) for a in _c for b in _FULL] + [(a, b) for a in _FULL for b in _c] + [(a, b) for a in _c for b in _c]
_CLOSE = " OR ".join(f"(x.{a} <> 0 AND y.{b} <> 0 AND bit_count(xor(x.{a}, y.{b})) <= 3)" for a, b in _VARIANTS)
CAND_SQL = f"cand AS (SELECT x.id AS left_id, y.id AS right_id FROM media x JOIN media y ON x.kind = y.kind AND x.id < y.id AND ({_CLOSE}))"


@query(f"WITH {MEDIA_SQL}, {CAND_SQL} SELECT * FROM cand")
def jn04_variant_candidates(spark, sf):
    return hamming.variant_candidates(media(spark, sf), 3)


@query(f"WITH {MEDIA_SQL}, {CAND_SQL}, changed AS (SELECT doc_id AS id FROM labels WHERE quality = 0 OR toxic = 1) SELECT * FROM cand WHERE left_id IN (FROM changed) OR right_id IN (FROM changed)")
def jn05_delta_candidates(spark, sf):
    changed = table(spark, sf, "labels").where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    return hamming.variant_candidates(media(spark, sf), 3, changed)


@query(f"WITH {MEDIA_SQL}, {CAND_SQL}, scored AS (SELECT left_id, right_id, greatest({_guard(_VARIANTS)}) AS percent FROM cand JOIN media x ON left_id = x.id JOIN media y ON right_id = y.id) SELECT * FROM scored WHERE percent >= 95.0")
def sim03_variant_scores(spark, sf):
    m = media(spark, sf)
    return hamming.variant_scores(m, 3, 95.0)


@query(f"WITH {MEDIA_SQL}, {BFP_SQL}, ask AS (SELECT id AS q, h, xor(h, 1085102592571150064) AS mirror FROM bfp) SELECT q, id, percent FROM (SELECT x.q, y.id, greatest({_guard(_VARIANTS[:4])}) AS percent FROM ask x JOIN media y ON y.kind = 1) WHERE percent >= 76.0")
def jn07_query_by_fingerprint(spark, sf):
    from .tables import MIRROR

    asked = _asked(spark, sf).withColumn("mirror", F.col("h").bitwiseXOR(F.lit(MIRROR))).withColumn("kind", F.lit(1))
    return hamming.query_by_fingerprint(media(spark, sf), asked, 76.0)


SQL["jn07_query_by_fingerprint"] = SQL["jn07_query_by_fingerprint"].replace("1085102592571150064", str(0x0F0F0F0F0F0F0F0))


@query(f"WITH {FP_SQL}, {BFP_SQL} SELECT x.id AS i, y.id AS j, (64 - bit_count(xor(x.h, y.h))) * 100.0::DOUBLE / 64 AS percent FROM bfp x, fp y ORDER BY percent DESC, i, j LIMIT 1")
def jn08_brute_best(spark, sf):
    return hamming.brute_best(_asked(spark, sf).withColumnRenamed("q", "i"), _documents(spark, sf).withColumnRenamed("id", "j"), 0.0)


# ---------------------------------------------------------------- groups

GROUP_SQL = f"""WITH RECURSIVE {FP_SQL}, link AS (SELECT a.id AS a, b.id AS b FROM fp a JOIN fp b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 1),
reach AS (SELECT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node AND reach.root <= link.b),
comp AS (SELECT node AS member, min(root) AS component_id FROM reach GROUP BY node),
grp AS (SELECT component_id, member, count(*) OVER (PARTITION BY component_id) AS size FROM comp)"""


def _groups(spark, sf):
    return groups.duplicate_groups(hamming.hamming_links(_documents(spark, sf), 1))


@query(f"{GROUP_SQL} SELECT * FROM grp")
def duplicate_groups(spark, sf):
    return _groups(spark, sf)


QUERIES["agg13_duplicate_groups"], SQL["agg13_duplicate_groups"] = duplicate_groups, SQL["duplicate_groups"]


@query(
    f"""{GROUP_SQL}, {FILES_SQL.strip()}, k AS (SELECT DISTINCT kind FROM files),
p AS (SELECT kind, count(*) AS pairs FROM fp a JOIN fp b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 1 JOIN files f ON f.id = a.id GROUP BY kind),
g AS (SELECT kind, count(DISTINCT component_id) AS groups, count(*) AS files FROM grp JOIN files f ON f.id = member GROUP BY kind)
SELECT kind, coalesce(pairs, 0) AS pairs, coalesce(groups, 0) AS groups, coalesce(g.files, 0) AS files FROM k LEFT JOIN p USING (kind) LEFT JOIN g USING (kind)"""
)
def agg14_kind_stats(spark, sf):
    d = _documents(spark, sf)
    pairs = hamming.hamming_pairs(d, 1)
    return groups.kind_stats(pairs, groups.duplicate_groups(hamming.hamming_links(d, 1)), media(spark, sf, False).select("id", "kind"))


@query(f"WITH {FILES_SQL}, {FP_SQL}, c AS (SELECT count(*) AS candidates FROM fp a JOIN fp b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3), p AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS possible FROM (SELECT count(*) AS n FROM files GROUP BY kind)) SELECT candidates, possible, 100.0 * (1 - candidates / possible) AS reduction FROM c, p")
def agg15_reduction(spark, sf):
    c = hamming.hamming_pairs(_documents(spark, sf), 3).agg(F.count(F.lit(1)).alias("candidates"))
    p = groups.possible_pairs(media(spark, sf, False))
    return c.crossJoin(p).select("candidates", "possible", groups.reduction(F.col("candidates"), F.col("possible")).alias("reduction"))


@query(
    f"""{GROUP_SQL}, {FILES_SQL.strip()}, s AS (SELECT a.id AS a, b.id AS b, (64 - bit_count(xor(a.h, b.h))) * 100.0::DOUBLE / 64 AS percent FROM fp a JOIN fp b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= 1),
best AS (SELECT a AS node, max(percent) AS best FROM s GROUP BY a)
SELECT component_id, member, best, pixels, f.size AS size_bytes, row_number() OVER (PARTITION BY component_id ORDER BY best DESC, pixels DESC, f.size DESC, member) - 1 AS place FROM grp JOIN files f ON f.id = member JOIN best ON node = member"""
)
def srt04_members_in_order(spark, sf):
    d = _documents(spark, sf)
    pairs = hamming.hamming_pairs(d, 1).withColumn("percent", (64 - F.col("distance")) * 100.0 / 64)
    files = media(spark, sf, False).select("id", "pixels", F.col("size").alias("size_bytes"))
    return groups.members_in_order(groups.duplicate_groups(hamming.hamming_links(d, 1)), files, groups.best_percent(pairs)).withColumn("place", F.col("place").cast("long"))


@query(f"{GROUP_SQL}, {FILES_SQL.strip()}, hit AS (SELECT component_id FROM grp JOIN files f ON f.id = member GROUP BY 1 HAVING bool_or(contains(lower(path), 'src1/'))) SELECT component_id, member FROM grp WHERE component_id IN (FROM hit)")
def flt12_group_search(spark, sf):
    g = _groups(spark, sf)
    named = g.join(media(spark, sf, False).select(F.col("id").alias("member"), "path"), "member")
    return groups.groups_with(named, "SRC1/").select("component_id", "member")


@query(f"{GROUP_SQL}, {FILES_SQL.strip()} SELECT component_id, count(*) AS members, sum(f.size)::BIGINT AS total_bytes, min(path) AS first_path, max(modified) AS latest FROM grp JOIN files f ON f.id = member GROUP BY 1 ORDER BY total_bytes DESC, first_path")
def srt03_groups_by_size(spark, sf):
    files = media(spark, sf, False).select(F.col("id").alias("member"), "path", "modified", F.col("size").alias("bytes"))
    members = _groups(spark, sf).join(files, "member").groupBy("component_id")
    summary = members.agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("total_bytes"), F.min("path").alias("first_path"), F.max("modified").alias("latest"))
    return groups.groups_in_order(summary, "size")


@query(f"WITH {FP_SQL}, {PAIRS3} SELECT left_id AS id FROM pairs UNION SELECT right_id FROM pairs")
def set06_distinct_members(spark, sf):
    return groups.distinct_members(hamming.hamming_pairs(_documents(spark, sf), 3))


@query("SELECT least(a, b) AS \"left\", greatest(a, b) AS \"right\", max(p) AS percent FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b, 100.0::DOUBLE - abs(x.l_quantity - y.l_quantity) AS p FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber <> y.l_linenumber) GROUP BY 1, 2")
def set01_canonical_pairs(spark, sf):
    """SET-01: suppliers of one order, an order having a few lines."""
    l = table(spark, sf, "lineitem")
    a = l.select(F.col("l_suppkey").alias("left"), "l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"))
    b = l.select(F.col("l_suppkey").alias("right"), "l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("y"))
    return hamming.canonical(a.join(b, "l_orderkey").where("i <> j").select("left", "right", (100.0 - F.abs(F.col("x") - F.col("y"))).alias("percent")))


# ---------------------------------------------------------------- incremental index

_DIFF = "SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.size = c.size AND p.modified = c.modified{quick} THEN 'unchanged' ELSE 'modified' END AS change FROM files p FULL JOIN later c ON p.path = c.path"


@query(f"WITH {FILES_SQL}, {LATER_SQL} {_DIFF.format(quick=' AND p.quick_hash = c.quick_hash')}")
def jn09_change_diff(spark, sf):
    return changes.change_diff(media(spark, sf, False), later_media(spark, sf))


@query(f"WITH {FILES_SQL}, {LATER_SQL}, d AS ({_DIFF.format(quick='')}) SELECT change, count(*) AS files FROM d GROUP BY 1")
def flt13_fast_rescan(spark, sf):
    return changes.change_diff(media(spark, sf, False), later_media(spark, sf), quick=False).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


_IGNORED = "ignored AS (SELECT path FROM files JOIN labels ON id = doc_id WHERE quality = 0)"


def _ignored(spark, sf):
    poor = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return media(spark, sf, False).join(poor, "id", "left_semi").select("path")


@query(f"WITH {FILES_SQL}, {_IGNORED} SELECT id, path FROM files WHERE path NOT IN (FROM ignored)")
def flt03_without_ignored(spark, sf):
    return changes.without_ignored(media(spark, sf, False).select("id", "path"), _ignored(spark, sf))


@query(f"WITH {FILES_SQL}, {LATER_SQL}, {_IGNORED} SELECT path FROM files WHERE path NOT IN (SELECT path FROM later) AND path NOT IN (FROM ignored)")
def jn10_removed_files(spark, sf):
    return changes.removed(media(spark, sf, False).select("path"), later_media(spark, sf), _ignored(spark, sf))


_STORED = "stored AS (SELECT x.path AS \"left\", y.path AS \"right\", (64 - bit_count(xor(x.h, y.h))) * 100.0::DOUBLE / 64 AS percent FROM media x JOIN media y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 3)"


def _stored(spark, sf, m=None, *carried):
    """The pairs of paths, and the columns `carried` of both ends (left_*, right_*), which an index with repeated ids leaves out."""
    m = media(spark, sf) if m is None else m
    p = hamming.hamming_pairs(m.select("id", "h", "path", *carried), 3)
    if "left_path" in p.columns:
        return p.select(F.col("left_path").alias("left"), F.col("right_path").alias("right"), ((64 - F.col("distance")) * 100.0 / 64).alias("percent"), *[f"{side}_{c}" for c in carried for side in ("left", "right")])
    a, b = m.select(F.col("id").alias("left_id"), F.col("path").alias("left")), m.select(F.col("id").alias("right_id"), F.col("path").alias("right"))
    return p.join(a, "left_id").join(b, "right_id").select("left", "right", ((64 - F.col("distance")) * 100.0 / 64).alias("percent"))


_GONE = "gone AS (SELECT path FROM files WHERE path NOT IN (SELECT path FROM later))"


def _gone(spark, sf):
    return media(spark, sf, False).join(later_media(spark, sf).select("path"), "path", "left_anti").select("path")


@query(f"WITH {MEDIA_SQL}, {LATER_SQL}, {_STORED}, {_GONE} SELECT * FROM stored WHERE \"left\" NOT IN (FROM gone) AND \"right\" NOT IN (FROM gone)")
def jn11_missing_cleanup(spark, sf):
    m = media(spark, sf)
    return changes.forget(m, _stored(spark, sf, m), checkpointed(_gone(spark, sf)))[1]


@query(f"WITH {FILES_SQL}, {LATER_SQL}, {_GONE} SELECT path, size, modified FROM files WHERE path NOT IN (FROM gone)")
def snk03_forget_files(spark, sf):
    m = media(spark, sf, False)
    none = spark.createDataFrame([], "left string, right string, percent double")
    return changes.forget(m, none, _gone(spark, sf))[0].select("path", "size", "modified")


@query(f"WITH {MEDIA_SQL}, {_STORED} SELECT s.*, a.size = b.size AND a.quick_hash = b.quick_hash AND a.sha256 = b.sha256 AS content_identical FROM stored s JOIN files a ON s.\"left\" = a.path JOIN files b ON s.\"right\" = b.path")
def jn12_content_identical(spark, sf):
    m = media(spark, sf)
    return changes.content_identical(_stored(spark, sf, m, *changes.CONTENT), m)


@query(f"WITH {MEDIA_SQL}, {LATER_SQL}, {_STORED}, fresh AS (SELECT m.path FROM media m JOIN later l ON m.path = l.path AND m.size = l.size AND m.modified = l.modified AND m.h <> 0) SELECT * FROM stored WHERE \"left\" IN (FROM fresh) AND \"right\" IN (FROM fresh) AND percent >= 97")
def jn13_revalidate(spark, sf):
    m = media(spark, sf)
    return changes.revalidate(_stored(spark, sf, m), m.select("path", "size", "modified", "h"), later_media(spark, sf), 97.0)


_CHANGED = "changed AS (SELECT path FROM files JOIN labels ON id = doc_id WHERE toxic = 1)"


@query(f"WITH {MEDIA_SQL}, {_STORED}, {_CHANGED}, kept AS (SELECT * FROM stored WHERE \"left\" NOT IN (FROM changed) AND \"right\" NOT IN (FROM changed)), emitted AS (SELECT * FROM stored WHERE percent >= 98), u AS (FROM kept UNION ALL FROM emitted) SELECT least(\"left\", \"right\") AS \"left\", greatest(\"left\", \"right\") AS \"right\", max(percent) AS percent FROM u GROUP BY 1, 2")
def jn14_survivors(spark, sf):
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    m = media(spark, sf)
    changed = m.join(toxic, "id", "left_semi").select("path")
    marked = m.join(toxic.distinct().select("id", F.lit(True).alias("changed")), "id", "left").withColumn("changed", F.col("changed").isNotNull())
    pairs = _stored(spark, sf, marked, "changed")
    if "left_changed" in pairs.columns and m.where("path is null").isEmpty() and m.groupBy("path").count().where("count > 1").isEmpty():  # no pair comes twice
        return pairs.where("not left_changed and not right_changed or percent >= 98").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "percent")
    stored = checkpointed(_stored(spark, sf, m))
    return changes.survivors(stored, changed, stored.where("percent >= 98"))


@query(f"WITH {FILES_SQL}, {LATER_SQL}, d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.sha256 <> b.sha256 THEN 'changed' END AS change FROM files a FULL JOIN later b ON a.path = b.path) SELECT * FROM d WHERE change IS NOT NULL")
def jn15_index_diff(spark, sf):
    return changes.index_diff(media(spark, sf, False), later_media(spark, sf), ["size", "sha256"])


@query(f"WITH {FILES_SQL}, {LATER_SQL} SELECT path, 'left' AS side FROM (SELECT path FROM files EXCEPT SELECT path FROM later) UNION ALL SELECT path, 'right' FROM (SELECT path FROM later EXCEPT SELECT path FROM files)")
def set04_symmetric_difference(spark, sf):
    return changes.symmetric_difference(media(spark, sf, False), later_media(spark, sf), ["path"])


@query(f"WITH {FILES_SQL}, {LATER_SQL} SELECT path, size, modified FROM later UNION ALL SELECT path, size, modified FROM files WHERE path NOT IN (SELECT path FROM later)")
def snk01_upsert(spark, sf):
    keep = ["path", "size", "modified"]
    return changes.upsert(media(spark, sf, False).select(*keep), later_media(spark, sf).select(*keep))


@query(f"WITH {FILES_SQL}, {LATER_SQL}, scratch AS (SELECT path, size FROM later WHERE kind = 2), m AS (SELECT path, size, kind FROM files) SELECT path, size FROM m WHERE kind <> 2 UNION ALL FROM scratch")
def snk11_adopt(spark, sf):
    main = media(spark, sf, False).select("path", "size")
    scratch = later_media(spark, sf).where("kind = 2").select("path", "size")
    return changes.adopt(main, scratch, S.media_kind("path") == 2)


@query("""WITH ev AS (SELECT user_id::VARCHAR AS path, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'start' WHEN 'view' THEN 'admit' END AS event, epoch_us(ts) // 1000 AS at_ms, event_type AS outcome FROM events),
a AS (SELECT path, max(at_ms) AS admitted_ms FROM ev WHERE event = 'admit' GROUP BY 1)
SELECT path, admitted_ms, coalesce(min(CASE WHEN event = 'start' THEN at_ms END), 0) AS started_ms, coalesce(max(CASE WHEN event = 'finish' THEN at_ms END), 0) AS finished_ms, coalesce(max(CASE WHEN event = 'finish' THEN outcome END), '') AS outcome
FROM ev JOIN a USING (path) WHERE at_ms >= admitted_ms GROUP BY 1, 2""")
def snk04_traces(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "admit")
    return changes.traces(e.select(F.col("user_id").cast("string").alias("path"), kind.alias("event"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("outcome")))


@query(f"WITH {FILES_SQL} SELECT kind, count(*) AS files, sha256(string_agg(path || ';' || size || ';' || sha256 || '|', '' ORDER BY path)) AS fingerprint FROM files GROUP BY kind")
def agg18_dataset_fingerprint(spark, sf):
    return changes.dataset_fingerprint(media(spark, sf, False).withColumnRenamed("path", "rel"), ["kind"])


# ---------------------------------------------------------------- benchmark analytics

_STATS = "count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95"
_ACC = "count(*) AS observed, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded"
_RUN_ROWS = "rr AS (SELECT *, CASE WHEN run_status IS NULL THEN 'Invalid' WHEN run_status <> 'SUCCESS' THEN upper(run_status[1]) || lower(run_status[2:]) WHEN wall_ms IS NULL THEN 'MissingElapsed' END AS reason FROM runs), rv AS (SELECT *, CASE WHEN reason IS NULL THEN wall_ms END AS value FROM rr)"
_MODE_ROWS = "mr AS (SELECT m.*, r.dataset_fp, r.scope, r.build, r.commit_state, r.commit, CASE WHEN status <> 'SUCCESS' THEN upper(status[1]) || lower(status[2:]) WHEN elapsed_ms IS NULL THEN 'MissingElapsed' END AS reason FROM modes m JOIN runs r USING (run_id)), mv AS (SELECT *, CASE WHEN reason IS NULL THEN elapsed_ms END AS value FROM mr)"


@query(f"WITH {FACTS_SQL}, {_RUN_ROWS} SELECT dataset_fp, scope, build, commit_state, commit, {_ACC}, {_STATS}, CASE grouping(dataset_fp, scope, build, commit_state, commit) WHEN 15 THEN 'dataset' WHEN 7 THEN 'scope' ELSE 'build' END AS level FROM rv GROUP BY GROUPING SETS ((dataset_fp), (dataset_fp, scope), (dataset_fp, scope, build, commit_state, commit))")
def agg02_rollup(spark, sf):
    return cohorts.rollup(runs(spark, sf))


@query(f"WITH {FACTS_SQL}, {_MODE_ROWS} SELECT dataset_fp, scope, build, requested_mode, effective_mode, {_ACC}, {_STATS} FROM mv GROUP BY 1, 2, 3, 4, 5")
def agg02_mode_stats(spark, sf):
    return cohorts.mode_stats(modes(spark, sf), runs(spark, sf))


@query("SELECT l_returnflag, " + _STATS.replace("value", "l_extendedprice") + " FROM lineitem GROUP BY 1")
def agg01_duration_statistics(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*cohorts.statistics("l_extendedprice"))


@query(f"WITH {FACTS_SQL} SELECT dataset_fp, scope, run_status AS status, count(*) AS n FROM runs GROUP BY 1, 2, 3")
def agg03_status_tally(spark, sf):
    return cohorts.status_tally(runs(spark, sf), ["dataset_fp", "scope"], "run_status")


@query(f"WITH {FACTS_SQL}, {_MODE_ROWS} SELECT dataset_fp, reason, count(*) AS n FROM mv WHERE reason IS NOT NULL GROUP BY 1, 2")
def agg04_exclusion_tally(spark, sf):
    m = modes(spark, sf).join(runs(spark, sf).select("run_id", "dataset_fp"), "run_id").withColumn("reason", cohorts.exclusion("status", "elapsed_ms"))
    return cohorts.exclusion_tally(m, ["dataset_fp"])


@query(f"WITH {FACTS_SQL}, c AS (SELECT r.dataset_fp, m.requested_mode, CASE WHEN c.status <> 'SUCCESS' THEN c.status WHEN m.status <> 'SUCCESS' THEN m.status END AS s FROM modes m JOIN cases c USING (run_id, case_id) JOIN runs r USING (run_id)) SELECT dataset_fp, requested_mode, count(*) AS observed, count(*) FILTER (WHERE s IS NULL) AS eligible, count(*) FILTER (WHERE s IS NOT NULL) AS excluded FROM c GROUP BY 1, 2")
def agg05_case_for_mode(spark, sf):
    m = modes(spark, sf).withColumnRenamed("status", "m_status").drop("elapsed_ms").join(cases(spark, sf).select("run_id", "case_id", F.col("status").alias("c_status")), ["run_id", "case_id"]).join(runs(spark, sf).select("run_id", "dataset_fp"), "run_id")
    return m.withColumn("reason", cohorts.case_exclusion("c_status", "m_status")).groupBy("dataset_fp", "requested_mode").agg(*cohorts.accounting())


@query(f"WITH {FACTS_SQL}, c AS (SELECT c.*, dataset_fp, CASE WHEN status <> 'SUCCESS' THEN status END AS reason FROM cases c JOIN runs USING (run_id)), v AS (SELECT *, CASE WHEN reason IS NULL THEN elapsed_ms END AS value FROM c) SELECT dataset_fp, case_id, arg_min(path, run_id) AS path, {_ACC}, {_STATS} FROM v GROUP BY 1, 2")
def agg06_case_rollup(spark, sf):
    return cohorts.case_rollup(cases(spark, sf), runs(spark, sf))


@query("WITH p AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS runs, count(*) AS distinct_runs, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS colliding FROM p")
def agg07_colliding_runs(spark, sf):
    return cohorts.colliding_runs(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id")))


@query(f"WITH {FACTS_SQL} SELECT build, commit_state, dataset_fp, list_sort(list(DISTINCT run_id)) AS members FROM runs GROUP BY 1, 2, 3")
def agg08_cohort_members(spark, sf):
    return cohorts.cohort_members(runs(spark, sf), ["build", "commit_state", "dataset_fp"], "run_id")


@query(f"WITH {FACTS_SQL} SELECT run_id, case_id, CASE WHEN bool_or(status = 'CANCELLED') THEN 'CANCELLED' WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' ELSE 'SKIPPED' END AS status FROM modes GROUP BY 1, 2")
def agg09_case_status(spark, sf):
    return cohorts.case_status(modes(spark, sf))


@query(f"WITH {FACTS_SQL} SELECT run_id, count(*) AS cases, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("SUCCESS", "FAILED", "CANCELLED", "SKIPPED")) + ", sum(elapsed_ms) AS total_ms FROM cases GROUP BY 1")
def agg10_journal_summary(spark, sf):
    from ..sources.journal import summary

    return summary(cases(spark, sf))


_SIDE = f"side AS (SELECT dataset_fp, scope, build, commit_state, commit, {_STATS} FROM rv GROUP BY 1, 2, 3, 4, 5)"


@query(
    f"""WITH {FACTS_SQL}, {_RUN_ROWS}, {_SIDE}, p AS (SELECT a.dataset_fp, a.scope, a.build AS l_build, b.build AS r_build, {', '.join(f'a.{s} AS l_{s}, b.{s} AS r_{s}' for s in cohorts.STATISTICS)} FROM side a JOIN side b ON a.dataset_fp = b.dataset_fp AND a.scope = b.scope AND a.build < b.build),
x AS ({' UNION ALL '.join(f"SELECT dataset_fp, scope, l_build, r_build, '{s}' AS statistic, l_{s} AS left_value, r_{s} AS right_value FROM p" for s in cohorts.STATISTICS)})
SELECT *, round(right_value - left_value, 6) AS delta_ms, round((right_value - left_value) / nullif(left_value, 0) * 100.0, 6) AS delta_percent, round(right_value / nullif(left_value, 0), 6) AS ratio,
CASE WHEN left_value IS NULL AND right_value IS NULL THEN 'BothStatisticsAbsent' WHEN left_value IS NULL THEN 'LeftStatisticAbsent' WHEN right_value IS NULL THEN 'RightStatisticAbsent' WHEN left_value = 0 THEN 'ZeroLeftReference' END AS unavailable FROM x"""
)
def agg12_comparison_metrics(spark, sf):
    r = runs(spark, sf).withColumn("reason", cohorts.exclusion("run_status", "wall_ms")).withColumn("value", F.when(F.col("reason").isNull(), F.col("wall_ms")))
    side = r.groupBy("dataset_fp", "scope", "build", "commit_state", "commit").agg(*cohorts.statistics("value"))
    a = side.select("dataset_fp", "scope", F.col("build").alias("l_build"), *[F.col(s).alias(f"l_{s}") for s in cohorts.STATISTICS])
    b = side.select("dataset_fp", "scope", F.col("build").alias("r_build"), *[F.col(s).alias(f"r_{s}") for s in cohorts.STATISTICS])
    return cohorts.comparison_metrics(a.join(b, ["dataset_fp", "scope"]).where("l_build < r_build"))


@query(
    f"""WITH {FACTS_SQL}, {_RUN_ROWS}, {_MODE_ROWS},
rs AS (SELECT dataset_fp, scope, build, commit_state, commit, count(*) FILTER (WHERE reason IS NULL) AS n FROM rv GROUP BY 1, 2, 3, 4, 5),
ms AS (SELECT dataset_fp, scope, build, commit_state, commit, requested_mode, effective_mode, count(*) FILTER (WHERE reason IS NULL) AS n FROM mv GROUP BY 1, 2, 3, 4, 5, 6, 7),
cs AS (SELECT dataset_fp, scope, build, commit_state, commit, requested_mode, effective_mode, count(*) FILTER (WHERE m.status = 'SUCCESS' AND c.status = 'SUCCESS') AS n FROM mv m JOIN cases c USING (run_id, case_id) GROUP BY 1, 2, 3, 4, 5, 6, 7),
runp AS (SELECT 'RunWall' AS metric, 'BuildProvenance' AS dimension, a.dataset_fp AS d, a.commit_state = 'Known' AND b.commit_state = 'Known' AS known, a.n AS ln, b.n AS rn, true AS same_mode FROM rs a JOIN rs b ON a.dataset_fp = b.dataset_fp AND a.scope = b.scope AND (a.build, a.commit_state, a.commit) < (b.build, b.commit_state, b.commit)),
sides AS (SELECT 'ModeElapsed' AS metric, * FROM ms UNION ALL SELECT 'CaseElapsed', * FROM cs),
buildp AS (SELECT a.metric, 'BuildProvenance', a.dataset_fp, a.commit_state = 'Known' AND b.commit_state = 'Known', a.n, b.n, true FROM sides a JOIN sides b ON a.metric = b.metric AND a.dataset_fp = b.dataset_fp AND a.scope = b.scope AND a.requested_mode = b.requested_mode AND a.effective_mode = b.effective_mode AND (a.build, a.commit_state, a.commit) < (b.build, b.commit_state, b.commit)),
modep AS (SELECT a.metric, 'ModeSemantics', a.dataset_fp, true, a.n, b.n, false FROM sides a JOIN sides b ON a.metric = b.metric AND a.dataset_fp = b.dataset_fp AND a.scope = b.scope AND a.build = b.build AND a.commit = b.commit AND (a.requested_mode, a.effective_mode) < (b.requested_mode, b.effective_mode)),
u AS (FROM runp UNION ALL FROM buildp UNION ALL FROM modep)
SELECT metric, dimension, CASE WHEN dimension = 'BuildProvenance' AND NOT known THEN 'MissingProvenance' WHEN ln = 0 OR rn = 0 THEN 'NoComparableSamples' ELSE 'Eligible' END AS eligibility, count(*) AS candidates FROM u GROUP BY 1, 2, 3"""
)
def jn20_comparison_candidates(spark, sf):
    c = cohorts.comparison_candidates(runs(spark, sf), modes(spark, sf), cases(spark, sf))
    return c.groupBy("metric", "dimension", "eligibility").agg(F.count(F.lit(1)).alias("candidates"))


@query("SELECT l_partkey AS case_id, max(l_quantity) AS elapsed_ms FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def srt05_slowest(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("case_id")).agg(F.max("l_quantity").alias("elapsed_ms")).orderBy(F.desc("elapsed_ms"), "case_id").limit(20)


# ---------------------------------------------------------------- series


@query(f"WITH {SERIES_SQL}, w AS (SELECT key, id, t, CASE WHEN count(*) OVER x >= 2 AND t - min(t) OVER x > 0 THEN sum(value) OVER x / (t - min(t) OVER x) ELSE -1 END AS rate FROM series WINDOW x AS (PARTITION BY key ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)) SELECT key, id, round(rate, 6) AS rate FROM w")
def win03_rolling_rate(spark, sf):
    e = event_series(spark, sf).withColumnRenamed("value", "units")
    return series.rolling_rate(e, 3600).select("key", "id", F.round("rate", 6).alias("rate"))


@query(f"WITH {SERIES_SQL}, v AS (SELECT key, id, t, CASE WHEN type <> 'purchase' THEN value END AS value FROM series), i AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t, id) AS island FROM v) SELECT key, id, round(CASE WHEN value IS NOT NULL THEN avg(value) OVER (PARTITION BY key, island ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS average FROM i")
def win04_moving_average(spark, sf):
    e = event_series(spark, sf).withColumn("value", F.when(F.col("type") != "purchase", F.col("value"))).withColumn("t", F.struct("t", "id"))
    return series.moving_average(e, 5).select("key", "id", F.round("average", 6).alias("average"))


@query(f"WITH {SERIES_SQL}, v AS (SELECT key, id, t, value, CASE WHEN value > 0 THEN abs(value - 50) / 50 > 0.5 ELSE false END AS off FROM series), f AS (SELECT *, CASE WHEN NOT off OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY key ORDER BY t, id)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t, id) AS island FROM f), r AS (SELECT *, sum(off::INT) OVER (PARTITION BY key, island ORDER BY t, id) AS run FROM i) SELECT key, id FROM r WHERE off AND run % 3 = 0")
def win11_deviation_triggers(spark, sf):
    e = event_series(spark, sf).select("key", F.lit("p").alias("profile"), F.struct("t", "id").alias("t"), F.col("value").alias("live"), F.lit(50.0).alias("expected"))
    return series.deviation_triggers(e, 0.5, 3).select("key", F.col("t.id").alias("id"))


@query(f"WITH {SERIES_SQL}, m AS (SELECT type AS key, median(value) AS med FROM series GROUP BY 1) SELECT s.type AS key, round(any_value(med), 6) AS med, round(median(abs(value - med)), 6) AS mad, round(greatest(8, any_value(med) + 3 * median(abs(value - med))), 6) AS threshold FROM series s JOIN m ON s.type = m.key GROUP BY 1")
def agg26_cut_threshold(spark, sf):
    e = event_series(spark, sf).select(F.col("type").alias("key"), F.col("value").alias("delta"))
    return series.cut_threshold(e).select("key", *[F.round(c, 6).alias(c) for c in ("med", "mad", "threshold")])


@query(f"WITH {SERIES_SQL}, l AS (SELECT key, id, t FROM series WHERE type = 'purchase'), r AS (SELECT key, id AS rid, t AS s FROM series WHERE type = 'click'), h AS (SELECT l.key, l.id AS lid, r.rid, abs(l.t - r.s) AS gap, row_number() OVER (PARTITION BY l.key, l.id ORDER BY abs(l.t - r.s), r.s, r.rid) AS n FROM l JOIN r ON l.key = r.key AND abs(l.t - r.s) <= 7200) SELECT key, lid, rid, round(gap, 3) AS gap FROM h WHERE n = 1")
def jn17_nearest_join(spark, sf):
    e = event_series(spark, sf)
    left = e.where("type = 'purchase'").select("key", F.col("id").alias("lid"), "t")
    right = e.where("type = 'click'").select("key", F.col("id").alias("rid"), F.col("t").alias("s"))
    return series.nearest_join(left, right, 7200.0).withColumn("gap", F.round("gap", 3))


@query(f"WITH {SERIES_SQL}, b AS (SELECT key, t, id, value, lag(value) OVER (PARTITION BY key ORDER BY t, id) AS before FROM series) SELECT key, id FROM b WHERE before IS NOT NULL AND abs(value - before) > 60")
def win01_changes(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("t", "id")
    return event_series(spark, sf).withColumn("before", F.lag("value").over(w)).where(F.abs(F.col("value") - F.col("before")) > 60).select("key", "id")


@query(f"WITH {SERIES_SQL}, f AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY t, id) - 1)::BIGINT AS i, t AS ts, value AS sd, 8 AS n FROM series), g AS (SELECT *, min(ts) OVER (PARTITION BY key) AS t0, max(ts) OVER (PARTITION BY key) AS t1 FROM f), s AS (SELECT *, CASE WHEN t1 <= t0 THEN 0 ELSE least(3, floor((ts - t0) / (t1 - t0) * 4)) END AS seg FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY key, seg ORDER BY sd DESC, i) = 1 AS best FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY best DESC, sd DESC, i) AS rank FROM b) SELECT key, i FROM r WHERE rank <= 8")
def win05_kept_frames(spark, sf):
    return series.kept_frames(_frames(spark, sf), 8).select("key", "i")


def _frames(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("t", "id")
    return event_series(spark, sf).select("key", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("t").alias("ts"), F.col("value").alias("sd"))


@query(f"WITH {SERIES_SQL}, f AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY t, id) - 1)::BIGINT AS i, value AS sd FROM series), g AS (SELECT *, sd >= 6 AS good FROM f), p AS (SELECT *, floor(sum(good::INT) OVER (PARTITION BY key) * 100 / count(*) OVER (PARTITION BY key)) AS percent, row_number() OVER (PARTITION BY key ORDER BY good DESC, sd DESC, i) AS rank FROM g) SELECT key, i FROM p WHERE percent < 30 OR good AND rank <= 12")
def win07_kept_by_variance(spark, sf):
    return series.kept_by_variance(_frames(spark, sf), 12).select("key", "i")


@query(f"WITH {SERIES_SQL}, a AS (SELECT DISTINCT key, round(t)::BIGINT AS ms FROM series WHERE type = 'click'), b AS (SELECT DISTINCT key, round(t)::BIGINT AS ms FROM series WHERE type = 'view') SELECT key, coalesce(a.ms, b.ms) AS t, CASE WHEN b.ms IS NULL THEN 1 WHEN a.ms IS NULL THEN 2 ELSE 3 END AS tag FROM a FULL JOIN b USING (key, ms)".replace("coalesce(a.ms, b.ms) AS t", "ms AS t"))
def jn19_merged_plans(spark, sf):
    e = event_series(spark, sf).select("key", "type", F.round("t").alias("ts"))
    plan = lambda t: e.where(F.col("type") == t).select("key", "ts").distinct()
    return series.merged_plans(plan("click"), plan("view")).select("key", F.col("ts").cast("long").alias("t"), "tag")


# ---------------------------------------------------------------- scalar functions


@query(f"WITH {FILES_SQL} SELECT id, kind, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{{:.1f}} KB', round(size / 1024, 1)) ELSE format('{{:.2f}} MB', round(size / 1048576, 2)) END AS human FROM files")
def flt01_kind_and_size(spark, sf):
    m = media(spark, sf, False)
    return m.select("id", S.media_kind("path").alias("kind"), S.human_size("size").alias("human"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(replace(url, '\\', '/'), '/{2,}', '/', 'g'), '(.)/$', '\\1') AS path FROM pages), b AS (SELECT *, regexp_extract(path, '([^/\\\\]*)$', 1) AS base FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN base = '' THEN 'root' ELSE base END, '[^A-Za-z0-9._-]', '_', 'g'), '[_.]+$', '') AS clean FROM b)
SELECT page_id, path, substr(CASE WHEN clean = '' THEN 'root' ELSE clean END, 1, 48) AS label FROM c"""
)
def fn05_canonical_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.canonical_path("url").alias("path"), S.source_label(S.canonical_path("url")).alias("label"))


@query("SELECT page_id, contains(lower(url), 'example.com') AS hit, url = 'http:' OR starts_with(url, 'http:/') AS within FROM pages")
def flt15_within_root(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.contains(F.lower("url"), F.lit("example.com")).alias("hit"), S.within_root("url", F.lit("http:")).alias("within"))


@query(
    f"""WITH {FILES_SQL}, d AS (SELECT id, duration AS d FROM files) SELECT id, CASE WHEN d <= 0 THEN 0 WHEN d <= 10 THEN 1 WHEN d <= 60 THEN 2 WHEN d <= 240 THEN 4 WHEN d <= 960 THEN 8 WHEN d <= 3840 THEN 16 ELSE 32 END AS step,
CASE WHEN NOT d > 0 THEN 0 WHEN d <= 15 THEN 0 WHEN d <= 60 THEN 1 WHEN d <= 180 THEN 2 WHEN d <= 600 THEN 3 WHEN d <= 1500 THEN 4 WHEN d <= 3600 THEN 5 WHEN d <= 9000 THEN 6 ELSE 7 END AS cohort FROM d"""
)
def fn12_sampling_and_cohorts(spark, sf):
    return media(spark, sf, False).select("id", S.sampling_step("duration").alias("step"), S.duration_cohort("duration").alias("cohort"))


@query(f"WITH {FILES_SQL}, v AS (SELECT id, duration FROM files WHERE kind = 2) SELECT a.id AS a, count(*) FILTER (WHERE least(a.duration, b.duration) < 1 OR greatest(a.duration, b.duration) / least(a.duration, b.duration) <= 4) AS gated, count(*) FILTER (WHERE least(a.duration, b.duration) > 0 AND CASE WHEN least(a.duration, b.duration) < 1200 THEN abs(a.duration - b.duration) <= 90 ELSE greatest(a.duration, b.duration) / least(a.duration, b.duration) <= 1.2 END) AS banded FROM v a JOIN v b ON a.id < b.id GROUP BY 1")
def flt08_duration_gates(spark, sf):
    v = media(spark, sf, False).where("kind = 2").select("id", "duration")
    a, b = v.select(F.col("id").alias("a"), F.col("duration").alias("x")), v.select(F.col("id").alias("b"), F.col("duration").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).groupBy("a").agg(F.count_if(S.duration_gate("x", "y")).alias("gated"), F.count_if(S.duration_band("x", "y")).alias("banded"))


@query("SELECT event_id, CASE WHEN value >= 95 OR value % 100 >= 95 THEN 'Critical' WHEN value >= 90 OR value % 100 >= 80 THEN 'Heavy' WHEN value >= 80 OR value % 100 >= 55 THEN 'Busy' WHEN value >= 65 OR value % 100 >= 25 THEN 'Light' ELSE 'Idle' END AS load FROM (SELECT event_id, least(value, 91) AS value FROM events)")
def fn20_load_class(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.least("value", F.lit(91.0)))
    return e.select("event_id", S.load_class(F.col("v") % 100 * 0, "v", F.col("v") % 100).alias("load"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '' THEN 'Legacy' WHEN o_orderpriority = 'unknown' THEN 'Unknown' ELSE 'Known' END AS state, CASE WHEN o_orderstatus IS NULL THEN 'Missing' WHEN o_orderstatus = '' THEN 'Empty' ELSE 'Valid' END AS dataset FROM orders")
def prj02_states(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.provenance("o_orderpriority").alias("state"), S.dataset_state("o_orderstatus").alias("dataset"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:5] || '...' || p_name[-4:] END AS short, p_name ILIKE '%a%' AS hit FROM part")
def prj08_ellipsis(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.ellipsis_middle("p_name", 12).alias("short"), F.contains(F.lower("p_name"), F.lit("a")).alias("hit"))


@query(f"WITH {FP_SQL} SELECT bit_xor(h)::BIGINT AS folded, count(*) AS n FROM fp")
def agg17_xor_fold(spark, sf):
    d = _documents(spark, sf)
    return d.agg(F.bit_xor("h").alias("folded"), F.count(F.lit(1)).alias("n"))

