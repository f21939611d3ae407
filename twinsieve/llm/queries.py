"""The queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op9_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))



def op10_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024)


def op8_polynomial_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


#: The rules of the contract: verdict, host, path prefix.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: Names whose hosts are listed: every host with one of them as a label, under any domain and with any label before it.
LISTED_NAMES = ["spam-farm", "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track"]


def listed_urls(pages: DataFrame) -> DataFrame:
    """The URLs of `pages` on listed hosts; they grow with the table."""
    from .urls import host_of

    return pages.where(F.arrays_overlap(F.split(host_of(F.col("url")), r"[.:]"), F.array(*map(F.lit, LISTED_NAMES)))).select("url")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, listed_table

    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, listed_table(listed_urls(pages)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_log_frequency_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import fifth, score

    return score(table(spark, sf_dir, "documents"), fifth() == 1)


def op7_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import fifth
    from .toxicity import score

    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fifth() == 0).alias("held_out"), F.col("_ts_toxicity").alias("score"), F.when(F.col("_ts_toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_e8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_groups

    return near_groups(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import weighed

    out = weighed(table(spark, sf_dir, "documents"), keep=0.7)
    return out.select("doc_id", "source", "lang", F.col("_ts_topic").alias("topic"), F.col("_ts_tokens").alias("tokens"), F.col("_ts_weight").alias("weight"), F.col("_ts_p").alias("probability"), F.col("_ts_in").alias("sampled"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), least=100).drop("kept")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | _pipeline()


def _pipeline() -> dict:
    import corpus_pipeline

    return {"pipeline": lambda spark, sf_dir: corpus_pipeline.run(spark, sf_dir)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that neither learn, rake, pack nor search by similarity."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    names = ", ".join(f"'{x}'" for x in LISTED_NAMES)
    return {
        "op1_url_filter": rf"""
WITH parts AS (SELECT page_id,
       translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     urls AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') AS canonical FROM parts),
     listed_urls AS (SELECT DISTINCT canonical FROM urls WHERE list_has_any(regexp_split_to_array(host, '[.:]'), [{names}])),
     rules(verdict, host, prefix) AS (VALUES {rules})
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM urls u LEFT JOIN listed_urls l ON u.canonical = l.canonical
LEFT JOIN LATERAL (SELECT x.host || x.prefix AS rule, x.verdict FROM rules x
                   WHERE (u.host = x.host OR ends_with(u.host, '.' || x.host)) AND starts_with(u.path, x.prefix)
                   ORDER BY length(x.host || x.prefix) DESC, rule DESC, x.verdict DESC LIMIT 1) r ON true""",
        "op8_polynomial_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW same AS (PARTITION BY text_sha256)""",
    }
