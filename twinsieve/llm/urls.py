"""Operator 1: URL filters by a blocked Bloom filter and an exact hash join.

A list holds canonical URLs and rules. A rule is a host, which stands for its subdomains too, and a prefix of the path.
Every URL yields the few keys under which the list could hold it: its canonical form, and each suffix of its host with
each path prefix of a length that the rules have. The filter, of bounded size, passes possible hits; only those go
through the exact hash join, which removes the false ones. The longest rule wins; without a rule a listed URL is blocked
and another allowed. The exact list is broadcast while it has at most MAX_BROADCAST_ROWS rows; a longer one is joined by
a shuffle, whose hot keys adaptive execution splits.

Null and malformed URLs have an empty host and path: no rule, allowed. Every row gets one row, repeated ones and those
without an id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import cut

MAX_BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, query, fragment, default port, leading www. or m., .html and closing slash."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html?)?/*$", ""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """From (verdict, host, path prefix)."""
    return spark.createDataFrame([(f"r {h}{p}", v, f"{h}{p}") for v, h, p in rules], "key string, verdict string, rule string")


def listed_table(urls: DataFrame, column: str = "url") -> DataFrame:
    u = F.col(column)
    return urls.select(F.concat(F.lit("u "), canonical(host_of(u), path_of(u))).alias("key"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule")).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of `pages` (page_id, url)."""
    spark = pages.sparkSession
    table = rules_table(spark, rules)
    table = cut(table.unionByName(listed) if listed is not None else table)
    n = table.count()
    sieve = spark.sparkContext.broadcast(bloom.build(table.select(F.xxhash64("key").alias("h")), "h", n))
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.lit(1000)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda p: p.isNotNull())
    keys = F.concat(F.array(F.concat(F.lit("u "), canonical(F.col("host"), F.col("path")))), F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r "), s, p)))))

    @F.pandas_udf("array<boolean>")
    def possible(h):
        import pandas as pd

        sizes = [len(x) for x in h]
        hit = bloom.probe(sieve.value, np.concatenate([np.asarray(x, np.int64) for x in h]) if sum(sizes) else np.zeros(0, np.int64))
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]) if sizes else [])

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tried = urls.withColumn("_rid", F.monotonically_increasing_id()).withColumn("keys", keys)
    tried = tried.withColumn("hits", possible(F.transform("keys", lambda k: F.xxhash64(k))))
    hits = F.filter(F.zip_with("keys", "hits", lambda k, h: F.when(h, k)), lambda k: k.isNotNull())
    asked = tried.select("page_id", "host", "path", "_rid", F.explode_outer(hits).alias("key"))
    found = asked.join(F.broadcast(table) if n <= MAX_BROADCAST_ROWS else table, "key", "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best")
    out = found.groupBy("_rid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best, F.coalesce(F.max(F.col("key").startswith("u ") & F.col("verdict").isNotNull()), F.lit(False)).alias("listed"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
