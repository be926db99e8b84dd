"""URL filters: a blocked Bloom filter ahead of an exact hash join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
BROADCAST_RULES = 50_000


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ://."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_filter(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of the longest fitting rule for every row of urls.

    rules: host, path, verdict; a rule fits its host, all subdomains, and paths
    that start with its path. Every row of urls gives one row, repeated rows
    included; null urls have an empty host and path and take the default. Two
    rules of one host and path count once, block before allow. Other columns of
    either table are left out. Empty tables give empty results or the default.

    Candidate keys are host suffixes with path prefixes of the lengths that
    rules have. Those that the filter passes meet the rules in an equi-join,
    once for each distinct host and path.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("rule"), F.concat_ws("\x01", "host", "path").alias("key"), "verdict", F.length("path").alias("n"))
    n_rules, lengths = rules.agg(F.count("*"), F.sort_array(F.collect_set("n"))).first()
    n_blocks = bloom.blocks_for(n_rules)
    words = bloom.build(rules.select("key"), "key", n_blocks).scalar()
    host, path = split_url(F.col(url_col))
    pages = urls.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(int(n)) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(F.col("suffixes"), lambda s: F.transform(F.col("fits"), lambda n: F.concat_ws("\x01", s, F.substring(F.col("path"), F.lit(1), n)))))
    probes = (pages.where("host != ''").select("host", "path").distinct().withColumn("suffixes", suffixes).withColumn("fits", fits)
              .select("host", "path", F.explode(keys).alias("key")).withColumn("words", words)
              .where(bloom.may_contain(F.col("words"), F.col("key"), n_blocks)).drop("words"))
    listed = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules
    decided = (probes.join(listed, "key").groupBy("host", "path")
               .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("won")).select("host", "path", "won"))
    return pages.join(decided, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


ORACLE = """
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
w AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN w ON u.page_id = w.page_id
"""
