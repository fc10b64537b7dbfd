"""Operator 1, URL filters by hashed host-suffix and path-prefix expressions. Native: DataFrame functions alone.

Each distinct (host, path) is expanded into its host's suffixes at label borders and its path's prefixes, as far as
their numbers of labels and characters occur among the rules. Expressions meet rules on a short prefix of their SHA-256,
then the full digest must agree; of several rules the longest string wins (then the longer host, then block, then the string).

Defined results: a null url, or one without `://`, has empty host and path and fits no rule; urls that no rule fits get
the default verdict; repeated rows are judged alike; an empty page or rule table gives no rows or default verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT, SHORT, BROADCAST_RULES = "allow", 8, 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(F.lit("")), F.when(at > 0, path).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) rows of a few literal rules."""
    row = F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]))
    return spark.range(1).select(row.alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; rules: (host, path, verdict)."""
    rules = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and verdict is not null")
    # the numbers of labels and path characters that occur: bounded by what hosts and paths of rules can have
    labels = sorted({r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect()})
    sizes = sorted({r[0] for r in rules.select(F.length("path")).distinct().collect()})
    host, path = host_path(F.col("url"))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if not labels:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = F.sha2(F.concat_ws("\x1f", "h", "p"), 256)
    parts = F.split("host", r"\.")
    depths, lengths = (F.lit(x) for x in (labels, sizes))
    suffixes = F.transform(F.filter(depths, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    urls = judged.where("host <> ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(suffixes).alias("h")).select("host", "path", "h", F.explode(prefixes).alias("p")).select("host", "path", digest.alias("digest"))
    hashed = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").select(
        digest.alias("full"), F.concat("h", "p").alias("rule"), F.struct(F.length("h") + F.length("p"), F.length("h"), F.col("verdict") == "block", F.concat("h", "p")).alias("rank"), "verdict"
    )
    hashed = hashed.groupBy("full").agg(F.max_by(F.struct("rank", "rule", "verdict"), "rank").alias("r")).withColumn("short", F.substring("full", 1, SHORT))
    if rules.count() <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)
    hits = expressions.withColumn("short", F.substring("digest", 1, SHORT)).join(hashed, "short").where("digest = full")
    best = hits.groupBy("host", "path").agg(F.max(F.col("r")).alias("r")).select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    fit = judged.where("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
    # urls without a host fit no rule: they stay out of the join, where they would be one key
    return fit.unionByName(judged.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(h, q, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (SELECT p.host, p.path, h || q AS rule, verdict, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(h || q) DESC, length(h) DESC) AS nth
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q))
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path AND nth = 1
"""
