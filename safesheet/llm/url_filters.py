"""URL filters by host-suffix and path-prefix expressions (operator 8); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_null_safe

#: (verdict, host, path), as the contract of op8 states them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hexadecimal digits of the short digest that is joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (up to ``?`` or ``#``); empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host at a dot, with every prefix of the path that has the length of some rule's path."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.struct(h.alias("host"), F.substr(path, F.lit(1), n).alias("path")))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def url_filters(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """A row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with its path. The rule with
    the longest host and path wins; of equal ones the longer host, then the one that comes first by text, then allow.
    Without one, rule is null and the verdict is ``default``. Null or odd urls have empty host and path. Verdicts
    are found once for each distinct url, so a hot url or host is worked on once; rows come back by a join on the url.
    The distinct lengths of the rules' paths are read to the driver (at most one number a length). Null rules are left out.
    """
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    rules = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substr("rule_digest", F.lit(1), F.lit(SHORT)))
    host, path = split_url(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    made = urls.select("url", F.explode(expressions(F.col("host"), F.col("path"), lengths or [0])).alias("e"))
    made = made.select("url", _digest(F.col("e.host"), F.col("e.path")).alias("digest")).withColumn("short", F.substr("digest", F.lit(1), F.lit(SHORT)))
    hits = made.join(rules, "short").filter(F.col("digest") == F.col("rule_digest"))
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"),
        F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("c"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("v"),
    )
    best = hits.groupBy("url").agg(F.max(order).alias("best")).select("url", "best.rule", F.col("best.v").alias("verdict"))
    rows = join_null_safe(pages.select("page_id", "url"), best, ["url"], "left")
    return rows.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
