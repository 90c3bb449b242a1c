"""JSON-lines sources, each line with its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE = "cas_a string, cas_b string, rule string, source string, justification string, group_a string, group_b string, metadata string, content_hash string"
HAZARD = "cas string, hazard_flags map<string,boolean>, idlh double, pel double, rel double, env_risk boolean, source string, metadata string, content_hash string"
PAGE = "url string, source string, title string, raw_text string, content string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, at) of the files at ``path``, in order of at inside a file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_hash) of the files at ``path``: what is registered once a file was read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("file_hash"))  # as in text_lines


def parse_lines(lines: DataFrame, schema: str, required: list[str], missing: str) -> DataFrame:
    """The schema's columns, file and ``outcome``: processed, invalid_json, ``missing`` (a required field is null or empty) or duplicate_hash.

    Lines (line, file, at) are equal if their content_hash is, or where they have none their text; of equal ones the first by file and
    place counts. Blank lines are left out."""
    parsed = lines.filter(F.trim("line") != "").withColumn("v", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.coalesce(F.trim(F.col(f"v.{c}")) == "", F.lit(True))
    own = F.sha2("line", 256)
    digest = F.coalesce(F.nullif(F.col("v.content_hash"), F.lit("")), own) if "content_hash" in schema else own
    broken = F.col("v").isNull() | F.col("v._bad").isNotNull()
    first = F.when(broken, "invalid_json").when(lacking, missing)
    order = Window.partitionBy("digest", "first").orderBy("file", "at")
    marked = parsed.select("v", "file", "at", digest.alias("digest"), F.coalesce(first, F.lit("processed")).alias("first"))
    outcome = F.when((F.col("first") == "processed") & (F.row_number().over(order) > 1), "duplicate_hash").otherwise(F.col("first"))
    return marked.withColumn("outcome", outcome).select("v.*", "file", "outcome").drop("_bad")


def read_lines(spark: SparkSession, path: str, schema: str, required: list[str], missing: str, known: DataFrame | None = None) -> DataFrame:
    """``parse_lines`` of the files at ``path``; a file whose hash is in ``known`` (file_hash) is a row with outcome snapshot_exists instead of its lines."""
    lines = text_lines(spark, path)
    if known is None:
        return parse_lines(lines, schema, required, missing).drop("file")
    seen = snapshots(spark, path).join(known.select("file_hash").distinct(), "file_hash").select("file")
    fresh = parse_lines(lines.join(seen, "file", "left_anti"), schema, required, missing)
    return fresh.unionByName(seen.withColumn("outcome", F.lit("snapshot_exists")), allowMissingColumns=True).drop("file")


def read_rules(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    return read_lines(spark, path, RULE, ["cas_a", "cas_b", "rule"], "missing_fields", known)


def read_hazards(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    return read_lines(spark, path, HAZARD, ["cas"], "missing_cas", known)


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether a url's host is one of ``domains`` or below one, in any case; a url without scheme counts as http. False for null."""
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.lower(F.parse_url(F.regexp_replace(whole, r"[\s\\]", ""), F.lit("HOST")))
    held = F.lit(False)
    for d in domains:
        held = held | (host == d.lower()) | F.endswith(host, F.lit(f".{d.lower()}"))
    return F.coalesce(held, F.lit(False))


def read_pages(spark: SparkSession, path: str, domains: list[str] | None = None) -> DataFrame:
    """(url, title, text, outcome) of a crawler's lines: processed, invalid_json, or not_whitelisted where ``domains`` are given. text is
    raw_text, else content; lines without either are left out. url is the line's source where it has no url; without both a line is taken."""
    rows = parse_lines(text_lines(spark, path), PAGE, [], "")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = rows.select(F.coalesce(filled("url"), filled("source")).alias("url"), "title", F.coalesce(filled("raw_text"), filled("content")).alias("text"), F.when(F.col("outcome") == "invalid_json", "invalid_json").otherwise("processed").alias("outcome"))
    rows = rows.filter((F.col("outcome") == "invalid_json") | F.col("text").isNotNull())
    if domains is None:
        return rows
    outside = (F.col("outcome") == "processed") & F.col("url").isNotNull() & ~allowed(F.col("url"), domains)
    return rows.withColumn("outcome", F.when(outside, "not_whitelisted").otherwise(F.col("outcome")))
