"""How well a maker's patterns do on samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import strip

# Shares of samples found that make a field good or fair; lengths and factors of the confidence of a value.
GOOD, FAIR = 0.9, 0.7
SHORT, LONG = (3, 0.5), (200, 0.7)
NO_LETTER = 0.3


def sample_confidence(value: Column) -> Column:
    """Confidence of a found value: 1, halved under three characters, times 0.3 without a letter or digit, times 0.7 over 200 characters; 0 for null."""
    n = F.length(value)
    sure = F.when(n < SHORT[0], SHORT[1]).otherwise(1.0) * F.when(value.rlike(r"[\p{L}\p{N}]"), 1.0).otherwise(NO_LETTER) * F.when(n > LONG[0], LONG[1]).otherwise(1.0)
    return F.when(value.isNull(), 0.0).otherwise(sure)


def found(text: Column, pattern: str) -> Column:
    """The first match of a pattern, its first group if it has one, without blanks around; null if there is none. The dot matches line ends, and ^ and $ at lines."""
    whole = f"(?sm){pattern}"
    grouped = "(" in pattern.replace("\\(", "").replace("(?", "")
    return F.when(text.rlike(whole), strip(F.regexp_extract(text, whole, 1 if grouped else 0)))


def try_patterns(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(file, field_name, value, confidence): each pattern on each sample (file, text); value is null where it isn't found."""
    tried = [F.struct(F.lit(name).alias("field_name"), found(F.col("text"), p).alias("value")) for name, p in patterns.items()]
    rows = samples.select("file", F.explode(F.array(*tried)).alias("t")).select("file", "t.*")
    return rows.withColumn("confidence", sample_confidence(F.col("value")))


def validate_profile(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(field_name, n, successes, rate, avg_confidence, status) of the patterns of a profile on samples (file, text): status is good, fair or poor by the share found;
    avg_confidence is the mean over what was found, 0 if nothing was. Null texts count as samples without a match."""
    rows = try_patterns(samples, patterns).groupBy("field_name").agg(F.count("*").alias("n"), F.count("value").alias("successes"), F.avg(F.when(F.col("value").isNotNull(), F.col("confidence"))).alias("avg"))
    rate = F.col("successes") / F.col("n")
    return rows.select("field_name", "n", "successes", rate.alias("rate"), F.coalesce("avg", F.lit(0.0)).alias("avg_confidence"), F.when(rate >= GOOD, "good").when(rate >= FAIR, "fair").otherwise("poor").alias("status"))


def check_cases(samples: DataFrame, patterns: dict[str, str], cases: DataFrame) -> DataFrame:
    """(file, field_name, expected, value, outcome) of the cases (file, field_name, expected): match, mismatch, not_found, or missing where there is no such sample."""
    tried = try_patterns(samples, patterns).select("file", "field_name", "value")
    have = samples.select("file", F.lit(True).alias("__there")).distinct()
    rows = cases.join(have, "file", "left").join(tried, ["file", "field_name"], "left")
    outcome = F.when(F.col("__there").isNull(), "missing").when(F.col("value").isNull(), "not_found").when(F.col("value") == F.col("expected"), "match").otherwise("mismatch")
    return rows.select("file", "field_name", "expected", "value", outcome.alias("outcome"))
