"""Changes of tables as the tables that they leave, and what several models or names agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fields import DANGEROUS, strip
from .substrings import contained

# Least confidence of a valid value and of one with a warning; hazard classes; values that stand for none; lengths of names.
VALID, WARNING = 0.9, 0.7
CLASSES = sorted([*DANGEROUS, "2", "9"])
NOT_FOUND = ["NOT_FOUND", "ERROR", ""]
SHORT_NAME, LONG_NAME, SHORT_MAKER = 3, 200, 2
# What is added to the mean of agreeing models, what is left of the best of others.
AGREED, ALONE = 0.15, 0.95


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with ``changes`` (the same columns and those of ``order``) in place of rows with equal keys; of several changes the last by ``order``, of equal ones the least by its other columns."""
    rest = [c for c in target.columns if c not in keys]
    rows = target.select("*", F.lit(0).alias("__new"), F.lit(None).alias("__at")).unionByName(changes.select(*target.columns, F.lit(1).alias("__new"), F.struct(*order).alias("__at")))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("__at"), *rest)))
    return ranked.filter("__k = 1").select(*target.columns)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` and those rows of ``new`` whose keys it hasn't, of equal ones the first by ``order``."""
    first = new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").select(*target.columns)
    return target.unionByName(first.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def replace_children(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``target`` with the rows of each parent in ``new`` replaced by those of ``new``."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def normal_rules(rules: DataFrame, order: str) -> DataFrame:
    """(cas_a, cas_b, rule): numbers without blanks in their order, the rule in capitals, of each pair the latest by ``order`` (of equal ones the largest rule)."""
    a, b = strip(F.col("cas_a")), strip(F.col("cas_b"))
    rows = rules.select(F.least(a, b).alias("cas_a"), F.greatest(a, b).alias("cas_b"), F.struct(F.col(order).alias("at"), strip(F.upper("rule")).alias("rule")).alias("x"))
    return rows.groupBy("cas_a", "cas_b").agg(F.max("x").alias("x")).select("cas_a", "cas_b", "x.rule")


def validate(field: Column, value: Column, confidence: Column) -> Column:
    """valid, warning or invalid by confidence; a value that isn't there is invalid, and one that breaks its field's own form is at most a warning."""
    n = F.length(value)
    wrong = (
        F.when(field == "un_number", ~value.rlike(r"^\d{4}$")).when(field == "cas_number", ~value.rlike(r"^\d{2,7}-\d{2}-\d$")).when(field == "hazard_class", ~value.isin(*CLASSES))
        .when(field == "packing_group", ~value.isin("I", "II", "III")).when(field == "product_name", (n < SHORT_NAME) | (n > LONG_NAME)).when(field == "manufacturer", n < SHORT_MAKER).otherwise(False)
    )
    sure = F.when(confidence >= VALID, "valid").when(confidence >= WARNING, "warning").otherwise("invalid")
    return F.when(value.isNull() | F.upper(value).isin(*NOT_FOUND), "invalid").when(wrong & (sure == "valid"), "warning").otherwise(sure)


def consensus(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, confidence, source) of the models' answers (keys, model, value, confidence): agreement of two or more raises the mean, else the best
    loses a little (of equal ones the one of the first model). NOT_FOUND, ERROR and null don't count; with nothing else the value is NOT_FOUND with 0."""
    fine = F.col("value").isNotNull() & ~F.col("value").isin("NOT_FOUND", "ERROR")
    held = answers.groupBy(*keys).agg(
        F.count_if(fine).alias("n"), F.count_distinct(F.when(fine, F.col("value"))).alias("values"), F.avg(F.when(fine, F.col("confidence"))).alias("mean"),
        F.min(F.when(fine, F.struct((-F.col("confidence")).alias("c"), "model", "value"))).alias("best"),
    )
    agreed = (F.col("values") == 1) & (F.col("n") > 1)
    sure = F.when(agreed, F.least(F.lit(1.0), F.col("mean") + AGREED)).otherwise(F.coalesce(-F.col("best.c") * ALONE, F.lit(0.0)))
    source = F.when(agreed, "consensus").when(F.col("n") > 0, "best-effort")
    return held.select(*keys, F.coalesce("best.value", F.lit("NOT_FOUND")).alias("value"), sure.alias("confidence"), source.alias("source"))


def match_names(names: DataFrame, products: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(name, cas) of ``names`` (name): the least number of the ``products`` (cas, product_name) whose name holds the name's alias, or else, if it
    has over three characters, the name itself; null if none does. Case and blanks around don't count. Names are compared by their distinct
    spellings, and only with those products' names that have their rarest run of characters."""
    low = F.lower(strip(F.col("name")))
    alias = F.create_map(*[F.lit(x) for p in aliases.items() for x in p])[low] if aliases else F.lit(None).cast("string")
    asked = names.select("name", F.explode(F.array(F.struct(F.lit(0).alias("k"), alias.alias("needle")), F.struct(F.lit(1).alias("k"), F.when(F.length(low) > 3, low).alias("needle")))).alias("a")).select("name", "a.*").distinct()
    known = products.filter("cas is not null and product_name is not null").groupBy(F.lower("product_name").alias("text")).agg(F.min("cas").alias("cas"))
    least = contained(asked.select("needle"), known.select("text")).join(known, "text").groupBy("needle").agg(F.min("cas").alias("cas"))
    found = asked.join(least, "needle", "left").groupBy("name").agg(F.min(F.when(F.col("cas").isNotNull(), F.struct("k", "cas"))).alias("best"))
    return found.select("name", F.col("best.cas").alias("cas"))


def class_pairs(chemicals: DataFrame, rules: DataFrame) -> DataFrame:
    """(cas_a, cas_b, rule) of the chemicals (cas, hazard_class) whose classes a rule (class_a, class_b, rule, priority) pairs, whichever way round: each unordered pair of
    different numbers once, with the rule of the least priority. The result holds all such pairs."""
    c = chemicals.select("cas", "hazard_class").distinct()
    a, b = c.select(F.col("cas").alias("x"), F.col("hazard_class").alias("class_a")), c.select(F.col("cas").alias("y"), F.col("hazard_class").alias("class_b"))
    pairs = a.join(rules, "class_a").join(b, "class_b").filter("x <> y")
    best = pairs.groupBy(F.least("x", "y").alias("cas_a"), F.greatest("x", "y").alias("cas_b")).agg(F.min(F.struct("priority", "rule")).alias("r"))
    return best.select("cas_a", "cas_b", "r.rule")
