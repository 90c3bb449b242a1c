"""Hazards of mixtures by the classifications of their components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written

# Least concentration, in percent, at which a mixture has a component's hazard, by code and category; of all others; confidence of what is calculated.
THRESHOLDS = {
    "H300": {"1": 0.1, "2": 1.0, "3": 5.0, "4": 25.0}, "H310": {"1": 0.1, "2": 1.0, "3": 5.0, "4": 25.0}, "H330": {"1": 0.1, "2": 0.5, "3": 1.0, "4": 5.0},
    "H314": {"1A": 1.0, "1B": 5.0, "1C": 5.0}, "H315": {"2": 10.0}, "H318": {"1": 10.0}, "H319": {"2": 10.0},
    "H334": {"1": 0.1, "1A": 0.1, "1B": 1.0}, "H317": {"1": 0.1, "1A": 0.1, "1B": 1.0},
    "H350": {"1A": 0.1, "1B": 0.1, "2": 1.0}, "H351": {"2": 1.0}, "H340": {"1A": 0.1, "1B": 0.1, "2": 1.0}, "H341": {"2": 1.0},
    "H360": {"1A": 0.3, "1B": 0.3, "2": 3.0}, "H361": {"2": 3.0}, "H225": {"2": 10.0}, "H226": {"3": 10.0},
}
OTHERS, SURE = 100.0, 0.9
#: Components that a task sorts, whatever their number in all.
COMPONENTS = 250_000


def threshold(code: Column, category: Column) -> Column:
    pairs = [F.lit(x) for c, by in THRESHOLDS.items() for k, v in by.items() for x in (f"{c} {k}", v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws(" ", code, category)), F.lit(OTHERS))


def plain_number(cas: Column) -> Column:
    """A registry number without its dashes and blanks around."""
    return F.trim(F.replace(cas, F.lit("-"), F.lit("")))


def component_hazards(components: DataFrame, classifications: DataFrame) -> DataFrame:
    """The columns of ``components`` (cas_number, max_concentration, and others) with hazard_code, category, hazard_class, statement and threshold of each classification
    (cas_number, hazard_code, category, hazard_class, statement, source, confidence) whose threshold the component reaches. Numbers are compared without dashes."""
    known = classifications.select(plain_number(F.col("cas_number")).alias("__cas"), "hazard_code", F.coalesce("category", F.lit("")).alias("category"), "hazard_class", "statement", F.col("confidence").alias("__sure"), F.col("source").alias("__source"))
    rows = components.filter("max_concentration > 0").withColumn("__cas", plain_number(F.col("cas_number")))
    # what is known of the components' numbers only: where these are few it is broadcast, and a number of many components isn't one task
    rows = rows.join(written(known.join(rows.select("__cas").distinct(), "__cas", "left_semi"), "known"), "__cas")
    return rows.withColumn("threshold", threshold(F.col("hazard_code"), F.col("category"))).filter(F.col("max_concentration") >= F.col("threshold")).drop("__cas")


def mixture_hazards(components: DataFrame, classifications: DataFrame, key: str = "document_id", order: str = "line_no") -> DataFrame:
    """(``key``, hazard_code, category, hazard_class, statement, source, confidence): of each mixture each code and category once, from the first component by ``order``
    that brings it, and its most confident classification (of equal ones the first source). ``components`` has ``key``, ``order``, cas_number, name and max_concentration."""
    rows = component_hazards(components, classifications)
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, components.count() // COMPONENTS + 1), key)
    first = Window.partitionBy(key, "hazard_code", "category").orderBy(order, F.desc("__sure"), "__source", "hazard_class", "statement")
    best = rows.withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    source = F.concat(F.lit("Calculated from "), F.coalesce("name", "cas_number"))
    return best.select(key, "hazard_code", "category", "hazard_class", "statement", source.alias("source"), F.lit(SURE).alias("confidence"))
