"""Decisions on pairs of products, over any tables of products, rules and hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import strip

#: Largest concentration immediately dangerous to life that restricts a product (a parameter of the matrix).
IDLH = 50.0


def tokens(incompatibilities: Column) -> Column:
    """The comma list's parts without blanks around them; empty ones are left out, null has none."""
    return F.filter(F.transform(F.split(F.coalesce(incompatibilities, F.lit("")), ",", -1), strip), lambda t: t != "")


def named(incompatibilities: Column, other: Column) -> Column:
    """Whether a part of the comma list is inside the other product's name, in any case."""
    return F.exists(tokens(incompatibilities), lambda t: F.contains(F.lower(other), F.lower(t)))


def risky(hazards: DataFrame, idlh: float = IDLH) -> DataFrame:
    """(cas) of the hazards (cas, env_risk, hazard_flags map or JSON, idlh) that restrict a product: a risk to the environment, a flag ``dangerous``, or a low concentration."""
    flags = F.col("hazard_flags")
    kind = hazards.schema["hazard_flags"].dataType.typeName()
    dangerous = F.try_element_at(flags, F.lit("dangerous")) if kind == "map" else F.get_json_object(flags, "$.dangerous") == "true"
    return hazards.filter(F.coalesce("env_risk", F.lit(False)) | F.coalesce(dangerous, F.lit(False)) | F.coalesce(F.col("idlh") <= idlh, F.lit(False))).select("cas").distinct()


def compatibility_matrix(products: DataFrame, rules: DataFrame, hazards: DataFrame, idlh: float = IDLH) -> DataFrame:
    """(id_a, id_b, decision, layer) of every ordered pair of ``products`` (document_id, product_name, cas_number, incompatibilities): a cell of the matrix each.

    Products of one name are Self. Else the rule of the two numbers, whichever way round, decides (I: Incompatible, R: Restricted); then whether
    the first product's incompatibilities name the second one (Incompatible); then whether either's hazards restrict it; else they are Compatible.
    Products without a name are left out. The result is the square of the products, as a matrix is; bound them before where that is too much.
    """
    held = risky(hazards, idlh).withColumn("risk", F.lit(True))
    cas = F.col("cas_number")
    p = products.filter("product_name is not null").join(held, cas == held["cas"], "left").select("document_id", "product_name", cas, "incompatibilities", F.coalesce("risk", F.lit(False)).alias("risk"))
    a = p.select(F.col("document_id").alias("id_a"), F.col("product_name").alias("name_a"), F.col("cas_number").alias("one"), F.transform(tokens(F.col("incompatibilities")), F.lower).alias("parts"), F.col("risk").alias("risk_a"))
    b = p.select(F.col("document_id").alias("id_b"), F.col("product_name").alias("name_b"), F.lower("product_name").alias("low_b"), F.col("cas_number").alias("two"), F.col("risk").alias("risk_b"))
    r = rules.groupBy(F.least("cas_a", "cas_b").alias("least"), F.greatest("cas_a", "cas_b").alias("greatest")).agg(F.max("rule").alias("rule"))
    pairs = a.crossJoin(b).withColumns({"least": F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), F.least("one", "two")), "greatest": F.greatest("one", "two")})
    layer = (
        F.when(F.col("name_a") == F.col("name_b"), "self").when(F.col("rule").isin("I", "R"), "structured_rule").when(F.exists("parts", lambda t: F.contains(F.col("low_b"), t)), "text_incompatibility")
        .when(F.col("risk_a") | F.col("risk_b"), "hazard_flags").otherwise("none")
    )
    cells = pairs.join(r, ["least", "greatest"], "left").select("id_a", "id_b", "rule", layer.alias("layer"))
    decision = (
        F.when(F.col("layer") == "self", "Self").when((F.col("layer") == "structured_rule") & (F.col("rule") == "I") | (F.col("layer") == "text_incompatibility"), "Incompatible")
        .when(F.col("layer") == "none", "Compatible").otherwise("Restricted")
    )
    return cells.select("id_a", "id_b", decision.alias("decision"), "layer")


def check_pair(products: DataFrame, first: str, second: str, order: str = "document_id") -> DataFrame:
    """(compatible, confidence, hazard_class_1, hazard_class_2) of two names asked for, one row.

    A name is looked for inside the products' names, in any case; of several the last by ``order`` counts. The pair is incompatible if a part of the
    first one's incompatibilities is inside the second name as it was asked for. If either isn't found: compatible, with confidence 0."""
    inside = lambda name: F.contains(F.lower(F.coalesce("product_name", F.lit(""))), F.lit(name.lower()))
    last = lambda name, column: F.max_by(F.struct("incompatibilities", "confidence", "hazard_class"), F.when(inside(name), F.col(order))).alias(column)
    found = products.agg(last(first, "a"), last(second, "b"), F.max(inside(first)).alias("has_a"), F.max(inside(second)).alias("has_b"))
    both = F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False))
    return found.select(
        F.when(both, ~named(F.col("a.incompatibilities"), F.lit(second))).otherwise(True).alias("compatible"), F.when(both, F.coalesce("a.confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(both, F.col("a.hazard_class")).alias("hazard_class_1"), F.when(both, F.col("b.hazard_class")).alias("hazard_class_2"),
    )


def decision_hash(product_a: Column, product_b: Column, cas_a: Column, cas_b: Column, decision: Column, layer: Column, source: Column) -> Column:
    """SHA-256 of a decision's seven parts with bars between; a missing number is the word None, a missing source nothing."""
    none = lambda c, instead: F.coalesce(c, F.lit(instead))
    return F.sha2(F.concat_ws("|", product_a, product_b, none(cas_a, "None"), none(cas_b, "None"), decision, layer, none(source, "")), 256)


def hazardous_combinations(rules: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rules I or R of which both numbers are in ``inventory`` (cas_number)."""
    have = inventory.select("cas_number").distinct()
    for c in ("cas_a", "cas_b"):
        rules = rules.join(have, rules[c] == have["cas_number"], "left_semi")
    return rules.filter(F.col("rule").isin("I", "R"))


# Code, words of which one is in a component's name, least largest concentration, category.
MIXTURE_RULES = [
    ("H314", ["SULFURIC ACID", "HYDROCHLORIC ACID", "SODIUM HYDROXIDE"], 10.0, "1A"), ("H314", ["PHOSPHORIC ACID"], 25.0, "1B"),
    ("H315", ["SULFURIC ACID", "HYDROCHLORIC ACID", "SODIUM HYDROXIDE"], 1.0, "2"), ("H315", ["XYLENE", "TOLUENE"], 10.0, "2"),
    ("H225", ["ACETONE", "ETHANOL", "METHANOL"], 50.0, "2"), ("H350", ["BENZENE", "FORMALDEHYDE"], 0.1, "1A"),
]


def calculated_hazards(components: DataFrame, rules: list[tuple[str, list[str], float, str]] = MIXTURE_RULES) -> DataFrame:
    """The columns of ``components`` (chemical_name, concentration_max and others) with code, category and threshold of each rule that a component meets."""
    name = F.upper("chemical_name")
    fits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)) & (F.col("concentration_max") >= least), F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(least).alias("threshold"))) for code, words, least, category in rules]
    rows = components.select("*", F.explode(F.array_compact(F.array(*fits))).alias("__r"))
    return rows.select(*[F.col(f"`{c}`") for c in components.columns], "__r.*")
