"""Extractions compared with the properties of the chemical that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean confidence from which a document isn't enriched; confidence of each kind of finding; synonyms named in an issue, and listed.
SKIP_FROM = 0.80
SURE = {
    "cas_missing": 0.85, "cas_other": 0.60, "formula_missing": 0.90, "formula_other": 0.65, "iupac": 0.95, "weight": 0.95, "weight_text": 0.80, "structure": 0.95, "statements": 0.80, "pictograms": 0.85, "name_unknown": 0.50,
    "reference": 1.0, "synonyms": 0.90,
}
NAMED, LISTED = 5, 10
#: Columns of the properties of a chemical.
PROPERTIES = """cas_number string, molecular_formula string, iupac_name string, molecular_weight string, canonical_smiles string, inchi_key string, hazard_statements array<string>, precautionary_statements array<string>,
    pictograms array<string>, synonyms array<string>, url string"""
#: Fields of a document that are compared.
FIELDS = ["cas_number", "molecular_formula", "molecular_weight", "h_statements", "p_statements", "product_name"]


def _finding(when: Column, field: str, original, enriched, sure: str, status: str = "enriched", missing=None, issue=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    gap = (F.lit(None) if missing is None else missing).cast("array<string>")
    return F.when(when, F.struct(F.lit(field).alias("field_name"), text(original).alias("original"), text(enriched).alias("enriched"), F.lit(SURE[sure]).alias("confidence"), F.lit(status).alias("status"), gap.alias("missing"), text(issue).alias("issue")))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def compare(documents: DataFrame, properties: DataFrame, key: str = "document_id", aggressive: bool = False) -> DataFrame:
    """(``key``, field_name, original, enriched, confidence, status, missing, issue): what the ``properties`` (``key`` and PROPERTIES) of a document's chemical add to its values or say against them.

    ``documents`` has ``key``, FIELDS and mean_confidence; those with a mean of SKIP_FROM or more are left out. A missing number or formula is enriched, another one is a warning (formulas are compared
    without blanks and case); names, weight and structure come from the properties; statements are enriched with all codes where some are missing, which ``missing`` lists; a product's name
    that is in no synonym is a warning. ``aggressive`` adds the reference and the synonyms. A row for each finding; a document without properties has none."""
    p, d = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"d.{c}"))
    flat = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("")))
    weight = F.try_to_number(p("molecular_weight"), F.lit("999999999D999999")).cast("double")
    weight = F.coalesce(weight, F.expr("try_cast(p.molecular_weight AS double)"))
    found = [
        _finding(_filled(p("cas_number")) & ~_filled(d("cas_number")), "cas_number", None, p("cas_number"), "cas_missing"),
        _finding(
            _filled(p("cas_number")) & _filled(d("cas_number")) & (p("cas_number") != d("cas_number")), "cas_number", d("cas_number"), p("cas_number"), "cas_other", "warning",
            issue=F.concat(F.lit("Extracted CAS ("), d("cas_number"), F.lit(") differs from the reference ("), p("cas_number"), F.lit(")")),
        ),
        _finding(_filled(p("molecular_formula")) & ~_filled(d("molecular_formula")), "molecular_formula", None, p("molecular_formula"), "formula_missing"),
        _finding(
            _filled(p("molecular_formula")) & _filled(d("molecular_formula")) & (flat(p("molecular_formula")) != flat(d("molecular_formula"))), "molecular_formula", d("molecular_formula"), p("molecular_formula"), "formula_other", "warning",
            issue=F.concat(F.lit("Formula mismatch: extracted="), d("molecular_formula"), F.lit(", reference="), p("molecular_formula")),
        ),
        _finding(_filled(p("iupac_name")), "iupac_name", None, p("iupac_name"), "iupac"),
        _finding(_filled(p("molecular_weight")) & weight.isNotNull(), "molecular_weight", d("molecular_weight"), F.format_string("%.2f g/mol", weight), "weight"),
        _finding(_filled(p("molecular_weight")) & weight.isNull(), "molecular_weight", d("molecular_weight"), p("molecular_weight"), "weight_text"),
        _finding(_filled(p("canonical_smiles")), "canonical_smiles", None, p("canonical_smiles"), "structure"),
        _finding(_filled(p("inchi_key")), "inchi_key", None, p("inchi_key"), "structure"),
    ]
    for field, own in (("h_statements", "hazard_statements"), ("p_statements", "precautionary_statements")):
        codes = F.array_sort(F.array_distinct(F.coalesce(p(own), F.array().cast("array<string>"))))
        gap = F.array_except(codes, F.split(F.coalesce(d(field), F.lit("")), ",", -1))
        found.append(_finding(F.size(gap) > 0, field, F.nullif(d(field), F.lit("")), F.array_join(codes, ", "), "statements", missing=gap))
    names = F.coalesce(p("synonyms"), F.array().cast("array<string>"))
    known = F.exists(names, lambda s: F.contains(F.lower(s), F.lower(d("product_name"))))
    found += [
        _finding(F.size(F.coalesce(p("pictograms"), F.array().cast("array<string>"))) > 0, "ghs_pictograms", None, F.array_join(p("pictograms"), ", "), "pictograms"),
        _finding(
            _filled(d("product_name")) & (F.size(names) > 0) & ~known, "product_name", d("product_name"), None, "name_unknown", "warning",
            issue=F.concat(F.lit("Product name '"), d("product_name"), F.lit("' is no synonym; possible alternatives: "), F.array_join(F.slice(names, 1, NAMED), ", ")),
        ),
    ]
    if aggressive:
        found += [_finding(_filled(p("url")), "reference", None, p("url"), "reference"), _finding(F.size(names) > 0, "chemical_synonyms", None, F.array_join(F.slice(names, 1, LISTED), "; "), "synonyms")]
    doubtful = documents.filter(F.coalesce("mean_confidence", F.lit(0.0)) < SKIP_FROM)
    both = doubtful.alias("d").join(properties.alias("p"), F.col(f"d.{key}") == F.col(f"p.{key}"))
    return both.select(F.col(f"d.{key}").alias(key), F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")
