"""Extractions as a row for each document, and the fields that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of a row, statuses that are shown, rows of a page; the extended fields.
FIELDS = ["product_name", "manufacturer", "cas_number", "un_number", "hazard_class", "packing_group", "h_statements", "p_statements", "incompatibilities"]
SHOWN, PAGE = ["success", "failed", "partial"], 500
EXTENDED = [
    "ghs_pictograms", "signal_word", "exposure_limit_osha_pel", "exposure_limit_acgih_tlv", "exposure_limit_niosh_rel", "exposure_limit_idlh", "flash_point", "boiling_point", "melting_point",
    "ph", "physical_state", "toxicity_oral_ld50", "toxicity_dermal_ld50", "toxicity_inhalation_lc50", "proper_shipping_name", "tsca_status", "sara_313", "california_prop65",
]


def wide_results(documents: DataFrame, extractions: DataFrame, limit: int | None = PAGE) -> DataFrame:
    """A row for each document (id, filename, status, is_dangerous, processed_at, processing_time_seconds, completeness_score, avg_confidence) of a status that is shown, with
    the greatest value of each of FIELDS among its ``extractions`` (document_id, field_name, value, confidence, metadata in JSON), newest first, nulls last, then by id.

    completeness is 0 where it is null, avg_confidence the mean of the extractions' where it is null; quality_tier and validated are those of the metadata of the product's name,
    else unknown and false. ``limit`` is the page of the original; None gives all documents, without a sort over all of them on one task."""
    held = F.col("field_name") == "product_name"
    by = extractions.groupBy(F.col("document_id").alias("id")).agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS], F.avg("confidence").alias("__mean"),
        F.max(F.when(held, F.get_json_object("metadata", "$.quality_tier"))).alias("__tier"), F.max(F.when(held, F.get_json_object("metadata", "$.external_validation.is_valid") == "true")).alias("__valid"),
    )
    rows = documents.filter(F.col("status").isin(*SHOWN)).join(by, "id", "left").select(
        "id", "filename", "status", "is_dangerous", "processed_at", F.col("processing_time_seconds").alias("processing_time"), *FIELDS, F.coalesce("completeness_score", F.lit(0.0)).alias("completeness"),
        F.coalesce("avg_confidence", "__mean").alias("avg_confidence"), F.coalesce("__tier", F.lit("unknown")).alias("quality_tier"), F.coalesce("__valid", F.lit(False)).alias("validated"),
    )
    rows = rows.orderBy(F.desc_nulls_last("processed_at"), "id")
    return rows if limit is None else rows.limit(limit)


def field_gaps(extractions: DataFrame, fields: list[str] = EXTENDED) -> DataFrame:
    """(field_name, filled, documents, status): of each field the extractions (document_id, field_name, value) with a value, and of how many documents; status is none, partial or full
    against all documents that have an extraction. Fields that nothing has are there too."""
    total = extractions.agg(F.count_distinct("document_id").alias("n")).first()["n"]
    good = F.col("value").isNotNull() & (F.col("value") != "NOT_FOUND")
    found = extractions.filter(F.col("field_name").isin(*fields) & good).groupBy("field_name").agg(F.count("*").alias("filled"), F.count_distinct("document_id").alias("documents"))
    names = extractions.sparkSession.createDataFrame([(f,) for f in fields], "field_name string")
    rows = names.join(found, "field_name", "left").fillna(0, ["filled", "documents"])
    return rows.withColumn("status", F.when(F.col("documents") == 0, "none").when(F.col("documents") < total, "partial").otherwise("full"))
