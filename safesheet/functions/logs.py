"""Counts from ingestion logs, ranks of results, codes in classification trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_stats(lines: DataFrame) -> DataFrame:
    """(total_found, total_ingested, total_failed, letters) of a crawler's log (line): one row, with the letters that were begun in order of the alphabet."""
    line = F.col("line")
    found = F.when(F.contains(line, F.lit("chemicals for letter")), F.regexp_extract(line, r"Found (\d+)", 1).try_cast("long"))
    letter = F.when(F.contains(line, F.lit("Processing letter")), F.nullif(F.regexp_extract(line, r"Processing letter '?(\p{L})'?", 1), F.lit("")))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return lines.agg(
        F.coalesce(F.sum(found), F.lit(0)).alias("total_found"), count(F.contains(line, F.lit("Ingested:")) & F.contains(line, F.lit("chunks"))).alias("total_ingested"),
        count(F.contains(line, F.lit("Failed to scrape"))).alias("total_failed"), F.array_sort(F.collect_set(letter)).alias("letters"),
    )


def duration(seconds: Column) -> Column:
    """Whole seconds, minutes, or hours and minutes."""
    s = seconds.cast("long")
    text = lambda c: c.cast("long").cast("string")
    return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(F.floor(s / 60)), F.lit("m"))).otherwise(F.concat(text(F.floor(s / 3600)), F.lit("h "), text(F.floor(s % 3600 / 60)), F.lit("m")))


def time_left(processed: Column, total: Column, elapsed: Column) -> Column:
    """How long the rest takes at the rate so far; unknown before anything is done."""
    rate = F.when(elapsed > 0, processed / elapsed).otherwise(0.0)
    return F.when(processed == 0, "unknown").otherwise(duration(F.when(rate > 0, (total - processed) / rate).otherwise(0.0)))


def progress(processed: Column, total: Column, width: int = 50) -> Column:
    """A bar and a percentage; N/A without a total."""
    share = processed / total
    filled = F.floor(share * width).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))
    return F.when(total == 0, "N/A").otherwise(F.concat(bar, F.lit(" "), F.format_string("%.1f%%", (share * 100).cast("double"))))


def ranked_results(queries: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index, relevance_score, rank) of logged queries (query_id, document_ids, chunks, top_score): ranks from 1; the first alone has a score.

    Lists of different length are cut to the shorter."""
    n = F.least(F.size("document_ids"), F.size("chunks"))
    pairs = F.slice(F.arrays_zip("document_ids", "chunks"), F.lit(1), F.greatest(n, F.lit(0)))
    rows = queries.select("query_id", "top_score", F.posexplode(pairs).alias("k", "p"))
    return rows.select("query_id", F.col("p.document_ids").alias("document_id"), F.col("p.chunks").alias("chunk_index"), F.when(F.col("k") == 0, F.col("top_score")).alias("relevance_score"), (F.col("k") + 1).alias("rank"))


def tree_codes(tree: Column, letter: str = "H") -> Column:
    """Codes (``letter`` and digits) that are the Name of an Information of a classification tree in JSON, at any depth, in the order of the text."""
    return F.regexp_extract_all(tree, F.lit(rf'"Name"\s*:\s*"({letter}\d+)"'), F.lit(1))


FEATURES = ["pattern_match_strength", "value_length", "has_special_chars", "has_numbers", "has_uppercase", "context_keyword_count", "context_length", "distance_from_label", "source_heuristic", "source_llm", "source_rag",
            "field_cas_number", "field_product_name", "field_hazard_class", "field_other", "has_cross_validation", "cross_fields_count"]


# Special characters, words of a context, labels of fields (others: their name with blanks), and the distance of a label that isn't there.
SPECIAL = "!@#$%^&*()[]{}|\\/<>"
NEAR_WORDS = ["product", "chemical", "manufacturer", "cas", "hazard", "identification", "section", "number", "class", "un"]
LABELS = {"product_name": ["product", "chemical name"], "manufacturer": ["manufacturer", "supplier"], "cas_number": ["cas", "cas number"], "un_number": ["un", "un number"], "hazard_class": ["hazard class", "classification"]}
FAR = 100


def label_distance(field: Column, context: Column) -> Column:
    """Place of the first label of the field in the context, from 0, at most FAR."""
    labels = F.coalesce(F.create_map(*[x for f, ws in LABELS.items() for x in (F.lit(f), F.array(*map(F.lit, ws)))])[field], F.array(F.replace(field, F.lit("_"), F.lit(" "))))
    places = F.filter(F.transform(labels, lambda w: F.position(w, F.lower(context)) - 1), lambda x: x >= 0)
    return F.least(F.lit(FAR), F.coalesce(F.array_min(places), F.lit(FAR)))


def features(field: Column, value: Column, context: Column, source: Column, pattern: Column, crossed: Column) -> list[Column]:
    """The 17 columns of FEATURES, as doubles, of a value: ``pattern`` is how well its pattern fits, ``crossed`` how many fields agree with it."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    text, near = F.coalesce(value, F.lit("")), F.coalesce(context, F.lit(""))
    has = lambda c, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
    own = [has(field, "cas"), has(field, "product", "name"), has(field, "hazard")]
    made = [
        pattern, F.length(text), flag(F.translate(text, SPECIAL, "") != text), flag(text.rlike(r"(?U)\d")), flag(text.rlike(r"\p{Lu}")), F.size(F.filter(F.array(*map(F.lit, NEAR_WORDS)), lambda w: F.contains(F.lower(near), w))),
        F.length(near), label_distance(field, near), *[flag(has(source, s)) for s in ("heuristic", "llm", "rag")], *map(flag, own), flag(~(own[0] | own[1] | own[2])), flag(crossed > 0), crossed,
    ]
    return [c.cast("double").alias(n) for c, n in zip(made, FEATURES, strict=True)]
