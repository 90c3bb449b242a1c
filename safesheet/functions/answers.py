"""Answers of language models in one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence and method of an answer that says neither, and the keys under which a value can stand.
CONFIDENCE, METHOD, KEYS = 0.70, "llm", ["value", "text", "answer", "result"]


def normal_answer(answer: Column) -> Column:
    """(value, confidence, method) of an answer: of a JSON object the first of KEYS, with its confidence and method; any other text as it is,
    without blanks around it. An object without these keys is its own text. Null for null."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    is_object = text.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(text).isNotNull()
    held = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in KEYS])
    lifted = is_object & held.isNotNull()
    return F.when(answer.isNotNull(), F.struct(
        F.when(lifted, held).otherwise(text).alias("value"),
        F.when(lifted, F.coalesce(F.get_json_object(text, "$.confidence").try_cast("double"), F.lit(CONFIDENCE))).otherwise(CONFIDENCE).alias("confidence"),
        F.when(lifted, F.coalesce(F.get_json_object(text, "$.method"), F.lit(METHOD))).otherwise(METHOD).alias("method"),
    ))
