"""Column functions over identifiers and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cas_valid(cas: Column) -> Column:
    """Whether a registry number has the right form and check digit: the digits by place from the right, modulo 10. Null for null."""
    digits = F.reverse(F.regexp_replace(cas, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits) - 1)
    total = F.aggregate(places, F.lit(0), lambda s, k: s + k * F.substr(digits, k + 1, F.lit(1)).cast("int"))
    return F.when(cas.isNull(), None).when(~cas.rlike(r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"), False).otherwise(total % 10 == F.substr(digits, F.lit(1), F.lit(1)).cast("int"))


def codes(text: Column, letter: str, first: int, last: int) -> Column:
    """Sorted distinct codes of a letter and three digits in a range."""
    found = F.regexp_extract_all(text, F.lit(rf"\b{letter}([0-9]{{3}})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x.cast("int").between(first, last)), lambda x: F.concat(F.lit(letter), x))))


def unordered(a: Column, b: Column) -> Column:
    """A pair whichever way round it comes."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
