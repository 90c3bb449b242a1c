"""Fields of a safety sheet by patterns, in the section where each stands; columns of regular expressions, no Python on the rows."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java flags under which a pattern means what it does in Python: Unicode classes, and a dot that stops at a line feed only.
PLAIN, ANY_CASE = "(?Ud)", "(?iuUd)"

# Name, section, flags and pattern of each field; proper_shipping_name has no pattern.
FIELDS: list[tuple[str, int, str, str | None]] = [
    ("product_name", 1, ANY_CASE, r"(?:nome\s*(?:comercial|do\s+produto|químico)|identifica(?:ç|c)[aã]o\s+do\s+produto|identificador\s+do\s+produto|product\s+name|chemical\s+name|produto)\s*[:\-]\s*([A-ZÀÁÂÃÉÊÍÓÔÕÚÇ][A-Za-zÀ-ÿ0-9\s\-,()./%]+(?:[A-Za-zÀ-ÿ]|\d{1,3}%)[^\n]{0,80})"),
    ("manufacturer", 1, ANY_CASE, r"(?:fabricante|fabricado\s+por|fornecedor(?:\\/distribuidor)?|manufacturer|empresa|raz[aã]o\s+social)\s*[:\-]\s*([A-ZÀÁÂÃÉÊÍÓÔÕÚÇ][A-Za-zÀ-ÿ0-9\s\-,&.]+?(?:LTDA|S\\.?A\\.?|INC|LLC|GMBH|LTD)?[^\n]{0,100})"),
    ("cas_number", 3, PLAIN, r"\b(\d{2,7}-\d{2}-\d)\b"),
    ("un_number", 14, ANY_CASE, r"(?:UN|ONU)[\s#:;\-]{0,3}(\d{4})|\b(\d{4})\b(?=.*(?:classe|risco|transporte))"),
    ("hazard_class", 14, ANY_CASE, r"classe\s*(?:de\s*)?(?:risco|perigo)?\s*[:\-]?\s*(\d(?:\.\d)?)"),
    ("packing_group", 14, ANY_CASE, r"grupo\s*(?:de)?\s*embalagem\s*[:\-]?\s*(I{1,3}|III|II|I|1|2|3)\b"),
    ("h_statements", 2, ANY_CASE, r"(H\d{3}(?:\s*\+\s*H\d{3})*)"),
    ("p_statements", 2, ANY_CASE, r"(P\d{3}(?:\s*\+\s*P\d{3})*)"),
    ("incompatibilities", 10, ANY_CASE, r"(?:incompatíve[li]s?\s*(?:com)?|evitar\s+contato\s+com|materiais?\s+(?:a\s+)?evitar|reage\s+(?:perigosamente\s+)?com|incompatible\s+(?:with|materials)|não\s+(?:misturar|armazenar)\s+(?:com|junto))\s*[:\-]?\s*([^\n]{5,400})"),
    ("ghs_pictograms", 2, ANY_CASE, r"(GHS0[1-9](?:[,;\s]+GHS0[1-9])*)"),
    ("signal_word", 2, ANY_CASE, r"\b(DANGER|WARNING|PERIGO|ATENÇÃO)\b"),
    ("exposure_limit_osha_pel", 8, ANY_CASE, r"(?:OSHA|PEL)\s*[:\-]?\s*([\d.]+\s*(?:ppm|mg/m[³3]|ppb))"),
    ("exposure_limit_acgih_tlv", 8, ANY_CASE, r"(?:ACGIH|TLV)\s*[:\-]?\s*([\d.]+\s*(?:ppm|mg/m[³3]|ppb))"),
    ("exposure_limit_niosh_rel", 8, ANY_CASE, r"(?:NIOSH|REL)\s*[:\-]?\s*([\d.]+\s*(?:ppm|mg/m[³3]|ppb))"),
    ("exposure_limit_idlh", 8, ANY_CASE, r"IDLH\s*[:\-]?\s*([\d.]+\s*(?:ppm|mg/m[³3]|ppb))"),
    ("flash_point", 9, ANY_CASE, r"(?:flash\s*point|ponto\s*de\s*fulgor|ponto\s*de\s*inflamação)\s*[:\-]?\s*([\-]?[\d.]+\s*°?[CF])"),
    ("boiling_point", 9, ANY_CASE, r"(?:boiling\s*point|ponto\s*de\s*ebulição)\s*[:\-]?\s*([\-]?[\d.]+\s*°?[CF])"),
    ("melting_point", 9, ANY_CASE, r"(?:melting\s*point|freezing\s*point|ponto\s*de\s*fusão|ponto\s*de\s*congelamento)\s*[:\-]?\s*([\-]?[\d.]+\s*°?[CF])"),
    ("ph", 9, ANY_CASE, r"\bpH\s*[:\-]?\s*([\d.]+(?:\s*[-~]\s*[\d.]+)?)"),
    ("physical_state", 9, ANY_CASE, r"(?:physical\s*state|estado\s*físico|form)\s*[:\-]?\s*(solid|liquid|gas|sólido|líquido|gasoso|powder|pó)"),
    ("toxicity_oral_ld50", 11, ANY_CASE, r"(?:oral|ingestão).*?LD50\s*[:\-]?\s*([\d,]+\s*mg/kg)"),
    ("toxicity_dermal_ld50", 11, ANY_CASE, r"(?:dermal|dérmica|cutânea).*?LD50\s*[:\-]?\s*([\d,]+\s*mg/kg)"),
    ("toxicity_inhalation_lc50", 11, ANY_CASE, r"(?:inhalation|inalação).*?LC50\s*[:\-]?\s*([\d,]+\s*(?:ppm|mg/[Ll]|mg/m[³3]))"),
    ("proper_shipping_name", 14, PLAIN, None),
    ("tsca_status", 15, ANY_CASE, r"TSCA\s*[:\-]?\s*(listed|not listed|exempt|yes|no|sim|não)"),
    ("sara_313", 15, ANY_CASE, r"SARA\s*313\s*[:\-]?\s*(yes|no|listed|not listed|sim|não)"),
    ("california_prop65", 15, ANY_CASE, r"(?:Prop(?:osition)?\s*65|California.*?65)\s*[:\-]?\s*(yes|no|listed|not listed|warning|sim|não)"),
]
#: Texts, in capitals, one of which is in every match of a field's pattern: where none is, the pattern needn't be tried at every place of a whole text.
#: They have no I, K or Å, whose other forms (İ, the signs of kelvin and ångström) the patterns take for them but capitals keep apart.
HELD = {
    "exposure_limit_osha_pel": ["OSHA", "PEL"], "exposure_limit_acgih_tlv": ["ACG", "TLV"], "exposure_limit_niosh_rel": ["OSH", "REL"], "exposure_limit_idlh": ["DLH"],
    "toxicity_oral_ld50": ["LD50"], "toxicity_dermal_ld50": ["LD50"], "toxicity_inhalation_lc50": ["LC50"], "tsca_status": ["TSCA"], "sara_313": ["313"], "california_prop65": ["65"],
}
# Confidence of a field found by its pattern, and of the others.
BASE_CONFIDENCE = {
    "un_number": 0.85, "cas_number": 0.80, "hazard_class": 0.78, "product_name": 0.75, "manufacturer": 0.72, "packing_group": 0.80,
    "h_statements": 0.70, "p_statements": 0.70, "incompatibilities": 0.65,
}
OTHER_CONFIDENCE, PROFILE_CONFIDENCE = 0.70, 0.95
# Least and largest UN number; classes that are dangerous (2 and 9 are not).
UN_NUMBERS = (4, 3550)
DANGEROUS = ["1", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "2.1", "2.2", "2.3", "3", "4", "4.1", "4.2", "4.3", "5", "5.1", "5.2", "6", "6.1", "6.2", "7", "8"]


def strip(text: Column) -> Column:
    """``text`` without the white space around it, of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def un_number(value: Column, least: int = UN_NUMBERS[0], most: int = UN_NUMBERS[1]) -> Column:
    """The four digits of a UN number in the range; null if there are more or fewer, or they lie outside."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when((F.length(digits) == 4) & digits.cast("int").between(least, most), digits)


def cas_format(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{2,7}-\d{2}-\d$"), value)


def hazard_class(value: Column) -> Column:
    """A class of one digit, with divisions of one digit; null for anything else."""
    return F.when(strip(value).rlike(r"^\d(\.\d)*$"), strip(value))


def packing_group(value: Column) -> Column:
    """In capitals; 1, 2 and 3 as Roman numerals."""
    upper = strip(F.upper(value))
    return F.when(upper.isin("1", "2", "3"), F.repeat(F.lit("I"), upper.try_cast("int"))).otherwise(upper)


def is_dangerous(value: Column, classes: list[str] = DANGEROUS) -> Column:
    """Whether a hazard class is one of ``classes``; false for null and empty."""
    return F.coalesce(value.isin(*classes), F.lit(False))


def base_confidence(field: Column, value: Column) -> Column:
    """The field's confidence, less 0.2 for a value under two characters and 0.1 for one over 200, from 0 to 0.99."""
    base = F.coalesce(F.create_map(*[F.lit(x) for pair in BASE_CONFIDENCE.items() for x in pair])[field], F.lit(OTHER_CONFIDENCE))
    n = F.coalesce(F.length(value), F.lit(0))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), base - F.when(n < 2, 0.2).when(n > 200, 0.1).otherwise(0.0)))


#: What is done to the value of some fields; a value that becomes null isn't found.
AFTER = {"un_number": un_number, "cas_number": cas_format, "hazard_class": hazard_class, "packing_group": packing_group}


def _value(text: Column, pattern: str, groups: int) -> Column:
    """The first group of the pattern that isn't empty (whole match without groups); null, or empty without groups, if it isn't found."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)]) if groups else F.regexp_extract(text, pattern, 0)
    return strip(found)


def _tried(section: int, flags: str, pattern: str) -> Column:
    """The value of the pattern in the section's column; null, without a try, where what every match of it holds isn't there."""
    value = _value(F.col(f"__space{section}"), flags + pattern, re.compile(pattern).groups)
    held = next((HELD[name] for name, *_, known in FIELDS if known == pattern and name in HELD), [])
    return F.when(reduce(or_, [F.contains(F.col(f"__upper{section}"), F.lit(x)) for x in held]), value) if held else value


def _around(text: Column, pattern: str, around: int) -> Column:
    """The text around the first place of the pattern (in UTF-16 units)."""
    at, whole = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
    begin = F.greatest(at - 1 - around, F.lit(0))
    return strip(F.substr(text, begin + 1, at - 1 + F.length(whole) + around - begin))


def _override(text: Column, profile: Column, field: str, overrides: dict[str, dict[str, str]], context: bool) -> Column | None:
    """The value by a maker's own pattern, which goes before the field's and is looked for in the whole text."""
    found = None
    for name, patterns in overrides.items():
        if field in patterns:
            pattern = "(?iuUdm)" + patterns[field]
            near = [_around(text, pattern, 50).alias("context")] if context else []
            value = F.coalesce(_value(text, pattern, re.compile(patterns[field]).groups), F.lit(""))
            made = F.struct(F.lit(field).alias("field_name"), value.alias("value"), F.lit(PROFILE_CONFIDENCE).alias("confidence"), *near, F.lit(f"heuristic_profile_{name}").alias("source"))
            own = F.when((profile == name) & (F.regexp_instr(text, F.lit(pattern)) > 0), made)
            found = own if found is None else F.coalesce(found, own)
    return found


def extract_fields(sheets: DataFrame, fields: list[tuple[str, int, str, str | None]] = FIELDS, overrides: dict[str, dict[str, str]] | None = None, around: int = 100, context: bool = True) -> DataFrame:
    """The columns of ``sheets`` but text, sections and profile, with field_name, value, confidence, context, source: a row for each field that is found.

    ``sheets`` has text and sections (map of section number to text); a field is looked for in its section where the sheet has it, else in the
    whole text. With ``overrides`` (profile name to field to pattern) the column profile names the maker's patterns. A null text has no field.
    Without ``context`` that column is left out, whose places take each pattern twice more. Each row is worked on by itself: nothing is shuffled.
    """
    text, made = F.col("text"), []
    # columns of their own, as a value is looked at several times and a pattern should run once
    numbers = sorted({section for _, section, _, pattern in fields if pattern is not None})
    spaces = sheets.select("*", *[F.coalesce(F.try_element_at("sections", F.lit(n)), text).alias(f"__space{n}") for n in numbers])
    upper = spaces.select("*", *[F.upper(f"__space{n}").alias(f"__upper{n}") for n in numbers])
    raw = upper.select("*", *[_tried(section, flags, pattern).alias(f"__raw{k}") for k, (_, section, flags, pattern) in enumerate(fields) if pattern is not None])
    tried = raw.select("*", *[AFTER.get(name, lambda v: v)(F.nullif(F.col(f"__raw{k}"), F.lit(""))).alias(f"__value{k}") for k, (name, _, _, pattern) in enumerate(fields) if pattern is not None])
    for k, (name, section, flags, pattern) in enumerate(fields):
        own = _override(text, F.col("profile"), name, overrides, context) if overrides else None
        if pattern is not None:
            value = F.col(f"__value{k}")
            near = [_around(F.col(f"__space{section}"), flags + pattern, around).alias("context")] if context else []
            struct = F.struct(F.lit(name).alias("field_name"), value.alias("value"), base_confidence(F.lit(name), value).alias("confidence"), *near, F.lit("heuristic").alias("source"))
            found = F.when(value.isNotNull(), struct)
            own = found if own is None else F.coalesce(own, found)
        if own is not None:
            made.append(own)
    rest = [c for c in sheets.columns if c not in ("text", "sections", "profile")]
    rows = tried.select(*[F.col(f"`{c}`") for c in rest], F.explode(F.array_compact(F.array(*made))).alias("__found"))
    return rows.select(*[F.col(f"`{c}`") for c in rest], "__found.*")
