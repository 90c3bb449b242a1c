"""Names, classes, codes, terms and weights, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import strip

# Formulas that stand for a name, words of a brand, marks around an amount at the end.
FORMULAS = {
    "H2SO4": "Ácido Sulfúrico", "HCL": "Ácido Clorídrico", "HNO3": "Ácido Nítrico", "H2O2": "Peróxido de Hidrogênio", "NAOH": "Hidróxido de Sódio", "KOH": "Hidróxido de Potássio",
    "NH3": "Amônia", "H3PO4": "Ácido Fosfórico", "C2H5OH": "Ethanol", "CH3OH": "Methanol",
}
BRANDS = ["ACME", "BRAND", "TRADE", "INDÚSTRIA", "FABRICANTE"]
AMOUNT, PURITY, TAIL = r"(?U)\b\d{1,3}%\b", r"(?iuU)\b(>\s*\d{1,3}%|\d{1,3}\s*%\s*pure)\b", " -:,/"
# Names of hazard classes, in the order in which they are tried.
HAZARD_CLASSES = {
    "Acute Tox": "Acute Toxicity", "Aqu. Acute": "Aquatic Acute Toxicity", "Aqu. Chronic": "Aquatic Chronic Toxicity", "Asp. Tox": "Aspiration Toxicity",
    "Card. Muta. Repr": "Carcinogenicity/Mutagenicity/Reproductive Toxicity", "Carc": "Carcinogenicity", "Corr. Skin": "Skin Corrosion/Irritation", "EOPCS": "Endocrine Disruption",
    "Eye Irrit": "Eye Irritation", "Expl": "Explosivity", "Flam. Aerosol": "Flammable Aerosol", "Flam. Gas": "Flammable Gas", "Flam. Liq": "Flammable Liquid", "Flam. Solid": "Flammable Solid",
    "Muta": "Mutagenicity", "Org. Peroxides": "Organic Peroxides", "Ozone": "Ozone Layer Depletion", "Pyr. Solids": "Pyrophoric Solids", "Repr": "Reproductive Toxicity", "Self-Reac": "Self-Reactive",
    "Skin Irrit": "Skin Irritation", "Skin Sens": "Skin Sensitization", "Spec. Target Organ Tox": "Specific Target Organ Toxicity", "Water-React": "Water-Reactive", "Oxidizing Gas": "Oxidizing Gas",
    "Oxidizing Liq": "Oxidizing Liquid", "Oxidizing Solid": "Oxidizing Solid", "Hazard": "Hazardous", "Flammable": "Flammable", "Oxidizer": "Oxidizer", "Corrosive": "Corrosive", "Toxic": "Toxic",
    "Dangerous": "Dangerous",
}
# Names of pictograms.
PICTOGRAMS = {
    "GHS01": "Explosive", "GHS02": "Flammable", "GHS03": "Oxidizing", "GHS04": "Gas under pressure", "GHS05": "Corrosive", "GHS06": "Toxic", "GHS07": "Harmful/Irritant",
    "GHS08": "Health hazard", "GHS09": "Environmental",
}
# Whole weights of elements.
WEIGHTS = {"C": 12.0, "H": 1.0, "O": 16.0, "N": 14.0, "S": 32.0, "P": 31.0, "F": 19.0, "Cl": 35.5, "Br": 80.0, "I": 127.0, "K": 39.0, "Na": 23.0, "Ca": 40.0, "Mg": 24.0, "Fe": 56.0, "Si": 28.0}
# First and last code of hazard and of precautionary statements.
H_CODES, P_CODES = (200, 413), (100, 510)
# Words in a file's name that tell its language, Portuguese ones first.
FILE_WORDS = {"pt": ["português", "pt", "guia", "tabela", "incompatibilidade", "ufv", "cois", "cbpf"], "en": ["english", "en", "guide", "chart", "table", "incompatibility", "chemical"]}
# Terms into English.
TERMS = {
    "es": {
        "hoja de datos de seguridad": "safety data sheet", "nombre del producto": "product name", "peligro": "hazard", "fabricante": "manufacturer", "número cas": "cas number", "emergencia": "emergency",
        "precaución": "precaution", "identificación": "identification", "propiedades físicas": "physical properties", "estabilidad": "stability", "información toxicológica": "toxicological information",
    },
    "fr": {
        "fiche de données de sécurité": "safety data sheet", "nom du produit": "product name", "danger": "hazard", "fabricant": "manufacturer", "numéro cas": "cas number", "urgence": "emergency",
        "précaution": "precaution", "identification": "identification", "propriétés physiques": "physical properties", "stabilité": "stability", "informations toxicologiques": "toxicological information",
    },
    "de": {
        "sicherheitsdatenblatt": "safety data sheet", "produktname": "product name", "gefahr": "hazard", "hersteller": "manufacturer", "cas-nummer": "cas number", "notfall": "emergency",
        "vorsichtsmaßnahme": "precaution", "identifizierung": "identification", "physikalische eigenschaften": "physical properties", "stabilität": "stability",
        "toxikologische informationen": "toxicological information",
    },
    "pt": {
        "ficha de dados de segurança": "safety data sheet", "nome do produto": "product name", "perigo": "hazard", "fabricante": "manufacturer", "número cas": "cas number", "emergência": "emergency",
        "precaução": "precaution", "identificação": "identification", "propriedades físicas": "physical properties", "estabilidade": "stability", "informação toxicológica": "toxicological information",
    },
}
# Weights of a value's source and thresholds of fields.
SOURCES = {"heuristic": 1.0, "llm": 0.85, "rag": 0.70, "external_api": 0.90, "normalized": 0.95, "cross_validated": 0.95}
THRESHOLDS = {
    "product_name": 0.75, "manufacturer": 0.70, "cas_number": 0.80, "un_number": 0.80, "hazard_class": 0.70, "packing_group": 0.65, "incompatibilities": 0.60, "formula": 0.70, "physical_state": 0.60,
}
OTHER_SOURCE, OTHER_THRESHOLD, CROSS_BOOST, SOURCE_SHARE, PATTERN = 0.70, 0.70, 0.08, 0.15, 0.80


def mapped(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def product_name(value: Column, formulas: dict[str, str] = FORMULAS, brands: list[str] = BRANDS) -> Column:
    """A product's name: formulas by name, without an amount that ends within four characters of the end and is followed by a letter or
    digit, without purity, without a brand at either end, with single blanks. As it is if under four characters or nothing is left; empty for null."""
    whole = F.coalesce(value, F.lit(""))
    name = strip(whole)
    known = F.coalesce(mapped(formulas, F.upper(name)), name)
    at, found = F.regexp_instr(known, F.lit(AMOUNT)), F.regexp_extract(known, AMOUNT, 0)
    late = (at > 0) & (at - 1 + F.length(found) >= F.length(known) - 4)
    bare = F.when(late, F.rtrim(F.substr(known, F.lit(1), at - 1), F.lit(TAIL))).otherwise(known)
    words = F.filter(F.split(strip(F.regexp_replace(bare, PURITY, "")), r"(?U)\s+", -1), lambda w: w != "")
    brand = lambda w: F.coalesce(F.upper(w).isin(*brands), F.lit(False))
    tail = F.when(brand(F.get(words, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    both = F.when(brand(F.get(tail, F.size(tail) - 1)), F.slice(tail, F.lit(1), F.size(tail) - 1)).otherwise(tail)
    made = F.array_join(both, " ")
    return F.when((F.length(name) < 4) | (made == ""), whole).otherwise(made)


def hazard_name(value: Column, classes: dict[str, str] = HAZARD_CLASSES) -> Column:
    """The name of a hazard class: an exact key, else the first key that holds or is held by the value, else the value with capitals; null for empty."""
    low = F.lower(strip(value))
    exact = [F.when(low == k.lower(), v) for k, v in classes.items()]
    part = [F.when(F.contains(low, F.lit(k.lower())) | F.contains(F.lit(k.lower()), low), v) for k, v in classes.items()]
    title = F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")
    return F.when(F.length(value) > 0, F.coalesce(*exact, *part, F.nullif(title, F.lit(""))))


def hazard_names(value: Column, classes: dict[str, str] = HAZARD_CLASSES) -> Column:
    """Array of names from a JSON object (keys that are true), a JSON list or a plain value."""
    parsed = F.from_json(value, "array<string>")
    told = F.map_keys(F.map_filter(F.from_json(value, "map<string,string>"), lambda _, v: v == "true"))
    listed = F.when(value.rlike(r"^\s*\{"), told).when(value.rlike(r"^\s*\["), parsed).otherwise(F.array(value))
    return F.array_compact(F.transform(listed, lambda x: hazard_name(x, classes)))


def statement_codes(text: Column, letter: str) -> Column:
    """Sorted distinct codes of ``letter`` (H or P) in a text, wherever a letter and three digits stand."""
    least, most = H_CODES if letter == "H" else P_CODES
    numbers = F.filter(F.regexp_extract_all(text, F.lit(rf"{letter}(\d{{3}})"), F.lit(1)), lambda x: x.cast("int").between(least, most))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda x: F.concat(F.lit(letter), x))))


def listed_codes(value: Column, letter: str) -> Column:
    """Codes of a JSON list (items that begin with the letter) or object (its keys); plain text, and JSON that is broken, is split at commas
    and blanks only if it begins like JSON, else has none."""
    broken = F.filter(F.split(F.replace(value, F.lit(","), F.lit(" ")), r"\s+", -1), lambda x: x.rlike(rf"^{letter}\d+$"))
    ok = F.try_parse_json(value).isNotNull()
    items = F.filter(F.from_json(value, "array<string>"), lambda x: F.startswith(x, F.lit(letter)))
    keys = F.map_keys(F.from_json(value, "map<string,string>"))
    found = F.when(F.startswith(value, F.lit("[")), F.when(ok, items).otherwise(broken)).when(F.startswith(value, F.lit("{")), F.when(ok, keys).otherwise(broken))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def missing_codes(expected: Column, found: Column) -> Column:
    """Sorted codes of the array ``expected`` that the comma list ``found`` lacks."""
    return F.array_sort(F.array_except(expected, F.when(F.coalesce(found, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(found, ",", -1))))


def consistency(calculated: Column, declared: Column) -> Column:
    """(status, missing): ``inconsistent`` if the array ``calculated`` has codes that ``declared`` lacks."""
    missing = F.filter(calculated, lambda x: ~F.array_contains(F.transform(declared, lambda x: F.trim(x)), x))
    return F.struct(F.when(F.size(missing) > 0, "inconsistent").otherwise("valid").alias("status"), missing.alias("missing"))


def pictograms(codes: Column, names: dict[str, str] = PICTOGRAMS) -> Column:
    """A comma list of pictogram codes as an array of ``code (name)``; unknown codes as they are."""
    parts = F.filter(F.transform(F.split(codes, ",", -1), strip), lambda x: x != "")
    return F.transform(parts, lambda x: F.coalesce(F.concat(x, F.lit(" ("), mapped(names, F.upper(x)), F.lit(")")), x))


def molecular_weight(value: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The number itself if it is one between 0 and 10000, else the sum of the formula's elements; null if there is none."""
    number = value.try_cast("double")
    parts = F.regexp_extract_all(value, F.lit("[A-Z][a-z]?[0-9]*"), F.lit(0))
    one = lambda x: F.coalesce(mapped(weights, F.regexp_extract(x, "^[A-Za-z]+", 0)), F.lit(0.0)) * F.coalesce(F.regexp_extract(x, "[0-9]+$", 0).try_cast("double"), F.lit(1.0))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + one(x))
    return F.when((number > 0) & (number < 10000), number).otherwise(F.when(total > 0, total))


def file_language(name: Column, words: dict[str, list[str]] = FILE_WORDS, default: str = "en") -> Column:
    """The first language of which a word is in the file's name, which can be inside other words."""
    low = F.lower(name)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ws)), lang) for lang, ws in words.items()], F.lit(default))


def translate_terms(text: Column, lang: Column, terms: dict[str, dict[str, str]] = TERMS) -> Column:
    """``text`` with the terms of its language in English, in lower case, title case and capitals; other languages as they are."""

    def done(own: dict[str, str]) -> Column:
        pairs = [(cased(a), cased(b)) for a, b in own.items() for cased in (str, str.title, str.upper)]
        return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)

    return reduce(lambda rest, k: F.when(lang == k, done(terms[k])).otherwise(rest), terms, text)


def field_score(field: Column, base: Column, source: Column, context: Column, boost: Column, crossed: Column, pattern: Column) -> Column:
    """Confidence of a value: what the extraction gave, the source's weight, boosts that shrink with what is left to 1, times the mean of pattern and context; 0 to 1."""
    start = base + F.coalesce(mapped(SOURCES, source), F.lit(OTHER_SOURCE)) * SOURCE_SHARE
    more = F.coalesce(boost, F.lit(0.0)) + F.when(crossed, CROSS_BOOST).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (start + more * (1 - start)) * (pattern + context) / 2))


def quality_tier(field: Column, score: Column) -> Column:
    """How far a score is from its field's threshold."""
    least = F.coalesce(mapped(THRESHOLDS, field), F.lit(OTHER_THRESHOLD))
    return F.when(score >= least + 0.15, "excellent").when(score >= least, "good").when(score >= least - 0.10, "acceptable").when(score >= least - 0.20, "poor").otherwise("unreliable")
