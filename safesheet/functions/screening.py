"""What a text is about: incompatible chemicals that it names, its language by key words, its maker's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import strip

# Words of texts without data, looked for at the begin; forms of texts about the question; words of texts with data; length of the begin, of a name, names at most.
NO_DATA = [
    "não aplicável", "not applicable", "n/a", "nenhum", "none", "desconhecido", "unknown", "infelizmente", "unfortunately", "não há informação", "no information",
    "não encontr", "not found", "i do not", "erro", "mistake", "diferente", "different",
]
ABOUT = ["based on.*context", "it seems.*mistake", "there is.*no.*cas", "looking for.*different", "appears.*different"]
DATA = [
    "incompatível", "incompatible", "evitar", "avoid", "não misturar", "do not mix", "reage com", "reacts with", "perigoso", "dangerous", "explosivo", "explosive",
    "excesso de calor", "excess heat",
]
BEGIN, NAME, MOST = 200, (3, 100), 10
# Key words of sheets by language; the share of them that makes sure.
LANGUAGE_WORDS = {
    "en": ["safety data sheet", "product name", "hazard", "manufacturer", "cas number", "emergency", "precautionary", "identification"],
    "es": ["hoja de datos de seguridad", "nombre del producto", "peligro", "fabricante", "numero cas", "emergencia", "precaucion", "identificacion"],
    "fr": ["fiche de donnees de securite", "nom du produit", "danger", "fabricant", "numero cas", "urgence", "precaution", "identification"],
    "de": ["sicherheitsdatenblatt", "produktname", "gefahr", "hersteller", "cas-nummer", "notfall", "vorsichtsmassnahme", "identifizierung"],
    "pt": ["ficha de dados de seguranca", "nome do produto", "perigo", "fabricante", "numero cas", "emergencia", "precaucao", "identificacao"],
    "it": ["scheda di sicurezza", "nome del prodotto", "pericolo", "produttore", "numero cas", "emergenza", "precauzione", "identificazione"],
}
SURE_SHARE = 0.3
# Makers and what their sheets' heads hold; length of a head.
PROFILES = {"Sigma-Aldrich": ["SIGMA-ALDRICH", "MERCK", "MILLIPORE"], "Fisher Scientific": ["FISHER SCIENTIFIC", "THERMO FISHER"], "VWR": ["VWR INTERNATIONAL", "AVANTOR"]}
HEAD = 3000


def _holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def screen(text: Column) -> Column:
    """Why an incompatibility text is left out: blank, no_data, about_the_question or no_key_word; null if it isn't."""
    low = F.lower(strip(text))
    about = [low.rlike(form) for form in ABOUT]
    asked = about[0]
    for a in about[1:]:
        asked = asked | a
    return F.when(F.coalesce(low, F.lit("")) == "", "blank").when(_holds(F.substring(low, 1, BEGIN), NO_DATA), "no_data").when(asked, "about_the_question").when(~_holds(low, DATA), "no_key_word")


def incompatible_names(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``rows`` with nth and name: the chemicals that a text names, in small letters, MOST at most in their order; texts that ``screen`` leaves out have none.

    Parts between commas, semicolons, strokes and line ends count if they are of the right length, and again without what they have in brackets."""
    fits = lambda c: (F.length(c) > NAME[0]) & (F.length(c) < NAME[1])
    parts = F.filter(F.transform(F.split(F.lower(strip(F.col(text))), r"[,;/\n]", -1), strip), fits)
    names = F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"\([^)]*\)", ""))), lambda n: F.length(n) > NAME[0])
    kept = rows.filter(screen(F.col(text)).isNull())
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns], F.posexplode(F.slice(names, 1, MOST)).alias("nth", "name")).withColumn("nth", F.col("nth") + 1)


def language_by_words(text: Column) -> Column:
    """(lang, confidence) of a sheet by its key words: the language with most, of equal ones the first; confidence is their share over SURE_SHARE, 1 at most. Without any: unknown, 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang"), F.lit(len(words)).alias("of")) for k, (lang, words) in enumerate(LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*hits))
    sure = F.least(F.lit(1.0), best["n"] / (best["of"] * SURE_SHARE))
    return F.when(best["n"] > 0, F.struct(best["lang"].alias("lang"), sure.alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("lang"), F.lit(0.0).alias("confidence")))


def maker_profile(text: Column, profiles: dict[str, list[str]] = PROFILES, preferred: str | None = None) -> Column:
    """The first profile of which an identifier (a pattern, in any case) is in the head of a sheet, else Generic. A ``preferred`` profile, in any case, stands for all if there is one."""
    if preferred is not None and (own := next((p for p in profiles if p.lower() == preferred.lower()), None)):
        return F.lit(own)
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    found = [F.when(head.rlike("(?i)" + "|".join(f"(?:{i})" for i in ids)), F.lit(name)) for name, ids in profiles.items()]
    return F.coalesce(*found, F.lit("Generic"))
