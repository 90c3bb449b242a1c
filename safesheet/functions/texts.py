"""Column functions over the texts of safety sheets and of models' answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that, near a value, speak for its field (fixed values).
CONTEXT_WORDS = {
    "product_name": ["product", "identification", "chemical name", "substance"],
    "manufacturer": ["manufacturer", "supplier", "company", "producer"],
    "cas_number": ["cas", "registry", "cas-no", "cas no"],
    "un_number": ["un", "un number", "un no", "un-no"],
    "hazard_class": ["hazard", "class", "classification", "category"],
    "packing_group": ["packing", "group", "pg"],
    "incompatibilities": ["incompatible", "avoid", "reactive", "stability"],
}


def context_score(field: Column, found: Column) -> Column:
    """Score of the phrases ``found`` (array) near a value of ``field``: 0.7 without phrases, 0.75 for a field without words
    of its own, else 0.6, 0.8 or 0.95 for no, one or more hits of a word in a phrase."""
    words = F.create_map(*[x for f, ws in CONTEXT_WORDS.items() for x in (F.lit(f), F.array(*map(F.lit, ws)))])[field]
    hits = F.size(F.flatten(F.transform(found, lambda t: F.filter(words, lambda w: F.contains(F.lower(t), w)))))
    return F.when(found.isNull() | (F.size(found) == 0), 0.7).when(words.isNull(), 0.75).when(hits == 0, 0.6).when(hits == 1, 0.8).otherwise(0.95)


def json_from_text(answer: Column) -> Column:
    """The first balanced ``{...}`` of a model's answer, inside its first code fence if it has one; null if there is none or it isn't JSON.

    Brackets in quotes count like others. Pieces that end at a closing bracket are added up until as many are closed as opened."""
    fence = F.when(F.contains(answer, F.lit("```json")), F.lit("```json")).otherwise(F.lit("```"))
    at = F.position(fence, answer)
    inside = F.when(at > 0, F.split(F.substr(answer, at + F.length(fence)), "```", -1)[0]).otherwise(answer)
    body = F.when(F.instr(inside, "{") > 0, F.substr(inside, F.instr(inside, "{")))
    pieces = F.split(body, "[}]", -1)
    opened = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))

    def add(s: Column, x: Column) -> Column:
        depth = s["depth"] + opened(x) - 1
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.length(x) + 1).alias("n"), (depth == 0).alias("done")))

    ended = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    whole = F.aggregate(ended, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")), add)
    found = F.when(whole["done"], F.substr(body, F.lit(1), whole["n"]))
    return F.when(F.try_parse_json(found).isNotNull(), found)
