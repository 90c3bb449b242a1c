"""Classification trees in JSON, walked level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: What a node's Information may be named: the kind of a code by its form.
FORMS = {"hazard": r"^H\d+$", "precaution": r"^P\d+$", "pictogram": r"^GHS\d+$"}


def tree_codes(trees: DataFrame, forms: dict[str, str] = FORMS) -> DataFrame:
    """(id, kind, nth, code) of the classification trees (id, tree) in JSON: the codes that are the Name of an Information of a node, at any depth.

    A node has an array Information of objects with a Name, and an array Node of nodes. Codes come in the order of the tree, a node's own before its
    children's, numbered from 1 by kind; one that is there twice comes twice. Names of another form, and whatever free text holds, don't count. A tree that
    isn't JSON, and a null one, has none. Each level is one step over all trees, so the steps are as many as the deepest tree has levels."""
    level = trees.select("id", F.try_parse_json("tree").alias("node"), F.array().cast("array<int>").alias("place"))
    found = None
    while True:
        level = cut(level)
        infos = level.select("id", "place", F.posexplode(F.try_variant_get("node", "$.Information", "array<variant>")).alias("k", "info"))
        named = infos.select("id", F.concat("place", F.array(F.lit(-1), F.col("k"))).alias("place"), F.try_variant_get("info", "$.Name", "string").alias("code"))
        kind = F.coalesce(*[F.when(F.col("code").rlike(form), F.lit(name)) for name, form in forms.items()])
        here = named.withColumn("kind", kind).filter("kind is not null")
        found = here if found is None else found.unionByName(here)
        level = level.select("id", "place", F.posexplode(F.try_variant_get("node", "$.Node", "array<variant>")).alias("k", "child")).select("id", F.col("child").alias("node"), F.array_append("place", F.col("k")).alias("place"))
        if not level.limit(1).count():
            break
    order = Window.partitionBy("id", "kind").orderBy("place")  # the codes of one tree
    return found.select("id", "kind", F.row_number().over(order).alias("nth"), "code")
