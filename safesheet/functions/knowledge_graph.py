"""The graph of chemicals and makers: its loaders, its figures, and the tables of codes that it is made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import statement_codes
from .tables import insert_ignore

# What a maker's node begins with; kinds of edges; numbers that aren't known.
MAKER = "mfg:"
UNKNOWN = ["NOT_FOUND", "N/A"]
EDGE = "src string, dst string, kind string, rule string, source string, justification string, group_src string, group_dst string, score double, detail string"
#: Attributes of a chemical that its sheet gives, and those of the table of hazards.
OF_SHEET, OF_HAZARDS = ["product_name", "supplier", "confidence"], ["hazard_flags", "env_risk", "idlh", "pel", "rel"]


def _edges(rows: DataFrame, src: str, dst: str, kind: str, **more: str) -> DataFrame:
    """``rows`` as edges of the schema EDGE; what isn't named is null; edges without an end are left out."""
    columns = {"src": src, "dst": dst} | more
    fields = [f.strip().split(" ") for f in EDGE.split(",")]
    made = [F.lit(kind).alias(n) if n == "kind" else (F.col(columns[n]) if n in columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    return rows.select(*made).filter("src is not null and dst is not null")


def _both(rows: DataFrame, a: str, b: str, kind: str, groups: tuple[str, str] | None = None, **more: str) -> DataFrame:
    there = {"group_src": groups[0], "group_dst": groups[1]} if groups else {}
    back = {"group_src": groups[1], "group_dst": groups[0]} if groups else {}
    return _edges(rows, a, b, kind, **more, **there).unionByName(_edges(rows, b, a, kind, **more, **back))


def graph_edges(rules: DataFrame | None = None, makers: DataFrame | None = None, families: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Edges of the schema EDGE: incompatible_with both ways of rules (cas_a, cas_b, rule, source, justification, group_a, group_b), manufactured_by of makers (cas, manufacturer), product_family both
    ways of families (cas_a, cas_b), similar_to both ways of similar (cas_a, cas_b, score, kind). Several edges may join two nodes. Tables that aren't given have none; without any it is an error."""
    parts = []
    if rules is not None:
        parts.append(_both(rules, "cas_a", "cas_b", "incompatible_with", ("group_a", "group_b"), rule="rule", source="source", justification="justification"))
    if makers is not None:
        named = makers.withColumn("__to", F.concat(F.lit(MAKER), "manufacturer"))
        parts.append(_edges(named, "cas", "__to", "manufactured_by", detail="manufacturer"))
    if families is not None:
        parts.append(_both(families.withColumn("__how", F.lit("same_manufacturer")), "cas_a", "cas_b", "product_family", detail="__how"))
    if similar is not None:
        parts.append(_both(similar, "cas_a", "cas_b", "similar_to", score="score", detail="kind"))
    if not parts:
        raise ValueError("a graph needs a table of edges")
    return reduce(DataFrame.unionByName, parts)


def graph_nodes(edges: DataFrame, products: DataFrame, hazards: DataFrame | None = None, classes: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
    """A row for each node: id, kind (chemical or manufacturer), name of a maker, OF_SHEET and ghs_class of its sheet, OF_HAZARDS, hazard_classes and p_statements (sorted, each once, null if there is none).

    Nodes are the numbers of ``products`` (cas, OF_SHEET, hazard_class, and document_id, of which the greatest counts), of ``hazards`` (cas, OF_HAZARDS; any one row of a number), of ``classes`` (cas,
    ghs_class), of ``statements`` (cas, p_code), and all ends of the edges; an end that no table has is a chemical without attributes."""
    maker = F.startswith(F.col("id"), F.lit(MAKER))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    tables = [t.select(F.col("cas").alias("id")) for t in (products, hazards, classes, statements) if t is not None]
    ids = reduce(DataFrame.unionByName, tables, ends).filter("id is not null").distinct()
    last = F.max(F.struct("document_id", *OF_SHEET)).alias("s")
    # a class that a later sheet lacks stays
    sheet = products.groupBy(F.col("cas").alias("id")).agg(last, F.max_by("hazard_class", F.when(F.coalesce("hazard_class", F.lit("")) != "", F.col("document_id"))).alias("ghs_class")).select("id", *[F.col(f"s.{c}").alias(c) for c in OF_SHEET], "ghs_class")
    nodes = ids.join(sheet, "id", "left")
    empty = {"hazard_flags": "string", "env_risk": "boolean", "idlh": "double", "pel": "double", "rel": "double", "hazard_classes": "array<string>", "p_statements": "array<string>"}
    if hazards is not None:
        nodes = nodes.join(hazards.groupBy(F.col("cas").alias("id")).agg(*[F.max(c).alias(c) for c in OF_HAZARDS]), "id", "left")
    for table, column, name in ((classes, "ghs_class", "hazard_classes"), (statements, "p_code", "p_statements")):
        if table is not None:
            nodes = nodes.join(table.groupBy(F.col("cas").alias("id")).agg(F.array_sort(F.collect_set(column)).alias(name)), "id", "left")
    nodes = nodes.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in nodes.columns})
    kind = F.when(maker, "manufacturer").otherwise("chemical")
    return nodes.select("id", kind.alias("kind"), F.when(maker, F.substring("id", len(MAKER) + 1, 1 << 30)).alias("name"), *OF_SHEET, "ghs_class", *OF_HAZARDS, "hazard_classes", "p_statements")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, chemicals, manufacturers, avg_degree (twice the edges by node), density (edges by ordered pairs of nodes; 0 under two), with_hazards, with_p_statements, with_similarity, and
    the coverage of each of the three as ``x/y`` of the chemicals."""
    own = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "chemical").alias("chemicals"), F.count_if(F.col("kind") == "manufacturer").alias("manufacturers"),
        F.count_if((F.col("kind") == "chemical") & (F.size("hazard_classes") > 0)).alias("with_hazards"), F.count_if((F.col("kind") == "chemical") & (F.size("p_statements") > 0)).alias("with_p_statements"),
    )
    linked = edges.agg(F.count("*").alias("edges"), F.count_distinct(F.when((F.col("kind") == "similar_to") & ~F.startswith("src", F.lit(MAKER)), F.col("src"))).alias("with_similarity"))
    both = own.unionByName(linked, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])  # a row each, as one
    n, e = F.col("nodes"), F.col("edges")
    covered = [F.concat_ws("/", F.col(c).cast("string"), F.col("chemicals").cast("string")).alias(c.removeprefix("with_") + "_coverage") for c in ("with_hazards", "with_p_statements", "with_similarity")]
    density = F.when(n > 1, e / (n * (n - 1))).otherwise(0.0)
    return both.select("nodes", "edges", "chemicals", "manufacturers", F.when(n > 0, 2 * e / n).otherwise(0.0).alias("avg_degree"), density.alias("density"), "with_hazards", "with_p_statements", "with_similarity", *covered)


def edge_kinds(edges: DataFrame) -> DataFrame:
    """(kind, n) of the edges."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def code_tables(extractions: DataFrame) -> dict[str, DataFrame]:
    """Tables classes (cas, ghs_class), h_codes (cas, h_code) and p_codes (cas, p_code) of extractions (document_id, field_name, value): what each document's sheet says of its own number, each pair once.

    Classes are the texts themselves; codes are those of the statements. Documents without a known number give nothing."""
    value = lambda f: F.max(F.when(F.col("field_name") == f, F.col("value")))
    sheets = extractions.groupBy("document_id").agg(value("cas_number").alias("cas"), value("hazard_class").alias("ghs_class"), value("h_statements").alias("h"), value("p_statements").alias("p"))
    sheets = sheets.filter(F.col("cas").isNotNull() & (F.col("cas") != "") & ~F.col("cas").isin(*UNKNOWN))
    codes = lambda c, letter, name: sheets.select("cas", F.explode(statement_codes(F.coalesce(c, F.lit("")), letter)).alias(name)).distinct()
    held = sheets.select("cas", "ghs_class").filter("ghs_class <> ''").filter(~F.col("ghs_class").isin(*UNKNOWN)).distinct()
    return {"classes": held, "h_codes": codes("h", "H", "h_code"), "p_codes": codes("p", "P", "p_code")}


def load_codes(stored: dict[str, DataFrame], extractions: DataFrame) -> dict[str, DataFrame]:
    """The ``stored`` tables of ``code_tables`` with the pairs that they hadn't: insert or ignore."""
    return {name: insert_ignore(stored[name], rows, rows.columns, rows.columns) for name, rows in code_tables(extractions).items()}

