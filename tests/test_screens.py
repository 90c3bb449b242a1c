"""Screened texts, mixtures, wide rows, missing fields and confidence against literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from safesheet.functions import confidence_model, logs, mixtures, screening, wide


def column(spark, texts, made):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["x"] for r in df.select("id", made(F.col("text")).alias("x")).orderBy("id").collect()]


def test_screen_of_incompatibility_texts(spark):
    texts = [None, "  ", "N/A", "Avoid water", "x" * 201 + " unknown avoid", "Based on the\nwhole context: avoid", "based on the context: avoid", "water, acids", "Evitar o calor", "It is not found"]
    assert column(spark, texts, screening.screen) == ["blank", "blank", "no_data", None, None, None, "about_the_question", "no_key_word", None, "no_data"]


def test_incompatible_names(spark):
    rows = [(1, "Reacts with Strong Acids (HCl, HF); abc / oxidizers\nBases (all)", "own"), (2, "none", "own"), (3, "avoid " + ", ".join(f"name {k}" for k in range(14)), "own"), (4, "avoid (this)" + "y" * 90 + ", (only brackets)", "own"), (5, None, "own")]
    got = screening.incompatible_names(spark.createDataFrame(rows, "id int, text string, source string")).orderBy("id", "nth").collect()
    assert [(r["nth"], r["name"]) for r in got if r["id"] == 1] == [(1, "reacts with strong acids (hcl"), (2, "oxidizers"), (3, "bases")]
    assert [r["nth"] for r in got if r["id"] == 3] == list(range(1, 11)) and not [r for r in got if r["id"] in (2, 4, 5)] and got[0]["source"] == "own"


def test_language_and_profile(spark):
    texts = ["Safety Data Sheet, hazard", "FICHA DE DADOS DE SEGURANCA Fabricante", "fabricante numero cas emergencia", "nothing", None, "gefahr"]
    got = column(spark, texts, screening.language_by_words)
    assert [(r["lang"], round(r["confidence"], 4)) for r in got] == [("en", 0.8333), ("pt", 0.8333), ("es", 1.0), ("unknown", 0.0), ("unknown", 0.0), ("de", 0.4167)]
    makers = ["by merck", "Avantor", "x" * 3000 + "MERCK", "thermo fisher and VWR International", None]
    assert column(spark, makers, screening.maker_profile) == ["Sigma-Aldrich", "VWR", "Generic", "Fisher Scientific", "Generic"]
    assert column(spark, ["Merck"], lambda c: screening.maker_profile(c, preferred="vwr")) == ["VWR"] and column(spark, ["Merck"], lambda c: screening.maker_profile(c, preferred="none")) == ["Sigma-Aldrich"]


def test_mixture_thresholds(spark):
    pairs = [("H225", "2", 10.0), ("H300", "1", 0.1), ("H350", "1A", 0.1), ("H315", "2", 10.0), ("H315", "9", 100.0), ("H999", "", 100.0)]
    df = spark.createDataFrame(pairs, "code string, category string, want double")
    assert [r["got"] == r["want"] for r in df.withColumn("got", mixtures.threshold(F.col("code"), F.col("category"))).collect()] == [True] * 6


def test_mixture_hazards(spark):
    known = spark.createDataFrame(
        [("64-17-5", "H225", "2", "f", "s", "ECHA", 0.95), ("64175", "H225", "2", "f", "other", "A", 0.9), ("64-17-5", "H319", "2", "e", "s", "ECHA", 0.9), ("67-64-1", "H225", "2", "g", "t", "ECHA", 0.9), ("67-64-1", "H336", None, "d", "t", "ECHA", 0.9)],
        "cas_number string, hazard_code string, category string, hazard_class string, statement string, source string, confidence double",
    )
    parts = spark.createDataFrame([(1, 2, " 64-17-5 ", "ethanol", 10.0), (1, 1, "67641", None, 12.0), (2, 1, "64-17-5", "e", 9.9), (3, 1, "67-64-1", "a", 100.0), (4, 1, "64-17-5", "e", None), (5, 1, None, "e", 50.0)], "document_id int, line_no int, cas_number string, name string, max_concentration double")
    got = sorted((r["document_id"], r["hazard_code"], r["category"], r["hazard_class"], r["source"], r["confidence"]) for r in mixtures.mixture_hazards(parts, known).collect())
    assert got == [(1, "H225", "2", "g", "Calculated from 67641", 0.9), (1, "H319", "2", "e", "Calculated from ethanol", 0.9), (3, "H225", "2", "g", "Calculated from a", 0.9), (3, "H336", "", "d", "Calculated from a", 0.9)]


def test_wide_results_and_gaps(spark):
    documents = spark.createDataFrame(
        [(1, "a", "success", True, "2024-01-02", 1.0, None, None), (2, "b", "failed", False, None, 1.0, 0.5, 0.9), (3, "c", "pending", False, "2024-01-09", 1.0, 0.5, 0.9), (4, "d", "partial", False, "2024-01-03", 1.0, 0.5, 0.9)],
        "id int, filename string, status string, is_dangerous boolean, processed_at string, processing_time_seconds double, completeness_score double, avg_confidence double",
    )
    extractions = spark.createDataFrame(
        [(1, "product_name", "x", 0.5, '{"quality_tier": "good", "external_validation": {"is_valid": true}}'), (1, "product_name", "y", 0.7, "broken"), (1, "ph", "7", 0.6, None), (4, "cas_number", "64-17-5", 0.6, '{"quality_tier": "good"}'), (2, "ph", "NOT_FOUND", 0.1, None)],
        "document_id int, field_name string, value string, confidence double, metadata string",
    )
    got = wide.wide_results(documents, extractions).collect()
    assert [r["id"] for r in got] == [4, 1, 2] and [r["id"] for r in wide.wide_results(documents, extractions, 1).collect()] == [4] and len(wide.wide_results(documents, extractions, None).collect()) == 3
    assert (got[1]["product_name"], got[1]["quality_tier"], got[1]["validated"], got[1]["completeness"], round(got[1]["avg_confidence"], 6)) == ("y", "good", True, 0.0, 0.6)
    assert (got[0]["cas_number"], got[0]["quality_tier"], got[0]["validated"]) == ("64-17-5", "unknown", False) and got[2]["product_name"] is None
    gaps = {r["field_name"]: (r["filled"], r["documents"], r["status"]) for r in wide.field_gaps(extractions).collect()}
    assert len(gaps) == 18 and gaps["ph"] == (1, 1, "partial") and gaps["flash_point"] == (0, 0, "none")
    assert {r["status"] for r in wide.field_gaps(extractions.filter("document_id = 1")).filter("field_name = 'ph'").collect()} == {"full"}


def test_forests_learn_and_predict(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        f = [rng.random() for _ in logs.FEATURES]
        rows.append((k, *f, 0.3 + 0.6 * f[0], "good" if f[0] > 0.6 else "poor"))
    schema = "id int, " + ", ".join(f"{n} double" for n in logs.FEATURES) + ", confidence double, tier string"
    df = spark.createDataFrame(rows, schema)
    model = confidence_model.train(df, ["id"])
    assert model.metrics["r2"] > 0.6 and model.metrics["accuracy"] > 0.85 and model.metrics["f1"] > 0.8 and model.metrics["train_size"] + model.metrics["test_size"] == 400
    assert abs(model.metrics["rmse"] ** 2 - model.metrics["mse"]) < 1e-9 and model.importances[0][0] == logs.FEATURES[0] and abs(sum(x for _, x in model.importances) - 1) < 1e-6
    said = confidence_model.predict(model, df).collect()
    assert len(said) == 400 and all(0 <= r["confidence"] <= 1 and 0 <= r["high_quality_probability"] <= 1 for r in said) and {r["quality_tier"] for r in said} <= {"excellent", "good", "acceptable", "poor", "unreliable"}
    with pytest.raises(ValueError, match="too few"):
        confidence_model.train(df.limit(5), ["id"])


def test_confidence_by_rule(spark):
    names = list(confidence_model.RULE)
    rows = [(1.0, 1.0, 1.0, 3.0), (0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.0, 1.0), (5.0, 1.0, 1.0, 1.0)]
    got = confidence_model.by_rule(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))).collect()
    assert [(round(r["confidence"], 6), r["quality_tier"], r["is_high_quality"]) for r in got] == [(0.93, "good", True), (0.5, "poor", False), (0.65, "acceptable", False), (1.0, "good", True)]


def test_enrichment_compares_each_field(spark):
    from safesheet.functions import enrichment

    documents = spark.createDataFrame(
        [(1, None, "c2 h6o", None, "H225", None, "Ethanol X", 0.5), (2, "64-17-6", "CH4", "46", "H225,H319", "P210", "ethyl", None), (3, None, None, None, None, None, None, 0.8), (4, None, None, None, None, None, None, 0.1)],
        "document_id int, cas_number string, molecular_formula string, molecular_weight string, h_statements string, p_statements string, product_name string, mean_confidence double",
    )
    own = ("64-17-5", "C2H6O", "ethanol", "46.069", "CCO", "LFQ", ["H319", "H225"], ["P210"], ["GHS02"], ["Ethyl alcohol", "Ethanol"], "http://x")
    properties = spark.createDataFrame([(k, *own) for k in (1, 2, 3)] + [(4, None, None, None, "about 46", None, None, None, None, [], [], None)], f"document_id int, {enrichment.PROPERTIES}")
    got = {(r["document_id"], r["field_name"]): r for r in enrichment.compare(documents, properties).collect()}
    brief = {k: (r["original"], r["enriched"], r["confidence"], r["status"]) for k, r in got.items()}
    assert brief[1, "cas_number"] == (None, "64-17-5", 0.85, "enriched") and brief[2, "cas_number"] == ("64-17-6", "64-17-5", 0.6, "warning")
    assert (1, "molecular_formula") not in got and brief[2, "molecular_formula"] == ("CH4", "C2H6O", 0.65, "warning")
    assert brief[1, "molecular_weight"] == (None, "46.07 g/mol", 0.95, "enriched") and brief[2, "molecular_weight"][0] == "46" and brief[4, "molecular_weight"] == (None, "about 46", 0.8, "enriched")
    assert brief[1, "h_statements"] == ("H225", "H225, H319", 0.8, "enriched") and got[1, "h_statements"]["missing"] == ["H319"] and (2, "h_statements") not in got
    assert brief[1, "p_statements"] == (None, "P210", 0.8, "enriched") and (2, "p_statements") not in got
    assert brief[1, "product_name"][2:] == (0.5, "warning") and (2, "product_name") not in got and brief[1, "ghs_pictograms"][1] == "GHS02" and brief[1, "inchi_key"][2] == 0.95
    assert not [k for k in got if k[0] == 3] and {f for d, f in got if d == 4} == {"molecular_weight"}
    more = {r["field_name"] for r in enrichment.compare(documents, properties, aggressive=True).collect()} - {f for _, f in got}
    assert more == {"reference", "chemical_synonyms"}


def test_collection_is_added_deleted_and_asked(spark, tmp_path):
    from safesheet.functions import retrieval, vectors

    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no model")
        return [[1.0, float(len(t))] for t in texts]

    rows = [(k, "s1" if k % 2 else "s2", f"text {'x' * k}") for k in range(6)] + [(6, None, None), (7, "s1", "bad"), (8, "s1", "after")]
    chunks = spark.createDataFrame(rows, "document_id int, source string, text string").coalesce(1)
    got = {r["document_id"]: (r["outcome"], r["embedding"]) for r in retrieval.add_documents(chunks, embed, 3).collect()}
    assert [got[k][0] for k in range(9)] == ["added"] * 6 + ["failed"] * 3 and got[2][1] == [1.0, 7.0] and got[7][1] is None
    got = {r["document_id"]: r["outcome"] for r in retrieval.add_documents(chunks, embed, 2).collect()}
    assert [got[k] for k in (5, 6, 7, 8)] == ["added", "failed", "failed", "skipped"]
    assert {(r["source"], r["documents"], r["chunks"]) for r in retrieval.collection_stats(chunks).collect()} == {("s1", 5, 5), ("s2", 3, 3), (None, 1, 1)}
    assert retrieval.delete_source(chunks, "s1").count() == 4
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", "about acids"), (2, [0.9, 0.1], None, "about bases"), (3, [0.0, 1.0], "c", "other")], "id int, embedding array<double>, source string, content string")
    centroids = vectors.fit_centroids(df, 1)
    indexed = vectors.index(df.select("id", "embedding"), centroids, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "which?", [1.0, 0.0]), (2, None, [1.0, 0.0])], "query_id int, question string, embedding array<double>")
    found = retrieval.retrieve(asked, indexed, df.select("id", "source", "content"), centroids, 2)
    r = retrieval.answer(found, lambda p, s: f"{len(p)} {s[:7]}").collect()
    assert len(r) == 1 and r[0]["context"] == "a:\nabout acids\n---\n:\nabout bases" and r[0]["answer"] == f"{len(r[0]['prompt'])} You are" and r[0]["prompt"].endswith("Question: which?\n\nAnswer:")
    none = retrieval.retrieve(asked, indexed.limit(0), df.select("id", "source", "content"), centroids, 2)
    assert [x["answer"] for x in retrieval.answer(none, lambda p, s: "never").collect()] == [retrieval.NOTHING]


def test_graph_of_all_loaders(spark):
    from safesheet.functions import knowledge_graph as kg

    rules = spark.createDataFrame([("1", "2", "I", "s", "j", "ga", "gb"), (None, "2", "I", "s", "j", "ga", "gb")], "cas_a string, cas_b string, rule string, source string, justification string, group_a string, group_b string")
    makers = spark.createDataFrame([("1", "Acme"), ("9", None)], "cas string, manufacturer string")
    families = spark.createDataFrame([("1", "3")], "cas_a string, cas_b string")
    similar = spark.createDataFrame([("2", "3", 0.9, "tanimoto")], "cas_a string, cas_b string, score double, kind string")
    edges = kg.graph_edges(rules, makers, families, similar)
    got = {(r["src"], r["dst"], r["kind"]): r for r in edges.collect()}
    assert set(got) == {("1", "2", "incompatible_with"), ("2", "1", "incompatible_with"), ("1", "mfg:Acme", "manufactured_by"), ("1", "3", "product_family"), ("3", "1", "product_family"), ("2", "3", "similar_to"), ("3", "2", "similar_to")}
    assert (got["2", "1", "incompatible_with"]["group_src"], got["2", "1", "incompatible_with"]["rule"], got["3", "2", "similar_to"]["score"], got["1", "3", "product_family"]["detail"]) == ("gb", "I", 0.9, "same_manufacturer")
    products = spark.createDataFrame([(1, "1", "old", "S", 0.1, "3"), (2, "1", "new", "T", 0.2, None), (3, "4", "x", None, None, "")], "document_id int, cas string, product_name string, supplier string, confidence double, hazard_class string")
    hazards = spark.createDataFrame([("5", "{}", True, 1.0, None, None)], "cas string, hazard_flags string, env_risk boolean, idlh double, pel double, rel double")
    classes, statements = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "a")], "cas string, ghs_class string"), spark.createDataFrame([("6", "P210")], "cas string, p_code string")
    nodes = kg.graph_nodes(edges, products, hazards, classes, statements)
    by = {r["id"]: r for r in nodes.collect()}
    assert set(by) == {"1", "2", "3", "4", "5", "6", "mfg:Acme"} and nodes.count() == 7
    assert (by["1"]["product_name"], by["1"]["ghs_class"], by["1"]["hazard_classes"]) == ("new", "3", ["a", "b"]) and by["mfg:Acme"]["name"] == "Acme" and by["4"]["ghs_class"] is None and by["5"]["env_risk"] and by["6"]["p_statements"] == ["P210"] and by["2"]["kind"] == "chemical"
    r = kg.graph_stats(nodes, edges).first()
    assert (r["nodes"], r["edges"], r["chemicals"], r["manufacturers"], r["avg_degree"], round(r["density"], 6), r["with_similarity"], r["hazards_coverage"], r["similarity_coverage"]) == (7, 7, 6, 1, 2.0, round(7 / 42, 6), 2, "1/6", "2/6")
    assert {x["kind"]: x["n"] for x in kg.edge_kinds(edges).collect()} == {"incompatible_with": 2, "manufactured_by": 1, "product_family": 2, "similar_to": 2}
    none = kg.graph_stats(nodes.limit(0), edges.limit(0)).first()
    assert (none["nodes"], none["edges"], none["density"], none["avg_degree"]) == (0, 0, 0.0, 0.0)


def test_code_tables_are_loaded_once(spark):
    from safesheet.functions import knowledge_graph as kg

    rows = [(1, "cas_number", "64-17-5"), (1, "hazard_class", "3"), (1, "h_statements", "H225 H319, H999"), (1, "p_statements", "P210"), (2, "cas_number", "NOT_FOUND"), (2, "hazard_class", "8"), (3, "cas_number", "64-17-5"), (3, "h_statements", "H225"), (3, "hazard_class", "N/A")]
    extractions = spark.createDataFrame(rows, "document_id int, field_name string, value string")
    tables = kg.code_tables(extractions)
    assert {n: sorted(tuple(r) for r in t.collect()) for n, t in tables.items()} == {"classes": [("64-17-5", "3")], "h_codes": [("64-17-5", "H225"), ("64-17-5", "H319")], "p_codes": [("64-17-5", "P210")]}
    stored = {"classes": spark.createDataFrame([("64-17-5", "3"), ("x", "y")], "cas string, ghs_class string"), "h_codes": tables["h_codes"].limit(0), "p_codes": tables["p_codes"]}
    again = kg.load_codes(stored, extractions)
    assert {n: t.count() for n, t in again.items()} == {"classes": 2, "h_codes": 2, "p_codes": 1}
