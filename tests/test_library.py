"""Queries against DuckDB over the supplied tables, and the literal fixtures."""

import glob
import itertools
import json
import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from safesheet.functions.chem import cas_valid, codes, unordered
from safesheet.functions.texts import context_score, json_from_text
from safesheet.operators import catalog
from safesheet.plans.domain import duckdb_query, render
from safesheet.sources import jsonl
from safesheet.streaming import metrics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql())[::5])
def test_query_equals_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[k]) for k in at] for r in rel.fetchall())


def test_every_query_has_an_oracle():
    assert catalog.queries().keys() - catalog.oracle_sql().keys() == {"ml_train", "chunk_recursive", "hybrid_query", "doc_components", "vector_index_topk", "latency_rollup", "similar_communities", "forest_metrics"}  # forests, recursive splits, propagation, searched lists and sketches have no SQL


def test_rules_hold_every_pair_of_an_order(spark, con):
    cas = dict(con.sql("SELECT document_id - 1, cas FROM (" + duckdb_query("SELECT document_id, cas FROM chem") + ")").fetchall())
    orders = defaultdict(list)
    for order, part, flag in con.sql("SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem").fetchall():
        orders[order].append((part, flag))
    flags = defaultdict(set)
    for lines in orders.values():
        for (x, f), (y, g) in itertools.permutations(lines, 2):
            if x < y:
                flags[tuple(sorted((cas[x], cas[y])))].add(min(f, g))
    expect = {(*pair, {"R": "R", "A": "I"}.get(min(own), "C")) for pair, own in flags.items()}
    assert {(r["cas_a"], r["cas_b"], r["rule"]) for r in catalog.queries()["backup_rules"](spark, SF).collect()} == expect
    near = defaultdict(set)
    for a, b, _ in expect:
        near[a].add(b)
    start = min(a for a, _, rule in expect if rule == "I")
    front, walk = {start}, set()
    for depth in (1, 2, 3):
        front = set().union(*(near[a] for a in front))
        walk |= {(start, b, depth) for b in front}
    assert {(r["cas_a"], r["cas_b"], r["depth"]) for r in catalog.queries()["transitive_incompat"](spark, SF).collect()} == walk


def over(spark, name, **tables):
    """The query over small tables in place of the derived ones."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(t)
    got = [tuple(r) for r in spark.sql(render(catalog.TEXTS[name], 0)).collect()]
    for t in tables:
        spark.catalog.dropTempView(t)
    return got


def test_clean_names_missing_codes_and_scored_neighbours(spark):
    names = ["  Acid \t\n mix  CODIGO DO PRODUTO: 12", "12345", "12 34", "ab", "codigo do produto 7", None]
    assert sorted(over(spark, "clean_name", extractions=([(k, "product_name", v) for k, v in enumerate(names)], "document_id int, field_name string, value string"))) == [(0, "Acid mix"), (2, "12 34")]
    flags = "cas string, flammable boolean, toxic boolean, corrosive boolean"
    hazards = [("a", True, True, False), ("b", False, False, True), ("c", False, False, False), ("d", True, True, False)]
    wide = [(1, "a", "H225; H319", "P264"), (2, "b", "H302", "P280"), (3, "c", "H302", None), (4, "d", None, None)]
    got = sorted(over(spark, "missing_codes", hazards=(hazards, flags), wide=(wide, "document_id int, cas_number string, h_statements string, p_statements string")))
    h, p = "h_statements", "p_statements"
    assert got == [(1, h, "H300"), (1, p, "P210"), (2, h, "H314"), (4, h, "H225"), (4, h, "H300"), (4, p, "P210"), (4, p, "P264")]
    assert over(spark, "similar_scored", hazards=(hazards, flags)) == [("d", 0.8)]


def test_check_digit(spark):
    rows = [("64-17-5", True), ("64-17-6", False), ("7732-18-5", True), ("1310-73-2", True), ("x", False), (None, None)]
    df = spark.createDataFrame(rows, "cas string, ok boolean").withColumn("got", cas_valid(F.col("cas")))
    assert all(r["ok"] == r["got"] for r in df.collect())


def test_codes_and_pairs(spark):
    r = spark.sql("SELECT 'H225, H999; H319 H225' AS t, 'b' AS x, 'a' AS y").select(codes(F.col("t"), "H", 200, 413).alias("c"), unordered(F.col("x"), F.col("y")).alias("p")).first()
    assert r["c"] == ["H225", "H319"] and tuple(r["p"]) == ("a", "b")


def test_json_and_context(spark):
    cases = [("x {\"a\": {\"b\": 1}} {}", '{"a": {"b": 1}}'), ("```\n{\"a\": 2}\n``` {\"b\": 1}", '{"a": 2}'), ("{ open", None), ("{oops}", None), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "t string, ok string").withColumn("got", json_from_text(F.col("t")))
    assert all(r["ok"] == r["got"] for r in df.collect())
    cases = [("cas_number", ["CAS registry"], 0.95), ("packing_group", ["PG"], 0.8), ("product_name", ["none"], 0.6), ("other", ["cas"], 0.75), ("cas_number", [], 0.7), ("cas_number", None, 0.7)]
    df = spark.createDataFrame(cases, "f string, p array<string>, ok double").withColumn("got", context_score(F.col("f"), F.col("p")))
    assert all(r["ok"] == r["got"] for r in df.collect())


def test_forests(spark):
    rows = {r["task"]: r for r in catalog.queries()["ml_train"](spark, SF).collect()}
    assert rows["regression"]["measure"] < 0.2 and rows["classification"]["measure"] > 0.5 and rows["regression"]["n_test"] > 100


def test_json_lines(spark, tmp_path):
    rule = json.dumps({"cas_a": "1", "cas_b": "2", "rule": "I", "source": "s"})
    lines = [rule, json.dumps({"cas_a": "1", "cas_b": "3", "rule": "R", "source": "s"}), "{oops", json.dumps({"cas_a": "1", "rule": "I"}), rule, ""]
    (tmp_path / "rules.jsonl").write_text("\n".join(lines))
    found = {r["outcome"]: r["count"] for r in jsonl.read_rules(spark, str(tmp_path / "rules.jsonl")).groupBy("outcome").count().collect()}
    assert found == {"processed": 2, "invalid_json": 1, "missing_fields": 1, "duplicate_hash": 1}
    lines = [json.dumps({"cas": "1", "hazard_flags": {"toxic": True}, "idlh": 5.0}), json.dumps({"cas": ""}), "["]
    (tmp_path / "hazards.jsonl").write_text("\n".join(lines))
    found = {r["outcome"]: r["count"] for r in jsonl.read_hazards(spark, str(tmp_path / "hazards.jsonl")).groupBy("outcome").count().collect()}
    assert found == {"processed": 1, "missing_cas": 1, "invalid_json": 1}


def test_streaming_hours_equal_batch(spark, tmp_path):
    logs = spark.read.parquet(f"{SF}/events.parquet").select("ts", (F.col("value") / 100).alias("total_time"))
    logs.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    q = metrics.hourly_metrics(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = logs.groupBy(F.date_trunc("HOUR", "ts").alias("hour")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.sql("SELECT hour, n FROM hours").collect())) == sorted(map(tuple, batch.collect()))


def test_streaming_dedupe(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",), ("a",)], "text string").withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    q = metrics.new_contents(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("contents").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["text"] for r in spark.sql("SELECT text FROM contents").collect()) == ["a", "b"]


def test_entry_without_the_optional_package(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
