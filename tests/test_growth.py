"""What the queries' work grows with: tests of the forms that don't grow with the square of equal rows."""

import pytest
from pyspark.sql import functions as F

from safesheet.functions import confidence_model, intake, substrings
from safesheet.operators import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def seen(monkeypatch):
    """The numbers of rows that forests are fitted on."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    found = []
    for kind in (RandomForestClassifier, RandomForestRegressor):
        plain = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, rows, plain=plain: (found.append((rows.count(), rows.agg(F.sum("weight")).first()[0])), plain(self, rows))[1])
    monkeypatch.setattr(confidence_model, "TREES", 3)
    return found


def test_forests_learn_equal_examples_by_their_number(spark, seen):
    df = spark.range(4000).select("id", (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2 * 0.5 + 0.2).alias("confidence"), F.when(F.col("id") % 2 == 1, "good").otherwise("poor").alias("tier"))
    model = confidence_model.train(df, ["id"], ["x"])
    assert model.metrics["train_size"] + model.metrics["test_size"] == 4000 and model.metrics["accuracy"] == 1
    assert len(seen) == 2 and all(n <= 2 * confidence_model.PIECES and w == model.metrics["train_size"] for n, w in seen)
    weights = [r["weight"] for r in confidence_model.weighted(df, ["id"], ["x", "confidence"]).collect()]
    assert sum(weights) == 4000 and len(weights) <= 2 * confidence_model.PIECES


def test_ml_train_learns_equal_rows_by_their_number(spark, seen, monkeypatch, tmp_path):
    from safesheet.operators import answers

    monkeypatch.setattr(answers, "TREES", 3)
    spark.range(3000).selectExpr("id AS p_partkey", "'ring' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "CAST(id % 3 AS INT) AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rows = {r["task"]: r for r in catalog.queries()["ml_train"](spark, str(tmp_path)).collect()}
    assert len(seen) == 2 and all(n < w / 2 for n, w in seen)
    assert all(r["n_test"] + seen[0][1] > 26000 for r in rows.values())


def test_named_counts_equal_counted_pairs(spark):
    rows = [(1, "Acid Red", ["Water", "base"]), (2, "base of water", None), (3, "Water", ["acid"]), (4, None, ["RED"]), (5, "reddish", [""]), (6, "base", ["base", "BASE"]), (7, "base", ["base"]), (8, "water", ["e", "r"])]
    rows += [(1, "acid", ["red"]), (None, "red", ["red"])]  # an id that comes again, and none
    df = spark.createDataFrame(rows, "id int, name string, tokens array<string>")
    want = {}
    for a, _, parts in rows:
        n = sum(1 for b, name, _ in rows if a is not None and b is not None and a != b and name and any(t and t.lower() in name.lower() for t in parts or []))
        want[a] = want.get(a, 0) + n
    got = substrings.named_counts(df, F.col("tokens")).collect()
    assert {r["id"]: r["n"] for r in got} == {a: n for a, n in want.items() if n} and len(got) == len({r["id"] for r in got})


def test_first_of_equal_keeps_rows_without_an_earlier_one(spark):
    rows = [(1, "a"), (2, "a"), (1, "a"), (3, None), (4, None), (None, "a"), (5, "b"), (None, "c")]
    got = intake.first_of_equal(spark.createDataFrame(rows, "id int, file_hash string")).collect()
    want = [r for r in rows if not any(k[1] is not None and k[1] == r[1] and k[0] is not None and r[0] is not None and k[0] < r[0] for k in rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = catalog.queries()["register_new_docs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftOuter" in plan


def test_rules_are_made_in_parts_that_follow_the_lines(spark, tmp_path, monkeypatch):
    import duckdb

    from safesheet.plans import domain

    spark.createDataFrame([(k, f"name {k}", "Brand#1", "SMALL", k % 7, 1.0) for k in [*range(40), 7]], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    flags = ["R", "A", "N", None, "", "B", "Z", "a", "RR"]
    lines = [(None if k % 50 == 0 else k % 60, None if k % 41 == 0 else k * 13 % 45, flags[k * k % 9]) for k in range(700)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(domain.duckdb_query("SELECT cas_a, cas_b, rule, source FROM rules")).fetchall())
    monkeypatch.setattr(domain, "LINES", 50)
    made = domain.rules_made(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 2 * (700 // 50 + 1)
    assert sorted(map(tuple, made.collect())) == want and {r[2] for r in want} == {"R", "I", "C"}
    both = domain.spark_query(spark, str(tmp_path), "SELECT src, dst, rule FROM both_ways")
    assert both.count() == 2 * len(want) and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()  # the rules are made once, and read


def test_walks_write_their_fronts_and_leave_equal_edges_out(spark, monkeypatch):
    from safesheet.functions import walks

    monkeypatch.setattr(walks, "cut", None, raising=False)  # a checkpoint's size isn't known, so that all edges were shuffled at each step
    pairs = [(a, b) for a in range(9) for b in range(9) if (a * 5 + b) % 4 == 0 and a != b] * 3
    near = {a: {b for x, b in pairs if x == a} for a in range(9)}
    edges, starts = spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(0,), (5,)], "start int")
    paths = [[(s,) for s in (0, 5)]]
    for _ in range(3):
        paths.append([(*p, b) for p in paths[-1] for b in near[p[-1]] if b not in p])
    assert sorted(tuple(r["path"]) for r in walks.simple_paths(edges, starts, 3).collect()) == sorted(p for step in paths[1:] for p in step)
    far = {}
    for s in (0, 5):
        seen, front = {s}, {s}
        for k in (1, 2):
            front = {b for a in front for b in near[a]} - seen
            seen |= front
            far |= {(s, b): k for b in front}
    assert sorted(map(tuple, walks.nearest(edges, starts, 2).collect())) == sorted((s, b, k) for (s, b), k in far.items())
    held = {s: {s, *near[s]} for s in (0, 5)}
    assert sorted(map(tuple, walks.neighbourhood(edges, starts, 1).collect())) == sorted((s, a, b) for s in held for a in held[s] for b in near[a] & held[s])
    assert {(r["start"], r["node"]) for r in walks.closure(edges, starts, 1).collect()} == {(s, b) for s in (0, 5) for b in near[s]}


def test_sheets_are_spread_and_their_patterns_run_once(spark):
    from safesheet.functions import fields
    from safesheet.operators import sheets

    made = sheets.sheets(spark, SF)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got, plain = fields.extract_fields(made.drop("profile"), context=False), fields.extract_fields(made.drop("profile"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.drop("context").collect())) and "context" not in got.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GHS0[1-9]") == 2 and "regexp_instr" not in plan  # the pattern names the pictograms twice


def test_own_patterns_need_no_context(spark):
    from safesheet.functions import fields
    from safesheet.operators import sheets

    made = sheets.sheets(spark, SF)
    plain = fields.extract_fields(made, overrides=sheets.OVERRIDES)
    got = fields.extract_fields(made, overrides=sheets.OVERRIDES, context=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.drop("context").collect())) and got.filter("source = 'heuristic_profile_maker'").count() > 0


def test_patterns_are_tried_where_what_they_hold_is(spark, monkeypatch):
    from safesheet.functions import fields

    words = ["OSHA: 5 ppm", "o\u017fha 6 ppm", "Pel 7 ppm", "NIO\u017fH 3 ppm", "n\u0130osh 4 ppm", "N\u0131OSH 5 ppm", "rel-8 ppb", "acg\u0130h 9 ppm", "tlv 1 mg/m\u00b3", "\u0130dlh 2 ppm", "\u0131DLH 3 ppm", "oral x ld50 5 mg/\u212ag", "derma\u217c LD50 6 mg/kg", "Oral LD 50 7 mg/kg",
             "inala\u00e7\u00e3o lc50: 8 ppm", "t\u017fca l\u0130\u017fted", "Sara 313: yes", "prop 65 no", "Proposition65 s\u0131m", "California x 65 warn\u0130ng", "\u00df \ufb01 \ufb06", "", None]
    rows = [(k, w, {8: w or ""} if k % 2 else {}) for k, w in enumerate(words + [f"\u00b0 {w}\n{w}" for w in words])]
    sheets = spark.createDataFrame(rows, "id int, text string, sections map<int,string>")
    got = fields.extract_fields(sheets)
    assert "Contains(__upper8" in got._jdf.queryExecution().optimizedPlan().toString()
    own = fields.extract_fields(sheets, [("toxicity_oral_ld50", 11, fields.ANY_CASE, r"oral\s+(x)")])  # another pattern by a known name isn't held back
    assert own.count() == 2 and "__upper" not in own._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(fields, "HELD", {})
    assert sorted(map(str, got.collect())) == sorted(map(str, fields.extract_fields(sheets).collect())) and len({r["field_name"] for r in got.collect()}) >= 9


def test_pages_are_spread(spark):
    assert catalog.queries()["scraped_pages"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_mixtures_are_sorted_in_parts_that_follow_the_components(spark, monkeypatch):
    from safesheet.functions import mixtures

    monkeypatch.setattr(mixtures, "COMPONENTS", 20, raising=False)
    rows = [(k % 7, k, f"{k % 3 + 50}-11-1", f"c{k % 3}", 5.0 + k % 4 * 5) for k in range(300)]
    parts = spark.createDataFrame(rows, "document_id int, line_no int, cas_number string, name string, max_concentration double")
    known = spark.createDataFrame([("50111", "H225", "2", "a", "s", "x", 0.5), ("50111", "H225", "2", "b", "s", "y", 0.9), ("51-11-1", "H300", "2", "t", "s", "x", 0.9), ("99-11-1", "H300", "2", "t", "s", "x", 0.9)],
                                  "cas_number string, hazard_code string, category string, hazard_class string, statement string, source string, confidence double")
    found = mixtures.mixture_hazards(parts, known)
    assert found.rdd.getNumPartitions() == 300 // 20 + 1
    first = {}
    for d, line, cas, name, most in rows:
        for code, least, plain in (("H225", 10, "50-11-1"), ("H300", 1, "51-11-1")):
            if cas == plain and most >= least:
                first.setdefault((d, code), name)
    assert {(r["document_id"], r["hazard_code"]): r["source"] for r in found.collect()} == {k: f"Calculated from {v}" for k, v in first.items()}
    assert {r["hazard_class"] for r in found.collect()} == {"b", "t"}


def test_products_of_blocks_equal_an_aggregate(spark, monkeypatch):
    from safesheet.functions import vectors
    from safesheet.operators.vector import _dot

    for name in ("ASKED_BLOCK", "ROWS_BLOCK", "AT_ONCE"):
        monkeypatch.setattr(vectors, name, 7)
    rows = [(k, [((k * j * 37) % 19 - 9) / 7 for j in range(1, 6)]) for k in range(60)] + [(None, [1.0] * 5), (70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [1.0, 2.0]), (73, []), (74, [3.0, 4.0]), (75, []), (3, [0.5] * 5), (76, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.filter("id % 3 = 0 OR id > 69")
    a, b = asked.select(F.col("id").alias("id_a"), F.col("embedding").alias("a")), df.select(F.col("id").alias("id_b"), F.col("embedding").alias("b"))
    want = a.join(b, F.col("id_a") != F.col("id_b")).select("id_a", "id_b", F.round(_dot("a", "b"), 6).alias("score"))
    plain = lambda found: sorted(str(tuple(r)) for r in found.collect())
    assert plain(vectors.products(asked, df)) == plain(want)
    assert plain(vectors.products(asked, df, 0.3)) == plain(want.filter("score > 0.3"))
    assert vectors.products(asked, df).columns == want.columns


def _edges_given(spark, monkeypatch, module, function, name):
    """The plan of the edges that a query hands on."""
    given = []

    class Enough(Exception):
        pass

    def stop(edges, *rest):
        given.append(edges._jdf.queryExecution().executedPlan().toString())
        raise Enough

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Enough):
        catalog.queries()[name](spark, SF)
    return given[0]


def test_components_read_similarities_that_are_made_once(spark, monkeypatch):
    from safesheet.functions import walks

    plan = _edges_given(spark, monkeypatch, walks, "communities", "doc_components")
    assert "Scan parquet" in plan and "CoGroup" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_modularity_reads_similarities_that_are_made_once(spark, monkeypatch):
    from safesheet.functions import communities

    plan = _edges_given(spark, monkeypatch, communities, "by_modularity", "similar_communities")
    assert "Scan parquet" in plan and "CoGroup" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_fingerprints_are_dealt_out_by_their_number(spark, monkeypatch):
    from safesheet.functions import walks

    prints = spark.createDataFrame([(k, [k % 3, 10, 11, 12]) for k in range(90)] + [(90, []), (91, None)], "id int, bits array<int>")
    monkeypatch.setattr(walks, "MEMBERS", 7, raising=False)
    monkeypatch.setattr(walks, "PAIRS", 100, raising=False)
    found = walks.tanimoto_pairs(prints, 0.7)
    assert found.rdd.getNumPartitions() == 3 * 30 * 30 // 100 + 1
    assert sorted(map(tuple, found.collect())) == [(a, b, 1.0) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3]
    assert walks.tanimoto_pairs(prints, 0.5).count() == 90 * 89 // 2
    assert walks.tanimoto_pairs(prints.filter("id >= 90"), 0.5).count() == 0


def test_forests_without_a_shared_folder_are_an_error(spark, monkeypatch, tmp_path):
    from safesheet.plans import shared

    def unset(session):
        raise ValueError("spark.checkpoint.dir has to name a folder")

    plain = shared.shared_dir
    monkeypatch.setattr(shared, "shared_dir", unset)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        catalog.queries()["forest_metrics"](spark, SF)
    monkeypatch.setattr(shared, "shared_dir", plain)
    spark.read.parquet(f"{SF}/part.parquet").limit(1).write.parquet(f"{tmp_path}/part.parquet")
    few = catalog.queries()["forest_metrics"](spark, str(tmp_path))
    assert few.columns == ["measure", "value"] and few.count() == 0


@pytest.mark.parametrize("name", ["bench_q04", "processed_meta", "processed_ts"])
def test_documents_are_not_broadcast(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashedRelationBroadcastMode" not in plan
    assert "/*+" not in catalog.oracle_sql()[name]


def test_partners_are_sent_as_lists(spark, tmp_path, monkeypatch):
    import duckdb

    from safesheet.plans import domain

    spark.createDataFrame([(k, f"name {k}", "Brand#1", "SMALL", k % 7, 1.0) for k in [*range(40), 7]], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(None if k % 50 == 0 else k % 211, None if k % 41 == 0 else k * k % 45, "N") for k in range(700)] + [(900, 20, "R"), (900, 33, "A"), (901, 38, "R")]  # parts of 40 and more are in no table
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT cas, n, partners FROM ({catalog.oracle_sql()['chemical_clusters']})").fetchall())
    monkeypatch.setattr(domain, "LINES", 50)
    monkeypatch.setattr(domain, "rules_made", None)  # rules and their two directions took more disk than there was
    found = catalog.queries()["chemical_clusters"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("cas", "n", "partners").collect())) == want and len(want) > 5 and min(r[1] for r in want) >= 5
    made = domain.partners_made(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 2 * (made.sparkSession.read.parquet(f"{tmp_path}/lineitem.parquet").dropna(subset=["l_orderkey", "l_partkey"]).count() // 50 + 1)
    assert made.filter("n < 5").count() > 0
