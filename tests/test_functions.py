"""Functions on frames: literal fixtures, and plain Python beside them."""

import itertools
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from safesheet.functions import chunks, fields, matrix, names, sheets, walks
from safesheet.functions.answers import normal_answer
from safesheet.sinks import exports
from safesheet.sources import files
from safesheet.sources import jsonl as jsonl_source


def one(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


# the matrix

PRODUCTS = "document_id long, product_name string, hazard_class string, incompatibilities string, cas_number string, confidence double"
RULES, HAZARDS = "cas_a string, cas_b string, rule string, source string", "cas string, hazard_flags map<string,boolean>, env_risk boolean, idlh double"


def decisions(products, rules, hazards, **options):
    return {(r["id_a"], r["id_b"]): r["decision"] for r in matrix.compatibility_matrix(products, rules, hazards, **options).collect()}


def test_matrix_of_texts(spark):
    p = spark.createDataFrame([(1, "Acido Forte", "3", "Base Forte", None, 0.9), (2, "Base Forte", "8", "zz,  acido FORTE ,", None, 0.8), (3, None, "8", "", None, 0.8), (4, "100% _x", "1", "%", None, 1.0)], PRODUCTS)
    got = decisions(p, spark.createDataFrame([], RULES), spark.createDataFrame([], HAZARDS))
    assert got == {(1, 1): "Self", (2, 2): "Self", (4, 4): "Self", (1, 2): "Incompatible", (2, 1): "Incompatible", (1, 4): "Compatible", (2, 4): "Compatible", (4, 1): "Compatible", (4, 2): "Compatible"}


def test_matrix_of_rules_and_hazards(spark):
    numbers = {1: "123-45-6", 2: "789-01-2", 3: "50-00-0", 4: "64-17-5", 5: "99-99-9"}
    p = spark.createDataFrame([(k, f"Prod {'ABCDE'[k - 1]}", "3", None, c, 0.9) for k, c in numbers.items()], PRODUCTS)
    rules = spark.createDataFrame([("123-45-6", "789-01-2", "I", "t")], RULES)
    hazards = spark.createDataFrame([("50-00-0", {"dangerous": True}, False, None), ("64-17-5", {}, True, None), ("99-99-9", None, None, 30.0)], HAZARDS)
    got = decisions(p, rules, hazards)
    assert got[1, 2] == got[2, 1] == "Incompatible" and got[3, 4] == got[5, 4] == got[5, 1] == "Restricted"
    assert decisions(p, rules, hazards, idlh=10.0)[5, 1] == "Compatible"


def test_pair_of_products(spark):
    p = spark.createDataFrame([(1, "Strong Acid", "8", "bases, water", None, 0.7), (2, "Acid two", "8", "oil", None, 0.9), (3, "Base", "8", None, None, 0.5)], PRODUCTS)
    ask = lambda a, b: tuple(matrix.check_pair(p, a, b).first())[:2]
    assert ask("strong acid", "base") == (True, 0.7) and ask("acid", "base") == (True, 0.9)
    assert ask("strong", "Base") == (True, 0.7) and ask("nothing", "base") == (True, 0.0)
    q = spark.createDataFrame([(1, "Strong Acid", "8", "base, water", None, 0.7), (3, "A Base", "8", None, None, 0.5)], PRODUCTS)
    assert tuple(matrix.check_pair(q, "acid", "a base").first()) == (False, 0.7, "8", "8")
    assert tuple(matrix.check_pair(q.limit(0), "acid", "a base").first())[:2] == (True, 0.0)


def test_decision_hash(spark):
    import hashlib

    row = spark.range(1).select(matrix.decision_hash(*[F.lit(x).cast("string") for x in ("A", "B", None, "64-17-5", "I", "structured_rule", None)]).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"A|B|None|64-17-5|I|structured_rule|").hexdigest()


def test_rules_inside_the_inventory(spark):
    rules = spark.createDataFrame([("64-17-5", "67-64-1", "I", "TEST"), ("64-17-5", "7732-18-5", "I", "T"), ("67-64-1", "64-17-5", "C", "T")], RULES)
    have = spark.createDataFrame([("67-64-1",), ("64-17-5",), ("64-17-5",)], "cas_number string")
    assert [tuple(r) for r in matrix.hazardous_combinations(rules, have).collect()] == [("64-17-5", "67-64-1", "I", "TEST")]


def test_calculated_hazards(spark):
    rows = [("Sulfuric Acid 98", 10.0), ("xylene mix", 9.0), ("Ethanol", 60.0), (None, 99.0), ("benzene", None)]
    got = matrix.calculated_hazards(spark.createDataFrame(rows, "chemical_name string, concentration_max double")).collect()
    assert sorted((r["chemical_name"], r["code"], r["category"]) for r in got) == [("Ethanol", "H225", "2"), ("Sulfuric Acid 98", "H314", "1A"), ("Sulfuric Acid 98", "H315", "2")]


# sheets

SHEET = """Section 1: Identification of it
Product name: Caustic soda 50%
with more

SECTION 3 - Composition, ingredients
Etanol 64-17-5 60-70%
Água 7732-18-5 30 – 40 %
SEÇÃO 14: Informações de transporte
UN 1824 classe de risco: 8 grupo de embalagem: II
2. Hazards and so on for all
Danger, H314 + H290 and P280
4: First aid for everyone here
wash at once with much water
10 - Stability of the material
incompatible with strong acids, metals
"""


def test_sections():
    got = sheets.split_sections(SHEET)
    assert sorted(got) == [1, 2, 3, 4, 10, 14] and got[3].splitlines() == ["Etanol 64-17-5 60-70%", "Água 7732-18-5 30 – 40 %"]
    assert sheets.split_sections(None) == {} == sheets.split_sections("nothing here")
    assert sheets.split_sections("Product identification\nx\nfirst aid\ny\nz") == {1: "Product identification\nx", 4: "first aid\ny\nz"}
    assert 17 not in sheets.split_sections("SECTION 17: Too far along\n" + "x" * 40)


def test_fields_of_a_sheet(spark):
    rows = [(1, "x CAS 1310-73-2", {14: "UN 1824 classe de risco: 8 grupo de embalagem: II"}), (2, None, None), (3, "UN 9999 classe 12.5 grupo embalagem 3 H225 pH: 7-9", None), (4, SHEET, sheets.split_sections(SHEET))]
    got = {(r["document_id"], r["field_name"]): r for r in fields.extract_fields(spark.createDataFrame(rows, "document_id int, text string, sections map<int,string>")).collect()}
    value = {k: r["value"] for k, r in got.items()}
    assert {f: v for (d, f), v in value.items() if d == 1} == {"cas_number": "1310-73-2", "un_number": "1824", "hazard_class": "8", "packing_group": "II"}
    assert got[1, "cas_number"]["confidence"] == 0.8 and got[1, "cas_number"]["context"] == "x CAS 1310-73-2" and abs(got[1, "hazard_class"]["confidence"] - 0.58) < 1e-9
    assert {f: v for (d, f), v in value.items() if d == 3} == {"hazard_class": "1", "packing_group": "III", "h_statements": "H225", "ph": "7-9"}
    assert value[4, "h_statements"] == "H314 + H290" and value[4, "signal_word"] == "Danger" and value[4, "cas_number"] == "64-17-5" and value[4, "incompatibilities"] == "strong acids, metals"
    assert not [k for k in got if k[0] == 2]


def test_every_pattern_means_what_it_does_in_python(spark):
    texts = ["nome comercial: Ácido 98%\nx", "Razão social - Química S.A. do Sul", "Fabricante: LTDA", "ONU#1824", "1203 e mais\nclasse", "1203 da classe", "GHS01; ghs05 GHS10", "ATENÇÃO", "OSHA PEL: 10 ppm", "PEL: 5.5 mg/m³", "TLV 3 ppb", "REL-7mg/m3",
             "IDLH: .5 ppm", "Ponto de fulgor: -18 °F", "boiling point 100C", "freezing point: 0.°C", "pH 7 ~ 8.", "estado físico: PÓ", "form liquid", "Oral (rat) LD50: 2,000 mg/kg", "dérmica x\nLD50 3 mg/kg", "inhalation LC50 5 mg/l",
             "TSCA: not listed", "SARA 313 sim", "California Proposition 65: warning", "incompatíveis com: ácidos fortes e bases", "não misturar com água sanitária", "Grupo embalagem: iii", "H225 +H300+ h301", "p280", "x 64-17-5 y 1-1-1"]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "id int, text string, sections map<int,string>")
    got = {(r["id"], r["field_name"]): r["value"] for r in fields.extract_fields(df).collect()}
    expect = {}
    for k, t in enumerate(texts):
        for name, _, flags, pattern in fields.FIELDS:
            m = pattern and re.search(pattern, t, re.IGNORECASE if "i" in flags else 0)
            found = m and next((g.strip() for g in m.groups() if g), "")
            if found and name == "un_number":
                found = found if 4 <= int(found) <= 3550 else ""
            if found and name == "packing_group":
                found = {"1": "I", "2": "II", "3": "III"}.get(found.upper(), found.upper())
            if found:
                expect[k, name] = found
    assert got == expect and len({n for _, n in got}) >= 24


def test_ingredients(spark):
    text = "Etanol 64-17-5 60-70%\nÁgua 7732-18-5 30 – 40 %\nshort\nCAS 64-17-5\nwrong 64-17-6 1%\nEthanol 64–17–S >= 99%"
    rows = [(1, "ignored 67-64-1", {3: text}), (2, "Acetone | 67-64-1 | < 5,5 %", None), (3, None, None), (4, "", {})]
    got = sorted(sheets.ingredients(spark.createDataFrame(rows, "document_id int, text string, sections map<int,string>")).collect())
    brief = [(r["document_id"], r["cas_number"], r["chemical_name"], r["concentration_min"], r["concentration_max"], round(r["confidence"], 2)) for r in got]
    assert brief == [(1, "64-17-5", "Etanol", 60.0, 70.0, 0.85), (1, "7732-18-5", "Água", 30.0, 40.0, 0.85), (2, "67-64-1", "Acetone", None, 5.5, 0.85)]
    assert [x["cas_number"] for x in sheets.parse_ingredients("Ethanol 64–17–S >= 99%")] == ["64-17-5"] and sheets.check_digit("64-17-5") and not sheets.check_digit("64-17-6")
    assert sheets.concentration("10 to 5 %")[1:3] == (5.0, 10.0) and sheets.concentration("none")[0] is None
    again = sheets.best_ingredients(spark.createDataFrame([(1, "a", 0.5, 2), (1, "a", 0.7, 3), (1, "a", 0.7, 1), (2, "a", 0.1, 1)], "document_id int, cas_number string, confidence double, line_no int"))
    assert sorted(tuple(r) for r in again.collect()) == [(1, "a", 0.7, 1), (2, "a", 0.1, 1)]


# names and codes


def test_product_names(spark):
    cases = [("H2SO4", "Ácido Sulfúrico"), ("hcl", "hcl"), ("Ácido Sulfúrico 98%", "Ácido Sulfúrico 98%"), ("Acid 98%x", "Acid"), ("ACME  Ethanol   pure brand", "Ethanol pure"), ("Zinc 99 % Pure", "Zinc"), ("ACME BRAND", "ACME BRAND"), (None, ""), ("ab", "ab")]
    assert [r["n"] for r in one(spark, cases, "v string, e string", n=names.product_name(F.col("v")))] == [e for _, e in cases]


def test_hazard_names_and_codes(spark):
    cases = [("Flam. Liq", ["Flammable Liquid"]), ('["carc", "x-ray\'s"]', ["Carcinogenicity", "X-Ray'S"]), ('{"toxic": true, "oxidizer": false}', ["Toxic"]), ("", []), ("very toxic stuff", ["Toxic"]), ("e", ["Acute Toxicity"])]
    assert [r["n"] for r in one(spark, cases, "v string, e array<string>", n=names.hazard_names(F.col("v")))] == [e for _, e in cases]
    r = spark.createDataFrame([("P099 P100 P510 P511 xP280y H225", "H225, H300")], "a string, b string").select(names.statement_codes(F.col("a"), "P").alias("p"), names.missing_codes(F.array(F.lit("H225"), F.lit("H999")), F.col("b")).alias("m")).first()
    assert r["p"] == ["P100", "P280", "P510"] and r["m"] == ["H999"]
    cases = [("C2H6O", 46.0), ("46.07", 46.07), ("20000", None), ("NaCl", 58.5), ("Xy", None), (None, None), ("0", None)]
    assert [r["w"] for r in one(spark, cases, "v string, e double", w=names.molecular_weight(F.col("v")))] == [e for _, e in cases]


def test_classes_numbers_and_groups(spark):
    cases = [("2", False), ("2.1", True), ("9", False), ("8", True), (None, False), ("", False), ("1.6", True)]
    assert [r["d"] for r in one(spark, cases, "v string, e boolean", d=fields.is_dangerous(F.col("v")))] == [e for _, e in cases]
    cases = [("UN 0004", "0004"), ("3551", None), ("12345", None), ("3550", "3550"), ("0003", None)]
    assert [r["u"] for r in one(spark, cases, "v string, e string", u=fields.un_number(F.col("v")))] == [e for _, e in cases]


def test_answers(spark):
    cases = [('{"value": "x", "confidence": 0.9, "method": "m"}', ("x", 0.9, "m")), ('{"text": "t"}', ("t", 0.7, "llm")), ('{"result": 5}', ("5", 0.7, "llm")), ("{bad", ("{bad", 0.7, "llm")), (" plain ", ("plain", 0.7, "llm")), ('{"k": 1}', ('{"k": 1}', 0.7, "llm")), ("", ("", 0.7, "llm"))]
    assert [tuple(r["a"]) for r in one(spark, [(c,) for c, _ in cases], "v string", a=normal_answer(F.col("v")))] == [e for _, e in cases]
    assert one(spark, [(None,)], "v string", a=normal_answer(F.col("v")))[0]["a"] is None


def test_terms_and_file_names(spark):
    cases = [("Gefahr und HERSTELLER", "de", "Hazard und MANUFACTURER"), ("Gefahr", "xx", "Gefahr"), ("número cas", "es", "cas number"), (None, "de", None), ("perigo", None, "perigo")]
    assert [r["t"] for r in one(spark, cases, "v string, l string, e string", t=names.translate_terms(F.col("v"), F.col("l")))] == [e for *_, e in cases]
    cases = [("Guia.pdf", "pt"), ("script.txt", "pt"), ("Safety_Guide.pdf", "en"), ("x.pdf", "en"), ("Chart", "en")]
    assert [r["l"] for r in one(spark, cases, "v string, e string", l=names.file_language(F.col("v")))] == [e for _, e in cases]


# chunks


def test_chunks_keep_the_text_and_its_bounds(spark):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longer-word ", "x", ". ", "\n", "\n\n", "y" * 30]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.choice([(40, 10), (25, 0), (60, 30)])
        got, at = chunks.split_text(text, size, overlap), 0
        for c in got:
            assert 0 < len(c) <= size and c == c.strip()
            at = text.index(c, max(0, at - overlap - 2)) + len(c)
        assert overlap or "".join("".join(got).split()) == "".join(text.split())
    assert chunks.split_text("aaa bbb ccc ddd", 7, 3) == ["aaa bbb", "ccc", "ddd"] and chunks.split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    assert chunks.split_text("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"] and chunks.split_text("p one\n\np two is long", 8, 0) == ["p one", "p two", "is long"]
    docs = spark.createDataFrame([(1, "aaa bbb ccc", 9), (2, None, 9), (3, " ", 9)], "id int, text string, chunk_index int")
    assert [tuple(r) for r in chunks.chunk_documents(docs, 8, 4).collect()] == [(1, "aaa bbb", 0, 2), (1, "bbb ccc", 1, 2)]
    with pytest.raises(ValueError, match="overlap"):
        chunks.chunk_documents(docs, 5, 6)


# walks


def test_walks_match_plain_python(spark):
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(22)})
    edges, starts = spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(0,), (1,)], "start int")
    near = {s: {b for a, b in pairs if a == s} for s in range(9)}
    reach, least, paths = set(), set(), set()
    for s in (0, 1):
        front, seen = {s}, {s}
        for d in (1, 2, 3):
            front = set().union(*(near[x] for x in front)) if front else set()
            reach |= {(s, x, d) for x in front}
            least |= {(s, x, d) for x in front - seen}
            seen |= front
        todo = [(s,)]
        while todo:
            p = todo.pop()
            grown = [(*p, x) for x in near[p[-1]] if x not in p]
            paths |= {(s, g) for g in grown}
            todo += [g for g in grown if len(g) < 4]
    assert {tuple(r) for r in walks.closure(edges, starts, 3).collect()} == reach
    assert {tuple(r) for r in walks.nearest(edges, starts, 3).collect()} == least
    got = [(r["start"], tuple(r["path"])) for r in walks.simple_paths(edges, starts, 3).collect()]
    assert set(got) == paths and len(got) == len(paths)
    inside = {0} | near[0]
    assert {tuple(r) for r in walks.neighbourhood(edges, starts, 1).filter("start = 0").collect()} == {(0, a, b) for a, b in pairs if a in inside and b in inside}


def test_tanimoto_pairs_match_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.sample(range(30), 9) for _ in range(6)]
    prints = [(k, [x if rng.random() > 0.12 else rng.randrange(30) for x in rng.choice(base)]) for k in range(60)] + [(100, []), (101, None), (102, [1, 1, 2]), (103, [2, 1])]
    for t in (0.5, 0.7, 1.0):
        got = {(r["a"], r["b"]): r["similarity"] for r in walks.tanimoto_pairs(spark.createDataFrame(prints, "id int, bits array<int>"), t).collect()}
        sets = {k: set(v) for k, v in prints if v}
        expect = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
        assert got == {k: v for k, v in expect.items() if v >= t}


def test_communities_of_two_groups(spark):
    edges = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(4, 10, 0.1)]
    got = {r["node"]: r["community"] for r in walks.communities(spark.createDataFrame(edges, "src int, dst int, weight double")).collect()}
    assert {got[k] for k in range(5)} == {0} and {got[k] for k in range(10, 15)} == {10}
    assert walks.communities(spark.createDataFrame([], "src int, dst int, weight double")).count() == 0


def test_hybrid_contexts(spark):
    edges = spark.createDataFrame([("64-17-5", "1-1"), ("1-1", "2-2"), ("2-2", "3-3")], "src string, dst string")
    asked = spark.createDataFrame([(1, "Is 64-17-5 safe with 7732-18-5?", [1.0, 0.0]), (2, "what?", [0.0, 1.0])], "id int, question string, embedding array<float>")
    docs = spark.createDataFrame([("a" * 600, [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5, 0.5])], "content string, embedding array<float>")
    got = {r["id"]: r for r in walks.hybrid_contexts(asked, edges, docs, top_k=2).collect()}
    assert got[1]["cas"] == ["64-17-5", "7732-18-5"] and got[1]["n_incompatible"] == 2 and "CAS 64-17-5 has 2 incompatibilities" in got[1]["context"]
    assert got[1]["context"].index("a" * 500) < got[1]["context"].index("### Document 2\nc") and "a" * 501 not in got[1]["context"]
    assert got[2]["context"].startswith("\n## Vector Context") and got[2]["n_incompatible"] == 0
    assert spark.range(1).select(walks.prompt(F.lit("c"), F.lit("q"))).first()[0] == "Context:\nc\n\nQuestion: q\n\nAnswer:"


# files


def _docx(path):
    body = "<w:p><w:r><w:t>first </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>second</w:t></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def _xlsx(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row/><row><c t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain\ntext")
    (tmp_path / "sub" / "b.MD").write_text("# head")
    (tmp_path / "c.html").write_text("<p>one &amp; <b>two</b></p><script>no()</script><style>p{}</style>three")
    (tmp_path / "d.csv").write_text('k,v\na,1\n"b, c",\n')
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(b"no zip")
    (tmp_path / "h.txt").write_bytes(b"\xff\xfe\xff")
    _docx(tmp_path / "g.docx")
    _xlsx(tmp_path / "i.xlsx")
    got = {(r["title"], r["type"]): r for r in files.read_documents(spark, str(tmp_path)).collect()}
    texts = {k: r["text"] for k, r in got.items()}
    assert texts == {("a", "text"): "plain\ntext", ("b", "markdown"): "# head", ("c", "html"): "one &\ntwo\nthree", ("d", "csv"): "k: a | v: 1\nk: b, c", ("g", "docx"): "first line\nsecond", ("i", "excel"): "name | 2\nx"}
    assert got["d", "csv"]["rows"] == 2 and (got["i", "excel"]["sheet"], got["i", "excel"]["sheet_number"]) == ("One", 1)
    assert sorted(r["source"].rsplit("/", 1)[1] for r in files.read_documents(spark, str(tmp_path), errors=True).collect()) == ["f.docx", "h.txt"]
    assert files.read_file(spark, str(tmp_path / "a.txt")).count() == 1
    for bad in ("e.pdf", "f.docx"):
        with pytest.raises(ValueError, match="pdf|docx"):
            files.read_file(spark, str(tmp_path / bad))


def test_classification_lists(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"cas_number": "64-17-5", "hazards": [{"code": "H225", "category": "2", "class": "Flam", "statement": "s"}, {"code": "H319"}]}, {"hazards": [{"code": "H1"}]}]))
    (tmp_path / "p.json").write_text(json.dumps([{"props": [{"urn": {"label": "x"}}, {"urn": {"label": "CAS"}, "value": {"sval": "64-17-5"}}], "sections": [{"heading": "GHS Classification", "information": [{"code": "H225"}, {"code": "P1"}, {}]}, {"heading": "other", "information": [{"code": "H300"}]}]}, {"props": []}]))
    echa, pubchem = files.read_echa(spark, str(tmp_path / "e.json")), files.read_pubchem(spark, str(tmp_path / "p.json"))
    both = files.merge_classifications(echa, pubchem, echa).collect()
    assert sorted((r["cas_number"], r["hazard_code"], r["source"], r["confidence"]) for r in both) == [("64-17-5", "H225", "ECHA", 0.95), ("64-17-5", "H225", "PubChem", 0.85), ("64-17-5", "H319", "ECHA", 0.95)]


def test_reports_and_backups(spark, tmp_path):
    from datetime import datetime

    cells = spark.createDataFrame([("a", "b", "Self"), ("a", "a", "<x>"), ("b", "a", 'say "no", twice')], "r string, c string, v string")
    table = exports.pivot_matrix(cells, "r", "c", "v", ["a", "b"])
    assert [tuple(r) for r in table.collect()] == [("a", "<x>", "Self"), ("b", 'say "no", twice', "Unknown")]
    paths = exports.export_report({"matrix": table}, spark.createDataFrame([(1, None)], "n int, m int"), str(tmp_path), "all", datetime(2024, 1, 2, 3, 4, 5))
    assert paths["matrix_csv"].endswith("matrix_20240102_030405.csv") and sorted(paths) == ["json", "matrix_csv", "matrix_excel", "matrix_html"]
    assert [tuple(r) for r in spark.read.option("header", "true").option("escape", '"').csv(paths["matrix_csv"]).orderBy("r").collect()] == [tuple(r) for r in table.collect()]
    page = spark.read.text(paths["matrix_html"], wholetext=True).first()[0]
    assert "<td>&lt;x&gt;</td>" in page and spark.read.text(paths["json"]).first()[0] == '{"n":1,"m":null}'
    with pytest.raises(ValueError, match="kind"):
        exports.export_report({}, table, str(tmp_path), "pdf")
    tables = {"rules": spark.createDataFrame([("b", "c", "I"), ("a", "b", "R")], "cas_a string, cas_b string, rule string"), "hazards": spark.createDataFrame([("a", {"toxic": True})], "cas string, hazard_flags map<string,boolean>"), "documents": spark.createDataFrame([(2,), (1,)], "id int")}
    done = {r["name"]: r for r in exports.backup(tables, str(tmp_path / "b"), "v1").collect()}
    assert {k: r["rows"] for k, r in done.items()} == {"rules": 2, "hazards": 1, "documents": 2}
    for name, t in tables.items():
        assert sorted(exports.read_backup(spark, str(tmp_path / "b"), "v1", name, t.schema).collect(), key=str) == sorted(t.collect(), key=str)
    with pytest.raises(ValueError, match="documents"):
        exports.backup({k: v for k, v in tables.items() if k != "documents"}, str(tmp_path / "c"), "v1")
    assert not (tmp_path / "c").exists()


def test_harvest_records_and_state(spark):
    import hashlib

    got = exports.harvest_records(spark.createDataFrame([("x", bytearray(b"abc"), None), ("y", None, "404")], "path string, content binary, error string"), "s").collect()
    assert [tuple(r) for r in got] == [("s", "x", "downloaded", hashlib.sha256(b"abc").hexdigest(), 3, None), ("s", "y", "failed", None, None, "404")]
    kind = "key string, value string, updated_at int"
    state = exports.put_state(spark.createDataFrame([("a", "1", 5), ("b", "2", 9)], kind), spark.createDataFrame([("a", "3", 1), ("a", "4", 2), ("c", "5", 1)], kind))
    assert sorted(tuple(r) for r in state.collect()) == [("a", "4", 2), ("b", "2", 9), ("c", "5", 1)]


# sources, streams, logs


def test_lines_with_known_files_and_pages(spark, tmp_path):
    from safesheet.sources import jsonl

    rule = json.dumps({"cas_a": "1", "cas_b": "2", "rule": "I"})
    (tmp_path / "a.jsonl").write_text(f"{rule}\n{{oops\n{rule}\n" + json.dumps({"cas_a": "1", "cas_b": "2", "rule": "R", "content_hash": "h"}) + "\n" + json.dumps({"cas_a": "9", "cas_b": "2", "rule": "R", "content_hash": "h"}) + "\n" + json.dumps({"cas_a": "1", "rule": "I"}))
    outcomes = lambda df: {r["outcome"]: r["count"] for r in df.groupBy("outcome").count().collect()}
    path = str(tmp_path / "a.jsonl")
    assert outcomes(jsonl.read_rules(spark, path)) == {"processed": 2, "invalid_json": 1, "duplicate_hash": 2, "missing_fields": 1}
    known = jsonl.snapshots(spark, path)
    assert outcomes(jsonl.read_rules(spark, path, known)) == {"snapshot_exists": 1} and outcomes(jsonl.read_rules(spark, path, known.limit(0))) == outcomes(jsonl.read_rules(spark, path))
    pages = [{"url": "https://a.Example.com/x", "raw_text": "t"}, {"source": "evil-example.com/x", "content": "c"}, {"url": "example.com", "title": "n", "raw_text": "", "content": "d"}, {"url": "http://b.org"}, {"content": "no url"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, pages)) + "\n[")
    got = sorted((str(r["url"]), str(r["text"]), r["outcome"]) for r in jsonl.read_pages(spark, str(tmp_path / "p.jsonl"), ["example.com"]).collect())
    assert got == sorted([("https://a.Example.com/x", "t", "processed"), ("evil-example.com/x", "c", "not_whitelisted"), ("example.com", "d", "processed"), ("None", "no url", "processed"), ("None", "None", "invalid_json")])


def test_files_are_taken_once(spark, tmp_path):
    from safesheet.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.txt").write_text("two")
    work, checkpoint = ingest.append_once(str(tmp_path / "out")), str(tmp_path / "state")
    for expect, extra in ((["a.txt", "b.txt"], None), (["a.txt", "b.txt", "c.txt"], ("c.txt", "three")), (["a.txt", "b.txt", "c.txt"], ("d.txt", "one"))):
        if extra:
            (tmp_path / "in" / extra[0]).write_text(extra[1])
        q = ingest.run(ingest.new_files(spark, str(tmp_path / "in")), work, checkpoint)
        assert q.awaitTermination(180)
        assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expect
    batch = spark.createDataFrame([("x",)], "path string")
    work(batch, 99)
    work(batch, 99)
    assert spark.read.parquet(str(tmp_path / "out" / "batch=99")).count() == 1


def test_logs_and_durations(spark):
    from safesheet.functions import logs

    lines = ["Processing letter 'B'", "Processing letter 'A'", "Processing letter 'A'", "Found 443 unique chemicals for letter 'A'", "Found x chemicals for letter 'B'", "Ingested: a (1, 3 chunks)", "Ingested: b", "Failed to scrape c", ""]
    got = logs.log_stats(spark.createDataFrame([(x,) for x in lines], "line string")).first()
    assert tuple(got) == (443, 1, 1, ["A", "B"])
    cases = [(0, 10, 5, "unknown"), (5, 10, 10, "10s"), (1, 100, 60, "1h 39m"), (1, 10, 60, "9m"), (3, 10, 0, "0s")]
    df = spark.createDataFrame(cases, "p int, t int, e int, x string")
    assert [r["d"] for r in df.select(logs.time_left(F.col("p"), F.col("t"), F.col("e")).alias("d")).collect()] == [x for *_, x in cases]
    assert spark.range(1).select(logs.progress(F.lit(1), F.lit(4), 8)).first()[0] == "██░░░░░░ 25.0%" and spark.range(1).select(logs.progress(F.lit(1), F.lit(0))).first()[0] == "N/A"
    ranks = logs.ranked_results(spark.createDataFrame([(1, [7, 8], [0, 3], 0.5), (2, [], [], None), (3, [9], [1, 2], 0.1)], "query_id int, document_ids array<int>, chunks array<int>, top_score double"))
    assert sorted(tuple(r) for r in ranks.collect()) == [(1, 7, 0, 0.5, 1), (1, 8, 3, None, 2), (3, 9, 1, 0.1, 1)]


# tables


def test_changes_of_tables(spark):
    from safesheet.functions import tables

    kind = "id int, f string, v string"
    target = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, "a", "n")], kind)
    changes = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (2, "a", "z", 1), (None, "a", "m", 1)], kind + ", seq int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(tables.upsert(target, changes, ["id", "f"], ["seq"])) == sorted([(1, "a", "y"), (1, "b", "old"), (2, "a", "z"), (None, "a", "m")], key=str)
    assert rows(tables.insert_ignore(target.filter("id = 1"), changes, ["id", "f"], ["seq"])) == sorted([(1, "a", "old"), (1, "b", "old"), (2, "a", "z"), (None, "a", "m")], key=str)
    assert rows(tables.replace_children(target, spark.createDataFrame([(1, "c", "new")], kind), "id")) == sorted([(1, "c", "new"), (None, "a", "n")], key=str)
    rules = spark.createDataFrame([(" b", "a ", "i", 1), ("a", "b", " r", 3), ("a", "b", "c", 2), ("c", "a", "r", 1)], "cas_a string, cas_b string, rule string, seq int")
    assert rows(tables.normal_rules(rules, "seq")) == [("a", "b", "R"), ("a", "c", "R")]


def test_validation_and_consensus(spark):
    from safesheet.functions import tables

    cases = [("cas_number", "64-17-5", 0.95, "valid"), ("cas_number", "x", 0.95, "warning"), ("cas_number", "x", 0.5, "invalid"), ("un_number", "not_found", 0.99, "invalid"), ("un_number", "12", 0.8, "warning"), ("hazard_class", "2", 0.9, "valid"), ("hazard_class", "7.1", 0.9, "warning"),
             ("packing_group", "IV", 0.9, "warning"), ("product_name", "ab", 0.9, "warning"), ("manufacturer", "A", 0.9, "warning"), ("other", None, 0.9, "invalid"), ("other", "", 0.9, "invalid"), ("other", "v", 0.7, "warning")]
    df = spark.createDataFrame(cases, "f string, v string, c double, e string")
    assert [r["s"] for r in df.select(tables.validate(F.col("f"), F.col("v"), F.col("c")).alias("s")).collect()] == [e for *_, e in cases]
    answers = [(1, "m1", "x", 0.8), (1, "m2", "x", 0.9), (2, "m1", "x", 0.8), (2, "m2", "y", 0.9), (3, "m1", "NOT_FOUND", 0.9), (4, "m1", "z", 0.5), (4, "m2", "ERROR", 0.9), (5, "m1", "q", 0.95), (5, "m2", "q", 0.95), (6, "m2", "b", 0.5), (6, "m1", "a", 0.5)]
    got = {r["k"]: (r["value"], round(r["confidence"], 6), r["source"]) for r in tables.consensus(spark.createDataFrame(answers, "k int, model string, value string, confidence double"), ["k"]).collect()}
    assert got == {1: ("x", 1.0, "consensus"), 2: ("y", 0.855, "best-effort"), 3: ("NOT_FOUND", 0.0, None), 4: ("z", 0.475, "best-effort"), 5: ("q", 1.0, "consensus"), 6: ("a", 0.475, "best-effort")}


def test_names_and_class_pairs(spark):
    from safesheet.functions import tables

    products = spark.createDataFrame([("2-2", "Pure Ethanol"), ("1-1", "ethanol 70"), ("3-3", "Acetone"), (None, "water"), ("4-4", None)], "cas string, product_name string")
    asked = spark.createDataFrame([("Alcohol",), (" ETHANOL",), ("ace",), ("acetone",), ("water",), ("alcohol 2",)], "name string")
    got = {r["name"]: r["cas"] for r in tables.match_names(asked, products, {"alcohol": "ethanol", "acetone": "none such"}).collect()}
    assert got == {"Alcohol": "1-1", " ETHANOL": "1-1", "ace": None, "acetone": "3-3", "water": None, "alcohol 2": None}
    chemicals = spark.createDataFrame([("a", "1"), ("b", "5"), ("c", "5"), ("a", "3")], "cas string, hazard_class string")
    rules = spark.createDataFrame([("1", "5", "r1", 1), ("5", "3", "r2", 2), ("5", "5", "r3", 3)], "class_a string, class_b string, rule string, priority int")
    assert sorted(tuple(r) for r in tables.class_pairs(chemicals, rules).collect()) == [("a", "b", "r1"), ("a", "c", "r1"), ("b", "c", "r3")]


# indexes and joins by substrings


def test_vector_index_recall_and_exact_search(spark, tmp_path):
    import numpy as np

    from safesheet.functions import vectors

    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows += [(10_000 + k, rows[5][1], 1) for k in range(7)] + [(None, None, 1), (20_000, [], 1), (20_001, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    asked = df.filter("id % 100 = 0 and id < 10000").select(df["id"].alias("query_id"), "embedding")
    data = [r for r in rows if r[1] and None not in r[1]]
    m = np.array([r[1] for r in data])
    centroids = vectors.fit_centroids(df, sample=500)
    indexed = vectors.index(df, centroids, str(tmp_path / "ix"))
    assert indexed.count() == len(data) and len(centroids) == 22

    def brute(label=None, k=5):
        use = [j for j, r in enumerate(data) if label is None or r[2] == label]
        out = {}
        for j, r in enumerate(data):
            if r[0] % 100 == 0 and r[0] < 10_000:
                s = m[use] @ m[j]
                out[r[0]] = [data[use[i]][0] for i in sorted(range(len(use)), key=lambda i: (-round(s[i], 9), data[use[i]][0]))[:k]]
        return out

    def found(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    want = brute()
    probes = vectors.probes_needed(df, centroids, 5)
    assert 1 < probes < len(centroids)
    got = found(vectors.search(indexed, asked, centroids, 5, probes))
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9, recall
    assert found(vectors.search(indexed, asked, centroids, 5, probes=len(centroids))) == want
    assert found(vectors.search(indexed.filter("label = 3"), asked, centroids, 5, probes=len(centroids))) == brute(3)


def test_vector_index_of_blocks_and_empty_tables(spark, tmp_path, monkeypatch):
    from safesheet.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK", 10)
    df = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(90)], "id int, embedding array<double>")
    centroids = vectors.fit_centroids(df, 1)
    indexed = vectors.index(df, centroids, str(tmp_path / "a"))
    assert indexed.select("block").distinct().count() == 9
    got = vectors.search(indexed, df.filter("id = 2").selectExpr("id as query_id", "embedding"), centroids, 4, 1).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(2, 5.0), (5, 5.0), (8, 5.0), (11, 5.0)]
    assert vectors.fit_centroids(df.limit(0)).size == 0
    assert vectors.search(indexed, df.limit(0).selectExpr("id as query_id", "embedding"), centroids, 5, 1).count() == 0


def test_substring_join_equals_all_pairs(spark):
    from safesheet.functions import substrings

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc d\n") for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["Ätna 漢字🙂x", None, "", "a"]
    needles = [t[a : a + rng.randint(1, 9)] for t in texts if t for a in (rng.randrange(len(t)),)] + ["zzzz", "zz", "", None, "漢字🙂x", "🙂"]
    want = {(n, t) for n in needles for t in texts if n and t and n in t}
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")
    for size in (1, 3, 4):
        got = [tuple(r) for r in substrings.contained(n, t, size).collect()]
        assert set(got) == want and len(got) == len(want)
    long = n.filter("length(needle) > 4")
    plan = substrings.contained(long, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert {tuple(r) for r in substrings.contained(long, t).collect()} == {x for x in want if len(x[0]) > 4}


def test_named_pairs_equal_all_pairs(spark):
    from safesheet.functions import matrix, substrings

    rows = [(1, "Acid Red", "water, BASE"), (2, "base of water", None), (3, "Water", "acid"), (4, None, "red"), (5, "reddish", "", ), (6, "base", "base")]
    df = spark.createDataFrame(rows, "id int, name string, incompatibilities string")
    got = {tuple(r) for r in substrings.named_pairs(df, matrix.tokens(F.col("incompatibilities"))).collect()}
    parts = {i: [p.strip().lower() for p in (x or "").split(",") if p.strip()] for i, _, x in rows}
    assert got == {(a, b) for a, _, _ in rows for b, name, _ in rows if a != b and name and any(p in name.lower() for p in parts[a])}


def test_classes_of_equal_fingerprints_make_no_pairs(spark):
    prints = spark.createDataFrame([(k, [k % 6, 10 + k % 6, 20, 21, 22]) for k in range(60)], "id int, bits array<int>")
    classes = walks.fingerprint_classes(prints)
    assert sorted((r["id"], r["class"]) for r in classes.collect()) == [(k, k % 6) for k in range(60)]
    assert walks.similar_classes(classes, 0.7).count() == 0 and walks.similar_classes(classes, 0.4).count() == 15
    assert walks.tanimoto_pairs(prints, 0.7).count() == 6 * 45


# sources and streams


def test_marked_stream_loses_and_doubles_nothing(spark, tmp_path):
    import datetime

    from safesheet.streaming import table_source

    table_source.register(spark)
    base = datetime.datetime(2024, 1, 1)
    times = [base + datetime.timedelta(minutes=m) for m in (0, 0, 0, 1, 1, 2, 2, 2, 2, 2, 3)]
    rows = [(k, t, f"t{k}") for k, t in enumerate(times)]
    src, out, checkpoint = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")

    def add(rows, **kw):
        spark.createDataFrame(rows, "id long, indexed_at timestamp, text string").repartition(3).write.mode("append").parquet(src)

    def run():
        from safesheet.streaming import ingest

        stream = spark.readStream.format("marked_table").option("path", src).option("limit", 3).load()
        q = stream.writeStream.foreachBatch(ingest.append_once(out)).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    add(rows + [(None, base, "no id"), (50, None, "no time")])
    run()
    got = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in got) == list(range(11))
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch"], []).append((r["indexed_at"], r["id"]))
    assert all(len(v) <= 3 for v in sizes.values())
    ordered = [x for b in sorted(sizes) for x in sorted(sizes[b])]
    assert ordered == sorted(ordered)
    add([(k, base + datetime.timedelta(minutes=4), "late") for k in range(20, 27)])
    run()  # a new start from the checkpoint
    got = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [*range(11), *range(20, 27)]


def test_rows_of_equal_times_are_parted_by_id(spark):
    from safesheet.streaming import ingest

    rows = spark.createDataFrame([(k, t) for k, t in enumerate([10, 20, 20, 20, 30, 30])] + [(None, 30), (9, None)], "id int, indexed_at int")
    mark, taken = None, []
    for _ in range(5):
        part, last = ingest.since(rows, mark, 2)
        taken.append([r["id"] for r in part.collect()])
        mark = tuple(last.first() or mark)
    assert taken == [[0, 1], [2, 3], [4, 5], [], []] and mark == (30, 5)


def test_known_files_with_odd_names(spark, tmp_path):
    for name in ("a b.jsonl", "c%20d.jsonl", "e#f.jsonl", "g.jsonl"):
        (tmp_path / name).write_text(json.dumps({"cas": name}) + "\n")
    known = jsonl_source.snapshots(spark, str(tmp_path / "a b.jsonl")).unionByName(jsonl_source.snapshots(spark, str(tmp_path / "c%20d.jsonl")))
    got = sorted((r["cas"] or "", r["outcome"]) for r in jsonl_source.read_hazards(spark, str(tmp_path), known).collect())
    assert got == [("", "snapshot_exists"), ("", "snapshot_exists"), ("e#f.jsonl", "processed"), ("g.jsonl", "processed")]


def test_csv_files_with_heads_of_their_own(spark, tmp_path):
    (tmp_path / "a.Csv").write_text('k,v\na,1\n\n"b, ""c""\nd",\n,\nx,y,z\n')
    (tmp_path / "b.csv").write_text("one\n1\n2\n")
    (tmp_path / "c.csv").write_text("p,q,r\n")
    (tmp_path / "d e.TxT").write_text("text")
    got = {r["title"]: (r["text"], r["rows"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ('k: a | v: 1\nk: b, "c"\nd\nk: x | v: y', 3), "b": ("one: 1\none: 2", 2), "c": ("", 0), "d e": ("text", None)}
    assert files.read_file(spark, str(tmp_path / "d e.TxT")).count() == 1
    with pytest.raises(Exception, match="none.txt|no file"):
        files.read_file(spark, str(tmp_path / "none.txt"))
