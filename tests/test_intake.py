"""Pages, communities, profiles, skips and taken texts against literal cases and plain Python."""

import hashlib
import itertools
import random

import pytest

from safesheet.functions import communities, intake, profiles, walks
from safesheet.functions.chunks import split_text
from safesheet.sources import pages

PAGE = """<html><head><title>Acetone page</title><style>p {color: red}</style></head><body>
<h1>ACETONE</h1><p>CAS Number: 67-64-1<br>UN 1090</p>
Synonyms: ab, dimethyl ketone; propanone, pyroacetic acid, beta-ketopropane; a2b, methyl ketone, seventh name
<div id=x><h2>General</h2><p>A clear colorless liquid here.</p>
<h2>Fire <i>Hazard</i> &amp; more</h2>
<p>tiny</p><p>Highly flammable liquid &lt;1&gt; and vapour.<ul><li>not a sibling item of this</li></ul><div>Vapours may travel far <b>away</b></div><span>spans don't count at all</span>
<p>Third paragraph of the section</p><p>Fourth paragraph is left out</p>
<h3>Health Effects</h3><div></div>
<h4>Next</h4><p>unrelated text of the page</p></div>
<h2>Health</h2><p>Causes serious eye damage. """ + "x" * 600 + """</p>
<table><tr><td>Health: 1</td><td>flammability = 3</td><td>Instability 0</td></tr></table><script>var y = "Mutagen";</script></body></html>"""


def test_page_facts(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "no tags, but <b>toxic"), (5, "<p>one<p>two</div></p><h2>Overview</h2>bare text")]
    got = {r["page_id"]: r for r in pages.page_facts(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    r = got[1]
    assert (r["name"], r["cas"]) == ("ACETONE", "67-64-1")
    assert r["synonyms"] == ["dimethyl ketone", "propanone", "pyroacetic acid", "beta-ketopropane", "a2b"]
    assert r["fire_hazard"].split("\n") == ["Highly flammable liquid <1> and vapour.not a sibling item of this" + "Vapours may travel faraway" + "spans don't count at all", "Third paragraph of the section", "Fourth paragraph is left out"]
    assert r["health_hazard"].startswith("Causes serious eye damage. xxx") and len(r["health_hazard"]) == 500
    assert r["reactivity_hazard"] == "" == r["hazard_summary"] and r["hazards"] == ["Flammable", "Eye Damage"]
    assert r["nfpa"] == {"health": 1, "flammability": 3, "instability": 0}
    assert got[4]["hazards"] == ["Toxic"] and got[4]["name"] is None and got[2]["synonyms"] == [] and got[3]["nfpa"] == {} and got[5]["hazard_summary"] == ""


def plain_modularity(edges, labels):
    w, inside, tot = 0.0, {}, {}
    for a, b, x in edges:
        w += 2 * x
        tot[labels[a]] = tot.get(labels[a], 0) + x
        tot[labels[b]] = tot.get(labels[b], 0) + x
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0) + 2 * x
    return sum(inside.values()) / w - sum((t / w) ** 2 for t in tot.values())


def test_communities_by_modularity(spark):
    schema = "src int, dst int, weight double"
    cliques = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(4, 10, 1.0)]
    labels, q = communities.by_modularity(spark.createDataFrame(cliques, schema))
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert len(got) == 10 and len({got[k] for k in range(5)}) == 1 and len({got[k] for k in range(10, 15)}) == 1 and got[0] != got[10]
    assert q == pytest.approx(plain_modularity(cliques, got)) and communities.modularity(spark.createDataFrame(cliques, schema), labels) == pytest.approx(q)
    rng = random.Random(5)
    mixed = [(a, b, rng.choice([0.5, 1.0])) for a, b in itertools.combinations(range(36), 2) if rng.random() < (0.6 if a // 9 == b // 9 else 0.06)]
    df = spark.createDataFrame(mixed, schema)
    labels, q = communities.by_modularity(df)
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert q == pytest.approx(plain_modularity(mixed, got))
    other = {r["node"]: r["community"] for r in walks.communities(df).collect()}
    assert q >= plain_modularity(mixed, other) - 1e-9 and q >= plain_modularity(mixed, {k: k // 9 for k in range(36)}) - 0.02


def test_communities_of_odd_edges(spark):
    schema = "src int, dst int, weight double"
    labels, q = communities.by_modularity(spark.createDataFrame([], schema))
    assert labels.count() == 0 and q == 0.0
    labels, q = communities.by_modularity(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0), (None, 4, 1.0), (5, 6, None), (7, 8, 0.0)], schema))
    got = {r["node"]: r["community"] for r in labels.collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] != got[3]


def test_profiles_on_samples(spark):
    samples = spark.createDataFrame([("a", "Code: 12\nName: Acetone x"), ("b", "Code: --\nrest"), ("c", None), ("d", "name: " + "y" * 250)], "file string, text string")
    patterns = {"code": r"^Code:\s*(\S+)$", "name": r"(?i)name: (.+)"}
    got = {(r["file"], r["field_name"]): (r["value"], round(r["confidence"], 6)) for r in profiles.try_patterns(samples, patterns).collect()}
    assert got["a", "code"] == ("12", 0.5) and got["b", "code"] == ("--", 0.15) and got["c", "code"] == (None, 0.0) and got["a", "name"] == ("Acetone x", 1.0) and got["d", "name"] == ("y" * 250, 0.7)
    rows = {r["field_name"]: r for r in profiles.validate_profile(samples, patterns).collect()}
    assert (rows["code"]["n"], rows["code"]["successes"], rows["code"]["status"]) == (4, 2, "poor") and rows["code"]["avg_confidence"] == pytest.approx(0.325) and rows["name"]["avg_confidence"] == pytest.approx(0.85)
    cases = spark.createDataFrame([("a", "code", "12"), ("b", "code", "x"), ("b", "name", "x"), ("z", "code", "1")], "file string, field_name string, expected string")
    assert {(r["file"], r["field_name"]): r["outcome"] for r in profiles.check_cases(samples, patterns, cases).collect()} == {("a", "code"): "match", ("b", "code"): "mismatch", ("b", "name"): "not_found", ("z", "code"): "missing"}


def test_skips_in_three_stages(spark):
    known = spark.createDataFrame(
        [(1, "/a", "a", 10, "h1", "success", 3), (2, "/b", "b", 10, "h2", "completed", 3), (3, "/c", "c", 10, "h3", "failed", 3), (4, "/d", "d", 10, "h4", "success", 0), (5, "/a2", "a", 10, "h1", "success", 1), (6, "/n", None, 1, None, "failed", 1)],
        "id int, path string, name string, size int, hash string, status string, n_extractions int",
    )
    files = spark.createDataFrame(
        [("/new/a", "a", 10, "x1", 7), ("/b", "b", 11, "x2", 7), ("/c", "c", 11, "x3", 7), ("/q", "q", 1, "h3", 7), ("/d", "d", 10, "h4", 7), ("/e2", "e", 5, "x9", 7), ("/e1", "e", 6, "x9", 7), ("/f", None, 1, None, 7), ("/g", None, 1, None, 7)],
        "path string, name string, size int, hash string, status int",
    )
    got = {r["path"]: (r["skip_reason"], r["document_id"]) for r in intake.skip_reasons(files, known).collect()}
    assert got == {"/new/a": ("same_name_and_size", 1), "/b": ("same_path", 2), "/c": (None, None), "/q": ("same_hash", 3), "/d": (None, None), "/e2": ("same_batch", None), "/e1": (None, None), "/f": (None, None), "/g": (None, None)}


def test_texts_are_taken_once_and_chunked(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    long = "\n\n".join(f"paragraph {k} " + "word " * 60 for k in range(9))
    other = "known text " * 9
    rows = [("b", "t", long), ("a", "t", long), ("c", "t", "  short  "), ("d", "t", None), ("e", "t", other), ("f", "t", "another text that is long enough to be taken")]
    texts = spark.createDataFrame(rows, "source string, title string, text string")
    documents, chunks, outcomes = intake.take_texts(texts, spark.createDataFrame([(sha(other),), (sha(other),)], "content_hash string"), 500, 50)
    assert {r["source"]: r["outcome"] for r in outcomes.collect()} == {"a": "taken", "b": "duplicate", "c": "too_short", "d": "too_short", "e": "duplicate", "f": "taken"}
    pieces = split_text(long, 500, 50)
    got = sorted((r["chunk_index"], r["total_chunks"], r["text"]) for r in chunks.collect() if r["content_hash"] == sha(long))
    assert got == [(k, len(pieces), p) for k, p in enumerate(pieces)] and len(pieces) > 3
    assert {(r["content_hash"], r["source"], r["chunk_count"]) for r in documents.collect()} == {(sha(long), "a", len(pieces)), (sha(rows[5][2]), "f", 1)}
    assert intake.take_texts(texts.limit(0), outcomes.select("content_hash"))[0].count() == 0
