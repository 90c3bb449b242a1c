"""The pipeline against plain Python, stage by stage, on a small table."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from safesheet.llm import language_id, queries
from test_operators import brute_items, brute_join, reference_encoding, public  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(21)
    kinds = {"aa": "the and ing tion ly pre".split(), "bb": "der ung ich sch keit ver".split(), "cc": "ción ado ñ os ará que".split()}
    word = lambda lang: "".join(rng.choices(kinds[lang], k=3))
    rows = []
    for k in range(240):
        lang = rng.choice(list(kinds))
        rows.append((k, " ".join(word(lang) for _ in range(60)) + ("\nread more here" if k % 4 == 0 else ""), lang, f"s{k % 2}"))
    item = " ".join(word("aa") for _ in range(30))
    rows += [(1000 + k, rows[k][1], rows[k][2], "s0") for k in range(5)]  # exact copies
    rows += [(1010 + k, rows[20 + k][1].replace(rows[20 + k][1].split()[3], "other", 1), rows[20 + k][2], "s1") for k in range(5)]  # near copies
    rows += [(1020, f"{word('aa')} {item} {word('aa')}", "aa", "s0"), (1021, None, "aa", "s0"), (1022, "", None, None), (1023, "123 456", "bb", "s1"), (7, rows[7][1], rows[7][2], rows[7][3]), (None, " ".join(word("bb") for _ in range(50)), None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "nothing like it at all in any of these texts"), (3, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_every_stage_does_what_plain_python_does(spark, folder, reference_encoding):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows[name] = [tuple(r) for r in docs.collect()]
        assert name == "bpe" or docs.columns == columns
    start = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    net = language_id.train(spark.read.parquet(f"{folder}/documents.parquet"))
    names, scores = language_id.predict(net.classes, *net.tables(), net.p["out"].astype(np.float32), net.p["bias"].astype(np.float32), [r[1] for r in start])
    expect = [r for r, n, s in zip(start, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_SCORE]
    assert Counter(rows["language_id"]) == Counter(expect) and not {1021, 1022, 1023} & {r[0] for r in expect}
    pages = Counter(r[3] for r in expect)
    held = Counter((r[3], line) for r in expect for line in {x.strip(" \t\x0b\x0c\r") for x in r[1].split("\n")} - {""})
    gone = {k for k, n in held.items() if n > 1 and n > 0.1 * pages[k[0]]}
    cut = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" \t\x0b\x0c\r")) not in gone), r[2], r[3]) for r in expect]
    expect = [(*r, len(r[1])) for r in cut]
    assert Counter(rows["line_dedup"]) == Counter(expect) and ("s0", "read more here") in gone
    classes = brute_join([(k, r[1]) for k, r in enumerate(expect)])
    groups = {}
    for k, (root, *_) in classes.items():
        groups.setdefault(root, []).append(expect[k])
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert Counter(r[0] for r in rows["ngram_join"]) == Counter(r[0] for r in kept) and set(rows["ngram_join"]) <= set(expect) and len(kept) < len(expect) - 9
    bad = {d for d, *_ in brute_items([(r[0], r[1]) for r in rows["ngram_join"]], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])}
    expect = [r for r in rows["ngram_join"] if r[0] not in bad]
    assert bad == {1020} and Counter(rows["decontamination"]) == Counter(expect)
    got = {r[0]: r for r in rows["bpe"]}
    assert Counter(r[0] for r in rows["bpe"]) == Counter(r[0] for r in expect)
    for r in expect:
        assert np.frombuffer(got[r[0]][2], dtype="<u4").tolist() == reference_encoding.encode_ordinary(r[1]) and got[r[0]][1] * 4 == len(got[r[0]][2])


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/one-{name}")
        docs = spark.read.parquet(f"{folder}/one-{name}")
    assert Counter(map(str, got.collect())) == Counter(map(str, docs.collect()))


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_runs_over_empty_tables(spark, tmp_path):
    tables = {"documents": DOCS, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_digests_of_the_last_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.tokens(spark, docs, folder).select("decoded_sha256", "ids_sha256", F.sha2("ids", 256).alias("own"))
    assert all(r["ids_sha256"] == r["own"] for r in got.collect())
    assert Counter(r["decoded_sha256"] for r in got.collect()) == Counter(r["h"] for r in docs.select(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("h")).collect())
