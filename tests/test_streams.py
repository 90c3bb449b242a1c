"""Windows, sessions, the indexing queue, sketches, workbooks and trees against plain Python."""

import datetime
import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from safesheet.functions import rollups, trees
from safesheet.sinks import exports, workbook
from safesheet.sources import files
from safesheet.streaming import metrics, queue

BASE = datetime.datetime(2024, 5, 1)
LOGS = "user_id int, ts timestamp, total_time double, result_count int"


def logs(seed, n, hours):
    rng = random.Random(seed)
    return [(rng.randrange(4), BASE + datetime.timedelta(seconds=rng.randrange(hours * 3600)), float(rng.randrange(1000)), rng.randrange(3)) for _ in range(n)]


def sessions_of(rows, gap):
    out, by = [], defaultdict(list)
    for u, t, x, _ in rows:
        by[u].append((t, x))
    for u, found in by.items():
        now = []
        for t, x in sorted(found):
            if now and t - now[-1][0] >= gap:
                out.append((u, now[0][0], now[-1][0] + gap, len(now), sum(v for _, v in now)))
                now = []
            now.append((t, x))
        out.append((u, now[0][0], now[-1][0] + gap, len(now), sum(v for _, v in now)))
    return sorted(out)


def windows_of(rows, size, step):
    out = defaultdict(list)
    for _, t, x, _ in rows:
        k = (t - BASE) // step
        for j in range(k, k - size // step, -1):
            out[BASE + j * step].append(x)
    return sorted((s, s + size, len(v), round(sum(v) / len(v), 6), max(v)) for s, v in out.items())


def test_windows_and_sessions_of_a_table(spark):
    rows = logs(1, 300, 30)
    df = spark.createDataFrame(rows, LOGS)
    hour, quarter = datetime.timedelta(hours=1), datetime.timedelta(minutes=15)
    got = sorted((r["start"], r["end"], r["n"], round(r["avg_time"], 6), r["max_time"]) for r in metrics.sliding_metrics(df).collect())
    assert got == windows_of(rows, hour, quarter)
    assert sorted(tuple(r) for r in metrics.sessions(df, "20 minutes").collect()) == sessions_of(rows, datetime.timedelta(minutes=20))
    assert metrics.sessions(df.limit(0)).count() == 0 == metrics.sliding_metrics(df.limit(0)).count()


def streamed(spark, tmp_path, batches, make):
    """Rows and late rows of a query over batches that come as files, one after the other."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, LOGS).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        late = metrics.late_rows(q)
    finally:
        q.stop()
    return [tuple(r) for r in spark.read.parquet(out).collect()], late


END = [(99, BASE + datetime.timedelta(days=9), 0.0, 0)]  # moves the watermark past all others


def test_streamed_sessions_equal_a_table_s_but_for_late_rows(spark, tmp_path):
    rows = sorted(logs(2, 120, 12), key=lambda r: r[1])
    rng = random.Random(3)
    mixed = [r for a in range(0, 120, 10) for r in rng.sample(rows[a : a + 10], 10)]  # out of order inside the watermark
    late = [(1, BASE - datetime.timedelta(days=2), 5.0, 0), (2, BASE - datetime.timedelta(days=2), 5.0, 0)]
    got, n = streamed(spark, tmp_path, [mixed[:40], mixed[40:80], mixed[80:], late, END, END], lambda s: metrics.sessions(s, "20 minutes", "3 hours"))
    assert sorted(r for r in got if r[0] != 99) == sessions_of(rows, datetime.timedelta(minutes=20)) and n == 2


def test_streamed_windows_equal_a_table_s_but_for_late_rows(spark, tmp_path):
    rows = sorted(logs(4, 120, 12), key=lambda r: r[1])
    late = [(1, BASE - datetime.timedelta(days=2), 5.0, 0)]
    got, n = streamed(spark, tmp_path, [rows[:60][::-1], rows[60:][::-1], late, END, END], lambda s: metrics.sliding_metrics(s, "1 hour", "30 minutes", "14 hours"))
    want = windows_of(rows, datetime.timedelta(hours=1), datetime.timedelta(minutes=30))
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in got) == want and n == 2  # the late row is in two windows


# the queue


def test_queue_retries_over_a_restart_and_gives_up(spark, tmp_path):
    src, index, out = tmp_path / "in", tmp_path / "index", str(tmp_path / "out")
    src.mkdir()
    index.mkdir()
    where = str(index)

    def work(key, content, attempt):
        """Fails as many times as the content says; keeps a mark of each call."""
        with open(f"{where}/{key}-{attempt}", "w") as f:
            f.write(content)
        if attempt <= int(content):
            raise RuntimeError(f"not yet {attempt}")

    queue.use_store(spark)

    def start(wait):
        stream = spark.readStream.schema("document_id string, content string").json(str(src))
        work_of = queue.indexing_queue(stream, work, most=3, wait_ms=wait)
        return work_of.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()

    def seen():
        try:
            return sorted((r["document_id"], r["outcome"], r["attempts"]) for r in spark.read.schema(queue.OUT).parquet(out).collect())
        except Exception:
            return []

    def wait_for(n):
        end = time.time() + 90
        while len(seen()) < n and time.time() < end:
            time.sleep(0.5)

    (src / "a.json").write_text("\n".join(json.dumps({"document_id": d, "content": c}) for d, c in (("fine", "0"), ("once", "1"), ("never", "9"))))
    q = start(3_600_000)  # nothing is tried again in this run
    try:
        wait_for(1)
    finally:
        q.stop()
    assert seen() == [("fine", "indexed", 1)]
    assert sorted(p.name for p in index.iterdir()) == ["fine-1", "never-1", "once-1"]
    (src / "b.json").write_text("\n".join(json.dumps({"document_id": d, "content": c}) for d, c in (("fine", "0"), ("twice", "2"), ("never", "9"))))
    q = start(100)
    try:
        wait_for(2)
    finally:
        q.stop()
    got = seen()
    assert ("fine", "indexed", 1) in got and ("twice", "indexed", 3) in got and len(got) == len({d for d, *_ in got})
    assert not (index / "fine-2").exists() and not (index / "never-4").exists()


def test_queue_ends_each_document_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"document_id": f"d{k}", "content": str(k % 4)}) for k in range(12)))

    def work(key, content, attempt):
        if attempt <= int(content):
            raise ValueError(key)

    queue.use_store(spark)
    stream = spark.readStream.schema("document_id string, content string").json(str(src))
    for _ in range(2):  # the second is a restart in between, or after the end
        q = queue.indexing_queue(stream, work, most=3, wait_ms=50).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        end = time.time() + 60
        try:
            while time.time() < end:
                time.sleep(1)
                try:
                    if spark.read.schema(queue.OUT).parquet(out).count() >= (4 if _ == 0 else 12):
                        break
                except Exception:
                    continue
        finally:
            q.stop()
    got = sorted((r["document_id"], r["outcome"], r["attempts"]) for r in spark.read.schema(queue.OUT).parquet(out).collect())
    assert got == sorted((f"d{k}", "dead_letter" if k % 4 == 3 else "indexed", min(3, k % 4 + 1)) for k in range(12))


# sketches


def test_merged_sketches_are_within_their_error(spark):
    rows = logs(5, 20_000, 48)
    rows = [(k % 7000, t, x + k / 20_000, c) for k, (_, t, x, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, LOGS)
    hours = rollups.hourly(df)
    assert hours.count() == 48
    whole = rollups.read(rollups.merged(hours)).first()
    days = rollups.merged(hours, F.date_trunc("day", "hour").alias("day"))
    again = rollups.read(rollups.merged(days)).first()
    direct = rollups.read(rollups.hourly(df.withColumn("ts", F.lit(BASE)))).first()
    values = sorted(r[2] for r in rows)
    users = len({r[0] for r in rows})
    for got in (whole, again, direct):
        assert got["n"] == len(rows) and got["n_empty"] == sum(r[3] == 0 for r in rows) and abs(got["avg_time"] - sum(values) / len(values)) < 1e-6
        assert abs(got["n_users"] - users) <= rollups.DISTINCT_ERROR * users
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            rank = sum(v <= got[name] for v in values) / len(values)
            assert abs(rank - q) <= 2 * rollups.RANK_ERROR, (name, rank)  # two levels of merging
    empty = rollups.read(rollups.hourly(spark.createDataFrame([(None, BASE, None, None)], LOGS))).first()
    assert empty["n"] == 1 and empty["p50"] is None and empty["n_users"] == 0


# workbooks


def test_workbooks_are_read_back(spark, tmp_path):
    rows = [(1, "a & <b>", True, 1.5), (2, None, False, None), (3, " x\x01\ny ", None, -2e300)]
    df = spark.createDataFrame(rows, "id int, text string, flag boolean, x double").coalesce(1)
    out = str(tmp_path / "book")
    exports.export_excel(df, out, "Matrix & more")
    got = {(r["sheet"], r["sheet_number"]): r["text"] for r in files.read_documents(spark, out).collect()}
    assert got["Summary", 2] == "sheet | rows | columns\nMatrix & more | 3 | 4"
    assert got["Matrix & more", 1] == "id | text | flag | x\n1 | a & <b> | 1 | 1.5\n2 | 0\n3 | x\ny | -2e+300"
    exports.export_excel(spark.range(10).repartition(3), out)  # takes its place
    texts = [r["text"] for r in files.read_documents(spark, out).filter("sheet = 'Data'").collect()]
    assert sorted(x for t in texts for x in t.split("\n")[1:]) == sorted(map(str, range(10))) and len(texts) == 3


def test_an_aborted_workbook_leaves_no_file(spark, tmp_path):
    workbook.register(spark)
    out = tmp_path / "none"
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("workbook").mode("overwrite").save(str(out))
    assert not [p for p in out.rglob("*") if p.is_file()]


def test_report_with_workbooks(spark, tmp_path):
    got = exports.export_report({"cells": spark.range(2)}, spark.range(1), str(tmp_path / "r"), "excel", datetime.datetime(2024, 1, 2))
    assert list(got) == ["cells_excel"] and files.read_documents(spark, got["cells_excel"]).count() >= 2


# trees


def test_tree_codes_are_names_of_information_nodes(spark):
    tree = {
        "Information": [{"Name": "H225"}, {"Name": "GHS02", "Value": "see H999"}, {"Name": "H2x"}, {"Other": "H300"}, {"Name": None}, {"Name": 5}],
        "Text": '"Name": "H998"', "Name": "H997",
        "Node": [{"Information": [{"Name": "P210"}, {"Name": "H319"}], "Node": [{"Node": [{"Information": [{"Name": "H225"}]}]}]}, {"Information": {"Name": "H996"}}, {"Information": [{"Name": "H301"}]}],
    }
    rows = [(1, json.dumps(tree)), (2, None), (3, "no json {"), (4, "{}"), (5, '[{"Name": "H1"}]'), (6, json.dumps({"Information": [{"Name": f"H{k}"} for k in range(12)]}))]
    got = sorted(tuple(r) for r in trees.tree_codes(spark.createDataFrame(rows, "id int, tree string")).collect())
    assert got == sorted([(1, "hazard", k + 1, c) for k, c in enumerate(["H225", "H319", "H225", "H301"])] + [(1, "pictogram", 1, "GHS02"), (1, "precaution", 1, "P210")] + [(6, "hazard", k + 1, f"H{k}") for k in range(12)])
    assert trees.tree_codes(spark.createDataFrame([], "id int, tree string")).count() == 0
