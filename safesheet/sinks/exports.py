"""Reports and backups as files, and the tables that a harvest keeps. Every writer is a Spark job; nothing is gathered on the driver but the table of a page."""

from __future__ import annotations

import html
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import export_excel


def export_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A CSV folder with a header; with ``order`` sorted over all its files by their names."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").option("escape", '"').csv(path)
    return path


def export_json(rows: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A folder of JSON lines; null fields stay."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def pivot_matrix(cells: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Cells (``row``, ``column``, ``value``) as a table with a column for each of ``names``, which bound its width; missing cells are Unknown."""
    return cells.groupBy(row).pivot(column, names).agg(F.first(value)).fillna("Unknown", names).orderBy(row)


def export_html(rows: DataFrame, path: str, title: str, most: int = 1000) -> str:
    """A page with a table of the first ``most`` rows, written as a text folder; a page is for reading, whole tables go to the other formats."""
    cell = lambda x, tag: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = "".join("<tr>" + "".join(cell(x, "td") for x in r) + "</tr>" for r in rows.limit(most).collect())
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{''.join(cell(c, 'th') for c in rows.columns)}</tr>{body}</table></body></html>"
    rows.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def export_report(tables: dict[str, DataFrame], statistics: DataFrame, folder: str, kind: str = "all", now: datetime | None = None) -> dict[str, str]:
    """Path of each part of a report in ``folder``: tables as csv, excel and html, statistics as json; ``kind`` is one of these or all. Names end in the time."""
    if kind not in ("csv", "excel", "json", "html", "all"):
        raise ValueError(f"no report of kind {kind}")
    stamp, out = (now or datetime.now()).strftime("%Y%m%d_%H%M%S"), {}
    if kind in ("csv", "all"):
        out |= {f"{n}_csv": export_csv(t, f"{folder}/{n}_{stamp}.csv") for n, t in tables.items()}
    if kind in ("excel", "all"):
        out |= {f"{n}_excel": export_excel(t, f"{folder}/{n}_{stamp}", n) for n, t in tables.items()}
    if kind in ("json", "all"):
        out["json"] = export_json(statistics, f"{folder}/statistics_{stamp}.json")
    if kind in ("html", "all"):
        out |= {f"{n}_html": export_html(t, f"{folder}/{n}_{stamp}.html", n) for n, t in tables.items()}
    return out


#: Tables of a backup and their order.
BACKUP = {"rules": ["cas_a", "cas_b"], "hazards": ["cas"], "documents": ["id"]}


def backup(tables: dict[str, DataFrame], folder: str, version: str, order: dict[str, list[str]] = BACKUP) -> DataFrame:
    """(name, rows, json, csv) of the tables of ``order``, each written in its order as JSON and CSV under ``folder``/``version``; a missing table is an error, before anything is written."""
    if lacking := sorted(set(order) - set(tables)):
        raise ValueError(f"tables missing: {', '.join(lacking)}")
    spark = next(iter(tables.values())).sparkSession
    done = []
    for name, by in order.items():
        at = f"{folder}/{version}/{name}"
        export_json(tables[name], f"{at}.json", by)
        flat = tables[name].select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f"`{f.name}`") for f in tables[name].schema])
        export_csv(flat, f"{at}.csv", by)
        done.append((name, spark.read.json(f"{at}.json", schema=tables[name].schema).count(), f"{at}.json", f"{at}.csv"))
    return spark.createDataFrame(done, "name string, rows long, json string, csv string")


def harvest_records(files: DataFrame, source: str) -> DataFrame:
    """Attempts (source, path, status, file_hash, file_size_bytes, error) of downloaded ``files`` (path, content, error): a hash and size where there is content."""
    return files.select(
        F.lit(source).alias("source"), "path", F.when(F.col("content").isNotNull(), "downloaded").otherwise("failed").alias("status"),
        F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("file_size_bytes"), "error",
    )


def put_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` (key, value, updated_at) with ``changes`` in place of rows of their keys; of several changes of a key the latest, of equal times the largest value."""
    rows = state.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return rows.groupBy("key").agg(F.max(F.struct("__new", "updated_at", "value")).alias("x")).select("key", "x.value", "x.updated_at")


def read_backup(spark: SparkSession, folder: str, version: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{version}/{name}.json")
