"""Files as documents: text, Markdown, HTML, CSV, Word and Excel by suffix, and classification lists in JSON."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

#: Kind of a document by its file's suffix; other files aren't read.
KINDS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "csv", ".docx": "docx", ".xlsx": "excel"}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class _Nodes(HTMLParser):
    """Text nodes outside scripts and styles, entities decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.closed = 0

    def handle_starttag(self, tag, attrs):
        self.closed += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.closed -= tag in ("script", "style") and self.closed > 0

    def handle_data(self, data):
        if not self.closed and data.strip():
            self.found.append(data.strip())


def html_text(html: str) -> str:
    nodes = _Nodes()
    nodes.feed(html)
    nodes.close()
    return "\n".join(nodes.found)


def docx_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, by line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    texts = ["".join("\t" if n.tag == f"{_WORD}tab" else n.text or "" for n in p.iter() if n.tag in (f"{_WORD}t", f"{_WORD}tab")) for p in body.findall(f"{_WORD}p")]
    return "\n".join(t for t in texts if t.strip())


def excel_texts(raw: bytes) -> list[tuple[str, int, str, int]]:
    """(sheet, its number, text, rows) of each sheet with a cell: cells with bars between, a line for each row that has one."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names, out = z.namelist(), []
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        where = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), 1):
            path = where[sheet.get(f"{_RELATION}id")]
            tree = ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
            lines = []
            for row in tree.iter(f"{_SHEET}row"):
                cells = []
                for c in row.iter(f"{_SHEET}c"):
                    value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                    if inline is not None:
                        cells.append("".join(t.text or "" for t in inline.iter(f"{_SHEET}t")).strip())
                    elif value is not None and value.text is not None:
                        cells.append((shared[int(value.text)] if c.get("t") == "s" else value.text).strip())
                if cells:
                    lines.append(" | ".join(cells))
            if lines:
                out.append((sheet.get("name"), number, "\n".join(lines), len(lines)))
    return out


def parse_file(kind: str, raw: bytes) -> list[dict]:
    """The documents of one file; ``error`` says why there is none."""
    try:
        if kind == "excel":
            return [{"sheet": s, "sheet_number": k, "text": t, "rows": n} for s, k, t, n in excel_texts(raw)]
        if kind == "docx":
            return [{"text": docx_text(raw)}]
        text = raw.decode("utf-8")
        return [{"text": html_text(text) if kind == "html" else text}]
    except Exception as e:  # a file that can't be read is a row with its error, whatever is wrong with it
        return [{"error": f"{type(e).__name__}: {e}"[:200]}]


PARSED = "array<struct<text:string,rows:int,sheet:string,sheet_number:int,error:string>>"


def _kind(path: Column) -> Column:
    pairs = [F.lit(x) for p in KINDS.items() for x in p]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(source, title, type, content) of the files of KINDS at ``path``, whatever the case of their suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("type", _kind(F.col("path"))).filter("type is not null")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(F.col("path").alias("source"), F.regexp_replace(name, r"(.)\.[^.]*$", "$1").alias("title"), "type", "content", F.col("_metadata.file_path").alias("file"))


def csv_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, text, rows) of CSV files: a line for each row under the head, its cells that aren't empty as ``name: value`` with bars between.

    Each file has a head of its own. Files are read by Spark's reader, with as many columns as the longest line has separators; cells beyond the
    head are left out, as are rows without a cell. A quoted cell may hold line ends and doubled quotes. A file of its head alone has an empty text."""
    lines = spark.read.text(paths)
    width = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    cells = ", ".join(f"c{k} string" for k in range(width))
    rows = spark.read.schema(cells).option("multiLine", "true").option("escape", '"').option("enforceSchema", "true").csv(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.array(*[f"c{k}" for k in range(width)]).alias("cells"))
    head = rows.groupBy("file").agg(F.min_by("cells", "at").alias("names"), F.min("at").alias("first"))
    named = F.filter(F.arrays_zip("names", "cells"), lambda x: (x["names"] != "") & (x["cells"] != ""))
    line = F.array_join(F.transform(named, lambda x: F.concat(x["names"], F.lit(": "), x["cells"])), " | ")
    body = rows.join(head, "file").withColumn("line", F.when((F.col("at") > F.col("first")) & (F.size(named) > 0), F.struct("at", line.alias("line"))))
    found = body.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return found.select("file", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.size("lines").alias("rows"))


def read_documents(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """(source, title, type, text, rows, sheet, sheet_number) of the files of KINDS at ``path``, a file or a folder with all below it.

    A file that can't be read gives no document; with ``errors`` those files alone come, as (source, error). Other suffixes are left out.
    CSV files are read by Spark in columns, all others one by one, as their formats want."""
    files = _files(spark, path)
    made = F.udf(lambda k, raw: [{"text": None, "rows": None, "sheet": None, "sheet_number": None, "error": None} | d for d in parse_file(k, bytes(raw))], PARSED, useArrow=True)
    rows = files.filter("type <> 'csv'").select("source", "title", "type", F.explode(made("type", "content")).alias("d"))
    if errors:
        return rows.filter("d.error is not null").select("source", "d.error")
    whole = rows.filter("d.error is null").select("source", "title", "type", "d.text", "d.rows", "d.sheet", "d.sheet_number")
    tables = files.filter("type = 'csv'").select("source", "title", "type", "file")
    if paths := [r["source"] for r in tables.select("source").collect()]:
        texts = tables.join(csv_texts(spark, paths), "file", "left").select("source", "title", "type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rows", F.lit(0)).alias("rows"))
        whole = whole.unionByName(texts, allowMissingColumns=True)
    return whole


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """``read_documents`` of one file; a suffix that isn't in KINDS, a file that isn't there or one that can't be read is an error."""
    if not re.search(rf"({'|'.join(map(re.escape, KINDS))})$", path.lower()):
        raise ValueError(f"no reader for {path}")
    if bad := read_documents(spark, path, errors=True).take(1):
        raise ValueError(f"{bad[0]['source']}: {bad[0]['error']}")
    if not _files(spark, path).select("source").take(1):
        raise ValueError(f"no file at {path}")
    return read_documents(spark, path)


CLASSIFICATION = ["cas_number", "hazard_code", "category", "hazard_class", "statement", "source", "confidence"]
ECHA = "cas_number string, hazards array<struct<code:string,category:string,class:string,statement:string>>"
PUBCHEM = "props array<struct<urn:struct<label:string>,value:struct<sval:string>>>, sections array<struct<heading:string,information:array<struct<code:string,category:string,statement:string>>>>"


def read_echa(spark: SparkSession, path: str) -> DataFrame:
    """Rows CLASSIFICATION of a JSON list of substances with their hazards, with confidence 0.95; those without number are left out."""
    rows = spark.read.option("multiLine", "true").schema(ECHA).json(path).filter("cas_number <> ''").select("cas_number", F.explode("hazards").alias("h"))
    return rows.select("cas_number", F.col("h.code").alias("hazard_code"), "h.category", F.col("h.class").alias("hazard_class"), "h.statement", F.lit("ECHA").alias("source"), F.lit(0.95).alias("confidence"))


def read_pubchem(spark: SparkSession, path: str) -> DataFrame:
    """Rows CLASSIFICATION of a JSON list of compounds: codes that begin with H of sections with GHS in their heading, with confidence 0.85.

    The number is the first property with label CAS; compounds without one are left out."""
    rows = spark.read.option("multiLine", "true").schema(PUBCHEM).json(path)
    cas = F.get(F.filter("props", lambda p: p["urn"]["label"] == "CAS"), F.lit(0))["value"]["sval"]
    rows = rows.select(cas.alias("cas_number"), F.explode(F.filter("sections", lambda s: F.contains(s["heading"], F.lit("GHS")))).alias("s")).filter("cas_number <> ''")
    rows = rows.select("cas_number", F.explode("s.information").alias("i")).filter(F.startswith(F.col("i.code"), F.lit("H")))
    return rows.select("cas_number", F.col("i.code").alias("hazard_code"), "i.category", F.lit(None).cast("string").alias("hazard_class"), "i.statement", F.lit("PubChem").alias("source"), F.lit(0.85).alias("confidence"))


def merge_classifications(*lists: DataFrame, key: tuple[str, ...] = ("cas_number", "hazard_code", "source")) -> DataFrame:
    """All lists, of rows with equal ``key`` the one that comes first in the lists (inside one, the least by its other columns)."""
    rows = [d.withColumn("__list", F.lit(k)) for k, d in enumerate(lists)]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    order = Window.partitionBy(*key).orderBy("__list", *[c for c in CLASSIFICATION if c not in key])
    return whole.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k", "__list")
