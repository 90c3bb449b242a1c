"""Line dedup by site-relative frequency (operator 9); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_null_safe, let, written

#: A line goes from a host when more than MAX_RATIO of the host's pages hold it, and at least MIN_PAGES do: a line on one page alone
#: repeats nowhere, though on a host of a few pages that page is a large share.
MAX_RATIO, MIN_PAGES = 0.1, 2
BLANKS = " \t\x0b\x0c\r"


def _hashes(line: Column) -> Column:
    """128 bits of a line without the blanks around it."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate_lines(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h1, h2, n_pages, host_pages) of each line over the ratio.

    The counts meet by host and line digest after partial sums, so a hot host or line costs one row a task.
    """
    lines = _lines(docs)
    counts = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = docs.select(F.col("source").alias("host")).groupBy("host").agg(F.count("*").alias("host_pages"))
    return join_null_safe(counts, totals, ["host"]).filter(F.col("n_pages") / F.col("host_pages") > max_ratio)


def _lines(docs: DataFrame) -> DataFrame:
    """(host, doc_id, h1, h2): a row for each distinct line of a page that isn't blank."""
    own = F.filter(F.array_distinct(F.transform(F.split("text", "\n", -1), _trimmed)), lambda x: x != "")
    return docs.select(F.col("source").alias("host"), "doc_id", F.explode(F.transform(own, _hashes)).alias("h")).select("host", "doc_id", "h.h1", "h.h2")


def line_dedup(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` (doc_id, source, text and whatever else) with boilerplate lines taken out of ``text``.

    Returns the columns of ``docs`` and ``n_lines``, ``n_dropped`` (lines that aren't blank), which replace
    columns of these names. A page is a row: repeated rows count as often as they come. The host is ``source``; rows
    without one make up one host. Lines are compared without blanks around them, in their own case. Blank lines stay.
    Null text stays null with 0 lines; text of which every line goes becomes empty. Documents are never dropped.
    The listing of dropped lines is a written table, small beside the pages, so Spark may broadcast it by its size
    or split a hot key of the sort-merge join.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    listed = written(boilerplate_lines(docs, max_ratio, min_pages).select("host", "h1", "h2"), "boilerplate")
    held = join_null_safe(_lines(docs), listed, ["host", "h1", "h2"]).groupBy("host", "doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("out"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), F.col("source").alias("host"), "doc_id")
    rows = join_null_safe(rows, held, ["host", "doc_id"], "left")

    def dropped(line: Column) -> Column:
        return F.array_contains(F.col("out"), _hashes(_trimmed(line)))

    split = F.split("row.text", "\n", -1)
    kept = F.when(F.col("out").isNull(), split).otherwise(F.filter(split, lambda x: ~dropped(x)))
    solid = lambda lines: F.coalesce(F.size(F.filter(lines, lambda x: _trimmed(x) != "")), F.lit(0)).cast("long")
    made = let(
        F.struct(split.alias("a"), kept.alias("b")),
        lambda x: F.struct(F.array_join(x["b"], "\n").alias("text"), solid(x["a"]).alias("n_lines"), (solid(x["a"]) - solid(x["b"])).alias("n_dropped")),
    )
    whole = F.when(F.col("row.text").isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))).otherwise(made)
    done = rows.select("row", whole.alias("made"))
    return done.select(*[F.col("made.text") if c == "text" else F.col(f"row.`{c}`") for c in columns], "made.n_lines", "made.n_dropped")
