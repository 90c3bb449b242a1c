"""Quality rules with cross-document line frequency (operator 2); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_null_safe, let, written

#: A line is removed from a host when more distinct documents hold it than the larger of MAX_DOCS and MAX_SHARE of the
#: host's documents; a document is depleted when more than MAX_LOST of its words go with such lines.
MAX_DOCS, MAX_SHARE, MAX_LOST = 10, 0.02, 0.5
#: Words are runs of anything but these.
SPACE = r"[ \t-\r]"
WINDOW = 8


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE}+", -1))


def _repeated(words: Column) -> Column:
    """Words in 8-word windows that the text has twice or more: sorted window digests show the repeats, and the
    positions that their windows cover are summed as a union of intervals. Linear but for the sorts."""

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, first, step)["n"]

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return let(ordered, lambda s: covered(F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"]))))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found)


def base_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        F.struct(_words(text).alias("w"), lines.alias("l")),
        lambda x: F.struct(
            long(F.size(x["w"]), "n_words"), long(F.length(F.array_join(x["w"], "")), "word_chars"),
            long(F.regexp_count(text, F.lit("[#*$%&|<>]")), "n_symbols"),
            long(F.size(x["l"]) - F.size(F.array_distinct(x["l"])), "n_dup_lines"), long(_repeated(x["w"]), "n_repeat_words"),
        ),
    )


def _norm(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, f"{SPACE}+", " ")))


def _lines(docs: DataFrame) -> DataFrame:
    """(host, doc_id, t1, t2, pos, h1, h2, w): digests of the text, place, digests and word count of every line with a word; normalised: lower case, single spaces."""
    lines = F.posexplode(F.transform(F.split("text", "\n", -1), _norm)).alias("pos", "line")
    rows = docs.select(F.col("source").alias("host"), "doc_id", *_text_key(), lines).filter("line != ''")
    return rows.select("host", "doc_id", "t1", "t2", "pos", *_digests(F.col("line")), F.size(F.split("line", " ", -1)).alias("w"))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")]


def _digests(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h1, h2, n_docs) of each line over the limits. Distinct documents are counted in two steps (by line and
    document, then by line), so that neither a hot host nor a hot line meets in one task."""
    ids = F.struct(F.col("doc_id"))  # so that a null id counts as one document
    counts = _lines(docs).groupBy("host", "h1", "h2").agg(F.count_distinct(ids).alias("n_docs")).filter(F.col("n_docs") > max_docs)
    totals = docs.select(F.col("source").alias("host"), ids.alias("id")).groupBy("host").agg(F.count_distinct("id").alias("host_docs"))
    return join_null_safe(counts, totals, ["host"]).filter(F.col("n_docs") > max_share * F.col("host_docs")).drop("host_docs")


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_lost: float = MAX_LOST) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, text): doc_id, the five measures, n_lost_words, base_failed, kept.

    Fails the base: fewer than 20 words, or over 30 % of the words in repeated windows. Otherwise a document is kept
    unless more than ``max_lost`` of its words are in lines over the limits. The host is ``source``; rows without one make
    up one host. Documents are told apart by doc_id: repeated rows count once in line frequencies; each gets its row, with
    the words lost of its own text. Null text counts as empty; an empty table gives none.
    """
    listed = written(frequent_lines(docs, max_docs, max_share).select("host", "h1", "h2"), "frequent-lines")
    own = ["host", "doc_id", "t1", "t2"]
    lost = join_null_safe(_lines(docs), listed, ["host", "h1", "h2"]).dropDuplicates([*own, "pos"]).groupBy(*own).agg(F.sum("w").alias("n_lost_words"))
    rows = docs.select("doc_id", F.col("source").alias("host"), *_text_key(), base_measures(F.col("text")).alias("m")).select(*own, "m.*")
    rows = join_null_safe(rows, lost, own, "left").drop("host", "t1", "t2").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= max_lost * F.col("n_words")))


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with the lines over the limits of their host taken out of ``text``; null text stays null, no row goes."""
    listed = written(frequent_lines(docs, max_docs, max_share).select("host", "h1", "h2"), "frequent-lines")
    held = join_null_safe(_lines(docs), listed, ["host", "h1", "h2"]).groupBy("host", "doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("out"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("source").alias("host"), "doc_id")
    rows = join_null_safe(rows, held, ["host", "doc_id"], "left")
    left = F.filter(F.split("row.text", "\n", -1), lambda x: ~F.array_contains(F.col("out"), F.struct(*_digests(_norm(x)))))
    text = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
