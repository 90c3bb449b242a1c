"""What of new files and texts is taken: skips in three stages, and texts that become chunks of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import OVERLAP, SIZE, chunk_documents
from .fields import strip

# Statuses of a document that count as processed; the least characters of a text that is taken.
PROCESSED = ["completed", "success"]
LEAST_TEXT = 40


def skip_reasons(files: DataFrame, known: DataFrame) -> DataFrame:
    """The columns of ``files`` (path, name, size, hash and others) with skip_reason and document_id: why a file isn't processed, and whose results stand for it.

    ``known`` are documents (id, path, name, size, hash, status, n_extractions). In this order: same_name_and_size as a document with extractions; same_path as a
    processed one with extractions; same_hash as one with extractions; same_batch as an earlier file of ``files``, by path, with the same hash. Else both are
    null. Of several documents the least id counts. A null hash, name or path is like no other."""
    held = known.filter(F.col("n_extractions") > 0)
    by_name = held.groupBy("name", "size").agg(F.min("id").alias("__name"))
    by_path = held.filter(F.col("status").isin(*PROCESSED)).groupBy("path").agg(F.min("id").alias("__path"))
    by_hash = held.groupBy("hash").agg(F.min("id").alias("__hash"))
    first = files.filter("hash is not null").groupBy("hash").agg(F.min("path").alias("__first"))
    rows = files.join(by_name, ["name", "size"], "left").join(by_path, "path", "left").join(by_hash, "hash", "left").join(first, "hash", "left")
    reason = F.when(F.col("__name").isNotNull(), "same_name_and_size").when(F.col("__path").isNotNull(), "same_path").when(F.col("__hash").isNotNull(), "same_hash").when(F.col("path") > F.col("__first"), "same_batch")
    return rows.select(*[F.col(f"`{c}`") for c in files.columns], reason.alias("skip_reason"), F.coalesce("__name", "__path", "__hash").alias("document_id"))


def take_texts(texts: DataFrame, registered: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts (source, title, text): the documents to register (content_hash, source, title, chunk_count), their chunks (content_hash, chunk_index, total_chunks, text), and the
    outcome of each text (source, title, outcome, content_hash).

    A text under LEAST_TEXT characters without blanks around is too_short; one whose SHA-256 is in ``registered`` (content_hash) is a duplicate, and so is one that an earlier text
    (by source, then title) has; the others are taken, and chunked. Null texts are too_short."""
    body = strip(F.coalesce("text", F.lit("")))
    rows = texts.select("source", "title", "text", F.sha2("text", 256).alias("content_hash"), (F.length(body) < LEAST_TEXT).alias("short"))
    have = registered.select("content_hash", F.lit(True).alias("known")).distinct()
    order = Window.partitionBy("content_hash", "short").orderBy("source", "title")
    judged = rows.withColumn("nth", F.row_number().over(order)).join(have, "content_hash", "left")
    outcome = F.when(F.col("short"), "too_short").when(F.col("known") | (F.col("nth") > 1), "duplicate").otherwise("taken")
    judged = judged.withColumn("outcome", outcome)
    chunks = chunk_documents(judged.filter("outcome = 'taken'").select("content_hash", "source", "title", "text"), size, overlap)
    documents = chunks.filter("chunk_index = 0").select("content_hash", "source", "title", F.col("total_chunks").alias("chunk_count"))
    return documents, chunks.select("content_hash", "chunk_index", "total_chunks", "text"), judged.select("source", "title", "outcome", "content_hash")


def first_of_equal(rows: DataFrame, key: str = "file_hash", order: str = "id") -> DataFrame:
    """The rows before which, by ``order``, there is none with their ``key``; a row without ``key`` or ``order`` is like no other and stays. The least ``order`` of each key is joined, not the rows with each other."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__least"))
    held = rows.join(least, rows[key] == least["__key"], "left")
    return held.filter(F.col("__least").isNull() | F.col(order).isNull() | (F.col(order) == F.col("__least"))).select(*[rows[f"`{c}`"] for c in rows.columns])
