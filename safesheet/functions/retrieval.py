"""A collection of chunks: added in batches, deleted by source, and asked."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

# Chunks of a batch; the text that a model is asked, what it is told about itself, and the answer where nothing is found.
BATCH = 100
HEAD, MIDDLE, TAIL = "Based on the following context, answer the question.\n\nContext:\n", "\n\nQuestion: ", "\n\nAnswer:"
SYSTEM = "You are a helpful assistant specialized in chemical safety and SDS analysis. Answer questions based on the provided context. If the context doesn't contain the answer, say so clearly."
NOTHING = "I don't have access to the knowledge base to answer this question. The RAG system may not be configured or the embedding model is unavailable."


def add_documents(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(the columns of ``chunks``, embedding, outcome): chunks (text and others) embedded in batches on the executors. outcome is added, failed for the batch that raised, or skipped for
    what a task had after it: a task stops at its first failure, and what isn't added may be given again. Null texts are failed alone."""
    names = chunks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", embedding array<float>, outcome string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = False
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                texts = part.column("text").to_pylist()
                have = [k for k, t in enumerate(texts) if t is not None]
                out: list[list[float] | None] = [None] * len(texts)
                said = ["skipped" if stopped else "failed"] * len(texts)
                if not stopped and have:
                    try:
                        for k, v in zip(have, embed([texts[k] for k in have]), strict=True):
                            out[k], said[k] = np.asarray(v, dtype=np.float32).tolist(), "added"
                    except Exception:  # whatever an embedding model raises, the batch isn't added
                        stopped = True
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float32())), pa.array(said)], [*names, "embedding", "outcome"])

    return chunks.mapInArrow(run, schema)


def delete_source(collection: DataFrame, source: str) -> DataFrame:
    """The collection without the chunks of a source; those without a source stay."""
    return collection.filter(~F.col("source").eqNullSafe(F.lit(source)))


def collection_stats(collection: DataFrame) -> DataFrame:
    """(source, documents, chunks) of each source of a collection (source, document_id, and others)."""
    return collection.groupBy("source").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(HEAD), context, F.lit(MIDDLE), question, F.lit(TAIL))


def retrieve(questions: DataFrame, indexed: DataFrame, contents: DataFrame, centroids: np.ndarray, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, question, context, prompt) of questions (query_id, question, embedding): their ``k`` nearest chunks of an index of ``vectors``, best first, with the source before each content.

    ``contents`` (id, source, content) are joined with the few chunks found. A question of which nothing is found has a null context and prompt; of null questions there are none."""
    asked = questions.filter("question is not null")
    found = vectors.search(indexed, asked, centroids, k, probes or len(centroids)).join(contents, "id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.coalesce("source", F.lit("")), F.lit(":\n"), "content").alias("part")))), lambda x: x["part"])
    context = found.groupBy("query_id").agg(F.array_join(parts, "\n---\n").alias("context"))
    rows = asked.select("query_id", "question").join(context, "query_id", "left")
    return rows.withColumn("prompt", prompt(F.col("context"), F.col("question")))


def answer(retrieved: DataFrame, ask: Callable[[str, str], str], system: str = SYSTEM) -> DataFrame:
    """``retrieved`` with answer: what ``ask`` (prompt, system) says on the executors; where nothing was found, a notice without asking."""
    said = F.udf(lambda p: ask(p, system) if p is not None else NOTHING, "string", useArrow=True)
    return retrieved.withColumn("answer", said("prompt"))
