"""A corpus pipeline of operators of safesheet.llm: language, boilerplate lines, near copies, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safesheet.llm import bpe, decontamination, language_id, line_dedup, ngram_join
from safesheet.llm.common import drop, table, written
from safesheet.llm.queries import vocabulary

#: Score of the predicted language under which a document goes; a guess among four languages has more.
MIN_SCORE = 0.4


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: neither ``und`` (null, empty, no letter) nor a score under MIN_SCORE. Repeated rows are judged alike."""
    judged = language_id.identify(docs, language_id.train(docs))
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*[judged[f"`{c}`"] for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text. A text of which every line goes stays, empty."""
    clean = line_dedup.line_dedup(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies, which repeated rows are too; texts without a word all stay."""
    return ngram_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; another text under the same doc_id is another document."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of them and of the bytes they decode to; null text counts as empty."""
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs, path, pattern)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", languages), ("line_dedup", lines), ("ngram_join", near_copies), ("decontamination", leaks), ("bpe", tokens)]

#: Language identification, near copies and decontamination have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written as Parquet to the shared folder and read again; a stage's folder goes when the next is written, the last one's at exit."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
