"""Resampling of documents towards the word statistics of a target table (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, numbered, python_ready, tidy, written
from .terms import words

#: Features are runs of 1 to NGRAM words, hashed to BUCKETS; SHARE percent of the documents of MIN_WORDS words or more are drawn.
NGRAM, BUCKETS, SHARE, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024


class Ring:
    """Running CRC-32 states of the last n starts of a stream of words; each word extends all of them by a space and itself, and opens one."""

    def __init__(self, n: int) -> None:
        self.n, self.states = n, []

    def feed(self, found: list[bytes]) -> list[int]:
        """CRC-32 of all runs of 1 to n words that end within ``found``, in the order of their last words, longest first."""
        out: list[int] = []
        n, states = self.n, self.states
        for w in found:
            if states:
                tail = b" " + w
                states = [crc32(tail, s) for s in states]
            states.append(crc32(w))
            out += states
            if len(states) == n:
                del states[0]
        self.states = states
        return out


def _scan(text: bytes | None, n: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the features of a text, part by part."""
    ring = Ring(n)
    for part in words(text or b""):
        yield len(part), np.array(ring.feed(part), dtype=np.int64) % size


def bucket_counts(rows: DataFrame, n: int = NGRAM, size: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the column text fall in each bucket; buckets without one are left out. A task gives ``size`` rows at most."""
    python_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("importance_resampling")
        counts = np.zeros(size, dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                for _, found in _scan(text, n, size):
                    counts += np.bincount(found, minlength=size)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])
        tidy()

    counted = rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the raw counts, with one added to each count."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = [(float(t) + 1) * (float(s_all) + size) / ((float(s) + 1) * (float(t_all) + size)) for s, t in zip(raw, target, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def _vector(counts: DataFrame, size: int) -> np.ndarray:
    """Counts by bucket on the driver: ``size`` numbers at most, whatever the table."""
    out, got = np.zeros(size, dtype=np.int64), counts.toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def weights(docs: DataFrame, gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains over each document's features."""
    spark, size = docs.sparkSession, len(gain)
    python_ready(spark)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("importance_resampling")
        gain = shared.value
        for b in batches:
            rows = np.zeros((len(b), 3), dtype=np.int64)
            for k, text in enumerate(b.column("text").to_pylist()):
                for n_words, found in _scan(text, n, size):
                    rows[k] += n_words, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in np.ascontiguousarray(rows.T))], ["doc_id", "n_words", "n_features", "weight"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, n: int = NGRAM, size: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): documents drawn without replacement, likelier the more their words are the target's.

    Features of a text are all runs of 1 to n words (lower case of A-Z only), their bucket the CRC-32 of their bytes modulo ``size``; one scan
    keeps the CRC states of the last n starts, so no run is built as a string. weight sums the gains of the features, score adds Gumbel noise
    from sha256 of ``seed:doc_id``, and the ``share`` percent of highest scores among the documents of ``min_words`` words are ranked 1, 2, 3...,
    equal scores by smaller id; other rows' rank is null. Every row of ``docs`` gives a row: null and empty texts have weight 0, repeated rows are
    drawn each for itself with the same score, a null doc_id draws as an empty id and comes last among equal scores. An empty target counts 0
    in each bucket; empty docs give no row. Other columns don't matter.

    The driver holds two vectors of ``size`` counts. Texts are scanned twice and never shuffled; ranks come from a sort by range of the scored
    rows, which are a written table.
    """
    gain = gains(_vector(bucket_counts(docs, n, size), size), _vector(bucket_counts(target, n, size), size))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weights(docs, gain, n).withColumn("score", F.col("weight") + noise), "scored")
    able, rest = scored.filter(F.col("n_words") >= min_words), scored.filter(F.col("n_words") < min_words)
    ranked, n_able = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    drawn = F.when(F.col("rank") <= share * n_able // 100, F.col("rank"))
    return ranked.withColumn("rank", drawn).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
