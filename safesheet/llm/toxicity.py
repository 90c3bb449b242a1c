"""Toxicity by class-conditional Kneser-Ney models (operator 1)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, fold, keep, python_ready, tidy, written

#: Labelled documents of each class that the models are fitted on at most; CALIBRATION in ten of them fit the calibration.
MAX_DOCS, CALIBRATION = 4000, 2
THRESHOLD = 0.3
#: Taken from each count: what was seen in so few contexts is left to the shared backoff altogether.
DISCOUNT = 2.0
#: Log ratios under this are also summed apart: a difference in the mix of languages moves every word a little.
MARGIN = 1.5
WORD = re.compile(r"\w+")
FEATURES = 5


class Model:
    """Log ratios of the two models' probabilities. Words have numbers from 1; 0 is any other word.

    P_c(w | v) = (N_c(. v w) - D) / N_c(. v .) + backoff_c(v) P_c(w), and P_c(w) = (N_c(. w) - D) / N_c(. .) + backoff_c P(w): N_c
    counts the distinct words before, in class c, so that copies of a text add nothing, and P(w) is the share of w in all
    documents, toxic or not. At most the count itself is taken from it, and backoff_c is what was taken in all.
    """

    def __init__(self, words: list[str], cont: np.ndarray, total: np.ndarray, taken: np.ndarray, seen: np.ndarray, follow: np.ndarray, keys: np.ndarray, pairs: np.ndarray, corpus: np.ndarray):
        """cont, seen, follow: by word and class, N_c(. w), N_c(. v .) and what is taken from its counts; total, taken by class; keys, pairs: bigrams and N_c(. v w); corpus: counts of each number in all documents."""
        self.index = {w: k for k, w in enumerate(words, 1)}
        self.base = len(words) + 1
        cont, seen, follow = (np.vstack([np.zeros((1, 2)), a]) for a in (cont, seen, follow))
        shared = (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
        low = np.maximum(cont - DISCOUNT, 0) / np.maximum(total, 1) + np.where(total > 0, taken / np.maximum(total, 1), 1) * shared[:, None]
        back = np.maximum(np.where(seen > 0, follow / np.maximum(seen, 1), 1.0), 1e-6)
        self.word = (np.log(low[:, 1]) - np.log(low[:, 0])).astype(np.float32)
        self.back = (np.log(back[:, 1]) - np.log(back[:, 0])).astype(np.float32)
        order = np.argsort(keys)
        self.keys, pairs = keys[order], pairs[order]
        v, w = self.keys // self.base, self.keys % self.base
        p = np.maximum(pairs - DISCOUNT, 0) / np.maximum(seen[v], 1) + back[v] * low[w]
        self.pair = (np.log(p[:, 1]) - np.log(p[:, 0])).astype(np.float32)
        if not len(self.keys):
            self.keys, self.pair = np.array([-1], dtype=np.int64), np.zeros(1, dtype=np.float32)

    def numbers(self, text: str) -> np.ndarray:
        find = self.index.get
        return np.array([find(w, 0) for w in WORD.findall(text.lower())], dtype=np.int64)

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: log likelihood ratio by its length; what ratios have over MARGIN by the length, by its root and as a logarithm; the logarithm of the length."""
        ids = [self.numbers(t) for t in texts]
        n = np.array([len(x) for x in ids])
        flat = np.concatenate([*ids, np.zeros(0, dtype=np.int64)])
        ratio = self.word[flat]
        if len(flat) > 1:
            v, w = flat[:-1], flat[1:]
            key = v * self.base + w
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ratio[1:] = np.where(self.keys[at] == key, self.pair[at], self.back[v] + ratio[1:])
        starts = np.cumsum(n) - n
        first = starts[n > 0]
        ratio[first] = self.word[flat[first]]
        total, over = np.zeros(len(texts)), np.zeros(len(texts))
        if len(first):
            total[n > 0] = np.add.reduceat(ratio, first, dtype=np.float64)
            over[n > 0] = np.add.reduceat(np.maximum(ratio - MARGIN, 0), first, dtype=np.float64)
        m = np.maximum(n, 1)
        return np.stack([total / m, over / m, over / np.sqrt(m), np.log1p(over), np.log1p(n)], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression (mean, scale, weights with the constant last), with the classes weighted to the prior."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            found.update((u, v, w, toxic) for u, v, w in zip(["", "", *words], ["", *words], words, strict=False))
        keys = list(found)
        own = [pa.array([k[i] for k in keys], pa.string() if i < 3 else pa.int32()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(list(found.values()), pa.int64())], ["u", "v", "w", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS):
    """(Model, calibration) from labels whose crc32(doc_id as text) mod 4 isn't 2; None without both classes.

    The models are fitted on at most ``max_docs`` labelled documents of each class, first by hashed id. The shared backoff
    counts come from every row of ``docs``, and the prior from every label of those folds. A document with several
    labels is toxic if one says so; null labels and ids are left out.
    """
    spark = docs.sparkSession
    python_ready(spark)
    known = labels.filter((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    prior = sizes[1] / (sizes[0] + sizes[1])
    ids = bounded_ids(known, "toxic", [0, 1], max_docs)
    # at most 2 * max_docs ids; equal texts, as copies have, count once
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null").dropDuplicates(["text", "toxic"]), "toxicity-sample")
    late = F.pmod(F.xxhash64("text"), F.lit(10)) < CALIBRATION
    counted = sample.filter(~late).select("text", "toxic").mapInArrow(_count_trigrams, "u string, v string, w string, toxic int, n long")
    each = lambda c: F.count_distinct(F.when(F.col("toxic") == c, F.col("u")))
    grams = written(counted.groupBy("v", "w").agg(each(0).alias("n0"), each(1).alias("n1"), F.sum("n").alias("n")), "toxicity-bigrams")
    plus = lambda c: F.sum((F.col(c) > 0).cast("long"))
    less = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    cont = written(grams.groupBy("w").agg(plus("n0").alias("c0"), plus("n1").alias("c1"), F.sum("n").alias("n")), "toxicity-words")
    heads = grams.filter("v != ''").groupBy("v").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), less("n0").alias("f0"), less("n1").alias("f1")).withColumnRenamed("v", "w")
    table = cont.filter("n >= 2").join(heads, "w", "left").fillna(0).toPandas().sort_values("w").reset_index(drop=True)
    words = table["w"].tolist()
    sums = cont.agg(F.sum("c0"), F.sum("c1"), less("c0"), less("c1")).first()
    if not words:
        return None
    index = {w: k for k, w in enumerate(words, 1)}
    shared = spark.sparkContext.broadcast(index)

    def corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for b in batches:
            parts = [[find(w, 0) for w in WORD.findall(t.lower())] for t in b.column("text").to_pylist() if t]
            for at in range(0, len(parts), 200):
                ids = [k for p in parts[at : at + 200] for k in p]
                total += np.bincount(np.array(ids, dtype=np.int64), minlength=len(total))
        k = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], ["k", "n"])

    everywhere = np.zeros(len(words) + 1)
    for r in docs.select("text").mapInArrow(corpus, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().itertuples():
        everywhere[r.k] = r.n
    often = grams.filter(f"v != '' and greatest(n0, n1) > {DISCOUNT}").toPandas()
    often = often[often["v"].isin(index) & often["w"].isin(index)]
    base = len(words) + 1
    keys = (often["v"].map(index).to_numpy(dtype=np.int64) * base + often["w"].map(index).to_numpy(dtype=np.int64)) if len(often) else np.zeros(0, dtype=np.int64)
    model = Model(
        words, table[["c0", "c1"]].to_numpy(dtype=float), np.array(sums[:2], dtype=float), np.array(sums[2:], dtype=float),
        table[["s0", "s1"]].to_numpy(dtype=float), table[["f0", "f1"]].to_numpy(dtype=float), keys, often[["n0", "n1"]].to_numpy(dtype=float), everywhere,
    )
    rest = _scored(sample.filter(late), model, None, ["toxic"]).toPandas()
    if rest["toxic"].nunique() < 2:
        rest = _scored(sample, model, None, ["toxic"]).toPandas()
    x = rest[[f"f{k}" for k in range(FEATURES)]].to_numpy()
    return model, calibrate(x, rest["toxic"].to_numpy(), prior)


def _scored(docs: DataFrame, model: Model, calibration, carry: list[str]) -> DataFrame:
    """The carried columns with the features f0.. of each text, and with a calibration the score."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast((model, calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("toxicity")
        model, calibration = shared.value
        for b in batches:
            x = model.features([t or "" for t in b.column("text").to_pylist()])
            own = [b.column(c) for c in carry] + [pa.array(x[:, k], pa.float64()) for k in range(FEATURES)]
            names = [*carry, *[f"f{k}" for k in range(FEATURES)]]
            if calibration:
                mean, scale, w = calibration
                own.append(pa.array(1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30))), pa.float64()))
                names.append("score")
            yield pa.RecordBatch.from_arrays(own, names)
        tidy()

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    fields = [f"{c} {types[c]}" for c in carry] + [f"f{k} double" for k in range(FEATURES)] + ["score double"] * bool(calibration)
    return docs.select(*carry, "text").mapInArrow(run, ", ".join(fields))


def toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text), over whole texts.

    Null, empty and wordless texts are scored as texts of length 0. Repeated rows each get their row. Without labels of
    both classes the score is 0. Only texts count: ids, languages and sources don't reach the models. The model sent to the
    workers is bounded by the sample of at most 2 * ``max_docs`` documents.
    """
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    made = train(docs, labels, max_docs)
    if made is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return _scored(docs, *made, ["doc_id"]).select("doc_id", held, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
