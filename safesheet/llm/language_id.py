"""Language identification by a byte convolutional network trained in numpy (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep, python_ready, tidy

#: Training documents of a language (about), passages taken of each, and characters of a passage.
MAX_DOCS, PASSAGES, PASSAGE = 1500, 4, 400
#: Bytes of a window; filters reach over WIDTHS bytes, FILTERS of each width; bytes are embedded in EMBED numbers.
LENGTH, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 8, 8
STEPS, BATCH, RATE = 500, 128, 0.01
#: Windows scored at once.
BLOCK = 256
SPAN = max(WIDTHS)
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows over whole texts, padded with zeros, and the text of each. Neighbours share SPAN - 1 bytes, so each run of SPAN bytes is in one."""
    step = LENGTH - SPAN + 1
    counts = [max(1, -(-(len(t) - SPAN + 1) // step)) for t in texts]
    out = np.zeros((sum(counts), LENGTH), dtype=np.uint8)
    row = 0
    for t, n in zip(texts, counts, strict=True):
        raw = np.frombuffer(t, dtype=np.uint8)
        for k in range(n):
            part = raw[k * step : k * step + LENGTH]
            out[row, : len(part)] = part
            row += 1
    return out, np.repeat(np.arange(len(texts)), counts)


class Network:
    """Embedding, filters of several widths, their largest value in the window (at least 0), softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))), "bias": np.zeros(len(classes))}
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on the cross entropy; batches draw each class alike. Only the places of the maxima get gradients."""
        rng = np.random.default_rng(seed)
        own = [np.nonzero(y == c)[0] for c in range(len(self.classes))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        places = LENGTH - SPAN + 1
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(i, BATCH // len(own) + 1) for i in own])
            xb, yb, p = x[rows], y[rows], self.p
            e = p["emb"][xb]
            pooled, at = [], []
            for k in WIDTHS:
                z = sum(e[:, j : j + places] @ p[f"w{k}"][j] for j in range(k)) + p[f"b{k}"]
                at.append(z.argmax(axis=1))
                pooled.append(z.max(axis=1))
            h = np.concatenate(pooled, axis=1)
            r = np.maximum(h, 0)
            logits = r @ p["out"] + p["bias"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(yb)), yb] -= 1
            g = prob / len(yb)
            grads = {"out": r.T @ g, "bias": g.sum(axis=0), "emb": np.zeros_like(p["emb"])}
            gh = (g @ p["out"].T) * (h > 0)
            for n, k in enumerate(WIDTHS):
                gk, t = gh[:, n * FILTERS : (n + 1) * FILTERS], at[n]
                grads[f"b{k}"] = gk.sum(axis=0)
                w = np.zeros_like(p[f"w{k}"])
                for j in range(k):
                    here = xb[np.arange(len(xb))[:, None], t + j]
                    w[j] = np.einsum("bf,bfe->ef", gk, p["emb"][here])
                    np.add.at(grads["emb"], here.ravel(), (gk[:, :, None] * p[f"w{k}"][j].T[None]).reshape(-1, EMBED))
                grads[f"w{k}"] = w
            rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two bytes add to every filter as its first two and as its next two: a filter's value is a sum of two look-ups."""
        head = np.zeros((256, 256, FILTERS * len(WIDTHS)), dtype=np.float32)
        tail = np.zeros_like(head)
        for n, k in enumerate(WIDTHS):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            part = [self.p["emb"] @ self.p[f"w{k}"][j] for j in range(k)] + [np.zeros((256, FILTERS))] * (4 - k)
            head[:, :, own] = part[0][:, None] + part[1][None] + self.p[f"b{k}"]
            tail[:, :, own] = part[2][:, None] + part[3][None]
        return head.reshape(65536, -1), tail.reshape(65536, -1)


def predict(classes: list[str], head: np.ndarray, tail: np.ndarray, out: np.ndarray, bias: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and mean probability over the windows of each text; ``und`` and 0 without a letter."""
    letters = [bool(t) and LETTER.search(t) is not None for t in texts]
    raw = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, letters, strict=True)]
    total = np.zeros((len(texts), len(classes)))
    x, of = windows(raw)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK]
        pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
        z = head[pair[:, :-2]]
        z += tail[pair[:, 2:]]
        logits = np.maximum(z.max(axis=1), 0) @ out + bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob *= (np.count_nonzero(b, axis=1) / prob.sum(axis=1))[:, None]
        np.add.at(total, of[at : at + BLOCK], prob)
    sums = total.sum(axis=1)
    total /= np.where(sums > 0, sums, 1)[:, None]
    best = total.argmax(axis=1)
    names = [classes[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters, strict=True)]
    return names, [float(min(1.0, total[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best.tolist(), letters, strict=True))]


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network | None:
    """A network fitted on text and lang of about ``max_docs`` ids of each lang whose crc32(doc_id as text) mod 3 isn't 1; of all of them where there are fewer.

    The ids come by their hash, so the sample doesn't depend on partitions; of each id and lang, PASSAGES passages spread over one whole text. None
    without such rows. One pass counts the ids of each language and one takes the sample."""
    rows = docs.filter((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return None
    # of each language the ids whose hash is under a share of all hashes that max_docs ids have on average; twice as many are never taken
    share = F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, min(1.0, max_docs / max(n, 1)))])[F.col("lang")]
    starts = [(F.length("text") * F.lit(k / PASSAGES)).cast("int") + 1 for k in range(PASSAGES)]
    passages = F.struct(*[F.substr("text", s, F.lit(PASSAGE)).alias(f"p{k}") for k, s in enumerate(starts)])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).groupBy("doc_id", "lang").agg(F.min(passages).alias("p"))
    got = picked.select("doc_id", "lang", "p.*").limit(2 * max_docs * len(counts)).toPandas().sort_values(["doc_id", "lang"])
    texts = [(p, v) for k in range(PASSAGES) for p, v in zip(got[f"p{k}"], got["lang"], strict=True) if LETTER.search(p)]
    if not texts:
        return None
    x, of = windows([t.encode("utf-8", "replace") for t, _ in texts])
    classes = sorted({v for _, v in texts})
    y = np.array([classes.index(v) for _, v in texts])[of]
    full = np.count_nonzero(x, axis=1) >= 24
    full |= ~np.isin(y, y[full])
    net = Network(classes)
    net.fit(x[full], y[full])
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names; every whole text is scored from its bytes alone.

    Null texts and texts without a letter: ``und``, 0. Without a network all are ``und``. Repeated rows each get
    their row. Nothing is shuffled; the tables sent to the workers have a fixed size.
    """
    spark = docs.sparkSession
    python_ready(spark)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    model = (net.classes, *net.tables(), net.p["out"].astype(np.float32), net.p["bias"].astype(np.float32)) if net else None
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("language_id")
        model = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            lang, score = predict(*model, texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])
        tidy()

    schema = docs.select(*[docs[f"`{c}`"] for c in columns]).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.select(*[docs[f"`{c}`"] for c in columns]).mapInArrow(run, schema)


def language_id(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang); a null id is not held out and not learned from."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), train(docs, max_docs)).select("doc_id", held, "lang_pred", "score")
