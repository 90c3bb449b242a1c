"""The two models against plain formulas."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from safesheet.llm import language_id, toxicity


def test_log_ratios_are_those_of_kneser_ney_models(spark):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(words[: 6 + 6 * (k % 2)]) for _ in range(rng.randint(4, 12)))) for k in range(120)] + [(500 + k, f"only here w{k} w1") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows if k < 500], "doc_id long, quality int, toxic int")
    model, _ = toxicity.train(docs, labels)
    known = docs.join(labels, "doc_id").filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & (F.pmod(F.xxhash64("text"), F.lit(10)) >= toxicity.CALIBRATION))
    texts = {(r["text"], r["toxic"]) for r in known.collect()}
    before = [defaultdict(set), defaultdict(set)]  # by class: the words before each pair
    tokens = Counter()
    for text, c in texts:
        ws = text.split()
        tokens.update(ws)
        for u, v, w in zip(["", "", *ws], ["", *ws], ws, strict=False):
            before[c][v, w].add(u)
    index = {w for w, n in tokens.items() if n >= 2}
    corpus = Counter(w if w in index else "?" for _, t in rows for w in t.split())
    share = lambda w: (corpus[w if w in index else "?"] + 0.5) / (sum(corpus.values()) + 0.5 * (len(index) + 1))
    d = toxicity.DISCOUNT

    def low(c, w):
        cont = Counter(x for _, x in before[c])
        total = sum(cont.values())
        return max((cont[w] if w in index else 0) - d, 0) / total + sum(min(n, d) for n in cont.values()) / total * share(w)

    def pair(c, v, w):
        own = {x: len(us) for (u, x), us in before[c].items() if u == v} if v in index else {}
        seen = sum(own.values())
        back = max(sum(min(n, d) for n in own.values()) / seen, 1e-6) if seen else 1.0
        return max((own.get(w, 0) if w in index else 0) - d, 0) / max(seen, 1) + back * low(c, w)

    for text in [rows[3][1], rows[4][1], "w1 w2 new w3", "new", "w5"]:
        ws = text.split()
        first = math.log(low(1, ws[0]) / low(0, ws[0]))
        expect = (first + sum(math.log(pair(1, v, w) / pair(0, v, w)) for v, w in zip(ws, ws[1:], strict=False))) / len(ws)
        assert abs(model.features([text])[0, 0] - expect) < 1e-4, text


def test_toxicity_of_empty_repeated_and_long_texts(spark):
    kind = "doc_id long, text string"
    rows = [(k, ("vile words here now " if k % 2 else "calm words there then ") * 3 + f"x{k}") for k in range(80)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    odd = [(100, None), (101, ""), (102, "?!"), (103, "calm words there then " * 20_000), (7, rows[7][1]), (7, rows[7][1]), (None, rows[1][1])]
    got = [tuple(r) for r in toxicity.toxicity(spark.createDataFrame(rows + odd, kind), labels).collect()]
    assert len(got) == len(rows) + len(odd) and len({r for r in got if r[0] == 7}) == 1 and all(0 <= r[2] <= 1 for r in got)
    assert len({r[2] for r in got if r[0] in (100, 101, 102)}) == 1
    assert toxicity.toxicity(spark.createDataFrame([], kind), labels).count() == 0


def test_tables_give_what_the_convolution_gives():
    net = language_id.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(4)
    for p in net.p.values():
        p += rng.normal(0, 0.3, p.shape)
    texts = ["some plain text", "x", "äöü 漢字 " * 90, "12 34", None, ""]
    names, scores = language_id.predict(net.classes, *net.tables(), net.p["out"].astype(np.float32), net.p["bias"].astype(np.float32), texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        total = np.zeros(3)
        for window in language_id.windows([text.encode()])[0]:
            e = net.p["emb"][window]
            pooled = []
            for k in language_id.WIDTHS:
                places = range(language_id.LENGTH - language_id.SPAN + 1)
                z = np.array([sum(e[i + j] @ net.p[f"w{k}"][j] for j in range(k)) + net.p[f"b{k}"] for i in places])
                pooled.append(np.maximum(z.max(axis=0), 0))
            logits = np.concatenate(pooled) @ net.p["out"] + net.p["bias"]
            soft = np.exp(logits - logits.max())
            total += soft / soft.sum() * np.count_nonzero(window)
        total /= total.sum()
        assert name == net.classes[int(total.argmax())] and abs(score - total.max()) < 1e-4


def test_language_of_empty_long_and_clashing_tables(spark):
    rng = random.Random(5)
    kinds = {"aa": "the and ing tion".split(), "bb": "der ung ich sch".split()}
    rows = [(k, " ".join("".join(rng.choices(kinds[v], k=2)) for _ in range(30)), v, 0.5, "own") for k in range(120) for v in [rng.choice(["aa", "bb"])]]
    rows += [(500, "the and tion " * 30_000, None, 0.1, "own"), (501, "der ung", None, None, None), (501, "der ung", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] == 500} == {"aa"} and len({tuple(r) for r in got if r["doc_id"] == 501}) == 1
    assert language_id.language_id(docs.limit(0)).count() == 0
    carried = language_id.identify(docs, language_id.train(docs))
    assert carried.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
