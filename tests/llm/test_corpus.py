"""Suffix-array dedup, lexical search and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from safesheet.llm import importance_resampling, lexical_search, suffix_dedup
from safesheet.llm.common import numbered
from safesheet.llm.terms import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, score string, n long, late int, id string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without id"), (4, "same row twice."), (4, "same row twice."), (5, "Word " * 3_000), (6, "ÄÖ ß 漢字 🙂\r\nend\n\n"), (2**62 + 5, "a text of a large id"), (-7, "WORD word wOrd")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, 7, "own", 5, 1, "x") for d, t in rows], DOCS)


# 12


def brute_repeats(rows, width=50):
    """(n_bytes, kept, spans) of each row."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for k in range(len(b) - width + 1):
            if d is not None:
                w = b[k : k + width]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        cover = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - width + 1):
            f = first.get(b[k : k + width])
            if f is not None and (d is None or f < d):
                cover[k : k + width] = True
        n = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((d, len(b), n, bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


def passages(rng, n, alphabet="abcdefgh   "):
    """Texts made of shared pieces, so that strings of 50 bytes repeat at all offsets."""
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 140))) for _ in range(25)] + ["x" * 200, "ab" * 80, "é" * 60, "\0" * 70, "q\0" * 50]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else p)
            if rng.random() < 0.5:
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))))
        rows.append("".join(parts))
    return rows


def merged_parts(rows, run_sizes, n_parts, split):
    """What the tasks do, in one process: the (id, row, start, end) that go."""
    rng = random.Random(3)
    rows = [(d, t, k) for k, (d, t) in enumerate(rows)]
    rng.shuffle(rows)
    every = np.full(1 << suffix_dedup.BITS - 6, np.iinfo(np.uint64).max, dtype=np.uint64)
    by_part, found, at = defaultdict(list), [], 0
    while at < len(rows):
        n = rng.choice(run_sizes)
        mine = rows[at : at + n]
        at += n
        late, key = np.array([d is None for d, _, _ in mine]), np.array([d or 0 for d, _, _ in mine], dtype=np.int64)
        got = list(suffix_dedup.suffixes([(t or "").encode() for _, t, _ in mine], late, key, np.array([k for _, _, k in mine], dtype=np.int64), every))
        if not got:
            continue
        s = suffix_dedup.joined(got)
        if split:
            s = suffix_dedup.strings(s)
        s, part, gone = suffix_dedup.in_order(s, n_parts)
        gone_part = ((gone.hash >> np.uint64(suffix_dedup.PLACE)) % np.uint64(n_parts)).astype(np.int32)
        for p, body in suffix_dedup.front_coded(s, part, gone, gone_part):
            by_part[p].append(body)
    for bodies in by_part.values():
        runs = [suffix_dedup.decoded(b) for b in bodies]
        for own, cut, texts, _, gone in runs:
            assert texts == sorted(texts)
            for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
                assert a[: cut[k + 1]] == b[: cut[k + 1]] and a[cut[k + 1] : cut[k + 1] + 1] != b[cut[k + 1] : cut[k + 1] + 1] or a == b
            found += [(int(r), int(a), int(a) + int(x) + int(z)) for r, a, x, z in zip(gone["row"], gone["at"], gone["before"], gone["size"], strict=True)]
        order, common = suffix_dedup.merged([r[2] for r in runs], [r[1] for r in runs])
        nth, out = Counter(), []
        for r in order:
            out.append(runs[r][2][nth[r]])
            nth[r] += 1
        assert out == sorted(out) and len(out) == sum(len(r[2]) for r in runs)
        for a, b, c in zip(out, out[1:], common[1:], strict=False):
            assert a[:c] == b[:c] and (a == b or a[c : c + 1] != b[c : c + 1])
        of = np.array(order)
        place = np.empty(len(of), dtype=np.int64)
        place[np.argsort(of, kind="stable")] = np.arange(len(of))
        own = {k: np.concatenate([r[0][k] for r in runs])[place] for k in runs[0][0]}
        for s, a, z in suffix_dedup.repeats(np.array(common), np.concatenate([r[3] for r in runs])[place], own):
            found += [(int(own["row"][k]), int(x), int(y)) for k, x, y in zip(s, a, z, strict=True)]
    return found


@pytest.mark.parametrize(("seed", "split"), [(1, False), (2, False), (3, True)])
def test_merged_suffixes_find_what_brute_force_finds(seed, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 300)  # texts cut into pieces
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(30)]), t) for t in passages(rng, 120)]
    cover = defaultdict(set)
    for row, a, z in merged_parts(rows, [1, 5, 30], 3, split):
        cover[row] |= set(range(a, z))
    for k, (_, n, _, kept) in enumerate(brute_repeats(rows)):
        text = (rows[k][1] or "").encode()
        assert bytes(x for j, x in enumerate(text) if j not in cover[k]) == kept, (k, rows[k], n)


def removed(spark, rows, **more):
    got = suffix_dedup.suffix_dedup(frame(spark, rows), **more).collect()
    assert all(len(r["kept"]) + sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] for r in got)
    return sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got), key=repr)


@pytest.mark.parametrize("hot", [2, 10**6])
def test_suffix_dedup_matches_brute_force(spark, hot):
    rng = random.Random(9)
    rows = [(k if rng.random() < 0.9 else rng.choice([None, 3, 2**62 + k]), t) for k, t in enumerate(passages(rng, 150))] + ODD
    rows += [rows[5], rows[7], (10**6, rows[9][1]), (None, rows[9][1]), (None, rows[9][1])]
    assert removed(spark, rows, hot_least=hot) == sorted(brute_repeats(rows), key=repr)


def test_suffix_dedup_of_odd_tables(spark):
    assert removed(spark, []) == []
    assert removed(spark, ODD) == sorted(brute_repeats(ODD), key=repr)
    with pytest.raises(TypeError):
        suffix_dedup.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# 11


def brute_search(rows, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_all = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, k + 1, None if late else d, -s) for k, (s, late, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_search_matches_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdÄ漢" for b in "xyz0189"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(80)] + ODD
    rows += [(1000 + k, "ax ax ay") for k in range(60)] + [(None, "ax ax ay"), (1000, "ax ax ay")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8)))) for k in range(12)]
    items += [(50, "ax AX ay"), (50, "word"), (None, "end text"), (51, None), (52, ""), (53, "nowhere")]
    got = lexical_search.search(frame(spark, rows), spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, score long"), top=5, block_bytes=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(rows, items, 5)


def test_search_of_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs, queries in ((none, items), (none, items.limit(0)), (frame(spark, ODD), items.limit(0)), (frame(spark, [(1, None), (2, "..")]), items)):
        found = lexical_search.search(docs, queries)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_search_by_other_ids(spark):
    docs = spark.createDataFrame([("b", "red fish"), ("a", "red fish"), ("c", "blue"), (None, "red fish")], "doc_id string, text string")
    got = lexical_search.search(docs, spark.createDataFrame([("q", "red fish")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, "a"), (2, "b"), (3, None)]


def test_radix_order_and_sums():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 41, 5000)
    assert (radix := lexical_search.radix_order(keys, 41)).tolist() == np.argsort(keys, kind="stable").tolist() and len(radix) == 5000
    item, doc, impact = rng.integers(0, 7, 3000), rng.integers(0, 70_000, 3000), rng.integers(0, 9, 3000)
    want = Counter()
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
        want[i, d] += x
    got = lexical_search.summed(item, doc, impact, 70_000)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


# 13


def brute_resample(rows, target, n, size, share, least, seed):
    def found(text):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % size for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    docs = [(d, *found(t)) for d, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for text in target for b in found(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in s}
    out = []
    for d, n_words, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_matches_brute_force(spark, n):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdÄ漢" for b in "xyz01"]
    rows = [(k, rng.choice([" ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(120)] + ODD + [(7, "ax ay az " * 4)] * 3
    target = [None, "", "ax ay AX", "漢x word ß"]
    got = importance_resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n=n, size=97, share=40, min_words=6, seed=11).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_resample(rows, target, n, 97, 40, 6, 11)


def test_resampling_of_empty_tables(spark):
    none, items = frame(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance_resampling.resample(none, items).collect() == []
    assert len(importance_resampling.resample(frame(spark, ODD), items.limit(0)).collect()) == len(ODD)


def test_ring_gives_the_codes_of_all_runs():
    text = "The cat, THE hat 12é".encode()
    for n in (1, 2, 4):
        ring, got = importance_resampling.Ring(n), []
        for part in ([b"the"], [b"cat", b"the"], [b"hat", "12é".encode()]):
            got += ring.feed(part)
        w = [b"the", b"cat", b"the", b"hat", "12é".encode()]
        assert [x for p in words(text) for x in p] == w
        assert sorted(got) == sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1))


def test_words_of_long_texts_come_in_parts(monkeypatch):
    from safesheet.llm import terms

    monkeypatch.setattr(terms, "PART", 10)
    parts = list(words(b"one two three four five six seven" * 3))
    assert len(parts) > 3 and [w for p in parts for w in p] == (b"one two three four five six seven" * 3).split()


def test_numbered_rows_of_ties_and_many_partitions(spark):
    rows = spark.range(3000).selectExpr("id % 7 as a", "'x' as b").repartition(9)
    got, n = numbered(rows, [rows["a"].desc()], "place")
    got = got.orderBy("place").collect()
    assert n == 3000 and [r["place"] for r in got] == list(range(1, 3001)) and [r["a"] for r in got] == sorted((r["a"] for r in got), reverse=True)


# 4


def test_substring_spans_of_large_and_missing_ids(spark):
    from safesheet.llm import substring_dedup

    text = " ".join(f"w{k}" for k in range(40))
    big = 2**62 + 7
    rows = [(5, text), (big, text + "\nown"), (-(2**63), "x\n" + text.upper()), (None, text), (None, text + "\nlast"), (2**63 - 1, "own")]
    spans = substring_dedup.removable_spans(frame(spark, rows))
    assert {r["doc_id"] for r in spans.collect()} == {5, big, None, 2**63 - 1}
    left = {(r["doc_id"], r["text"]) for r in substring_dedup.remove_spans(frame(spark, rows), spans).collect()}
    assert {(d, t.strip()) for d, t in left} == {(5, ""), (big, "own"), (-(2**63), ("x\n" + text.upper()).strip()), (None, ""), (None, "last"), (2**63 - 1, "")}
