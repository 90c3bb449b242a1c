"""Edge cases and brute-force comparisons of the operators of safesheet.llm."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from safesheet.llm import bpe, decontamination, language_id, line_dedup, ngram_join, quality_rules, shingles, substring_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, n long"



def frame(spark, rows, source="s"):
    """(doc_id, text) or (doc_id, text, source) rows with further columns, whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else source, 0, "own", 5) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without id"), (4, "same row twice."), (4, "same row twice."), (5, "word " * 30_000), (6, "ÄÖ ß 漢字 🙂\r\nend\n\n")]


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()) + rng.choice("abcdefg") for _ in range(n)]


# 2


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(1)
    rows = list(ODD)
    for k in range(10, 40):
        w = words(rng, rng.randint(0, 60))
        rows.append((k, " ".join(w + ["#x", "|"] * rng.randint(0, 2) + w[5:20] * rng.randint(0, 3)) + "\n a\n\na\na" * rng.randint(0, 2)))
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        r = by_id[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(text), doc_id
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_quality_rejects_depleted_documents_of_a_host_only(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(22))
    menu = " ".join(f"menu{i}" for i in range(30))
    rows = [(k, f"{body(k)}\n{menu.upper() if k % 2 else menu}", "a") for k in range(12)] + [(100 + k, f"{body(100 + k)}\n{menu}", "b") for k in range(3)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert all(not got[k]["kept"] and got[k]["n_lost_words"] == 30 for k in range(12))
    assert all(got[100 + k]["kept"] and got[100 + k]["n_lost_words"] == 0 for k in range(3))


def test_quality_verdict_is_each_rows_own(spark):
    menu = " ".join(f"menu{i}" for i in range(10))
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(15)) + "\n" + menu
    rows = [(k, text(k), "a") for k in range(12)] + [(0, text(0), "a"), (1, menu + "\n" + menu + "\n" + menu, "a"), (None, text(50), "a")]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["n_lost_words"] for r in got) == [10] * 14 + [30]
    assert all(r["kept"] for r in got if r["n_lost_words"] == 10)
    assert quality_rules.quality_rules(frame(spark, rows).limit(0)).count() == 0


def test_quality_cleans_lines_over_the_limits(spark):
    rows = [(k, f"own {k}\n{'  MENU one' if k % 2 else 'menu  one'}\n\nend {k}", "a") for k in range(12)] + [(100, "menu one\nx", "b"), (101, "menu one\nx", None), (102, None, "a")]
    got = {r["doc_id"]: r for r in quality_rules.cleaned(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k]["text"] == f"own {k}\n\nend {k}" and got[k]["line"] == "own" for k in range(12))
    assert got[100]["text"] == got[101]["text"] == "menu one\nx" and got[102]["text"] is None


# 9


def test_line_dedup_by_host_ratio(spark):
    rows = [(k, f"menu\nown {k}\n\n  menu  ", "a") for k in range(6)] + [(10 + k, f"menu\nown {k}", None) for k in range(2)] + [(20, None, "a"), (21, "", "a")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, rows), max_ratio=0.5, min_pages=3).collect()}
    assert got[0]["text"] == "own 0\n" and (got[0]["n_lines"], got[0]["n_dropped"]) == (3, 2)
    assert got[10]["text"] == "menu\nown 0" and got[20]["text"] is None and got[21]["text"] == ""
    assert got[0]["line"] == "own" and got[0]["n"] == 5


def test_line_dedup_keeps_every_row(spark):
    df = frame(spark, ODD)
    got = Counter(r["text"] for r in line_dedup.line_dedup(df).collect())
    assert got == Counter("" if t == "same row twice." else t for _, t in ODD)  # on two of eight pages
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_goes_by_the_ratio_on_hosts_of_any_size(spark):
    rows = [(1, "alone\nhere", "one")] + [(10 + k, f"menu\nown {k}", "two") for k in range(2)] + [(20 + k, ("menu\n" if k < 10 else "") + f"own {k}", "many") for k in range(100)] + [(200 + k, ("menu\n" if k < 11 else "") + f"own {k}", "more") for k in range(100)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[1] == "alone\nhere" and got[10] == "own 0" and got[20] == "menu\nown 0" and got[200] == "own 0"


# 8


def brute_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filters_match_brute_force(spark):
    urls = [
        None, "", "example.com/en/", "http://", "http://example.com", "http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/", "http://a.www.example.com/en/x", "http://example.com/fr/", "http://x.net/es/9",
        "http://notexample.com/en/", "http://net/fr/", "http://a.b.net/fr", "http://a.net?://b.com/", "x://y://example.com/en/", "http://éx.COM/\nen", "http://example.com/en/#", "http://.com/", "http://com./", "http://example.com/en/1?x#y",
    ]
    pages = spark.createDataFrame([(k if k != 3 else None, u, "h", "rule") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = url_filters.url_filters(pages, url_filters.rules_frame(spark)).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted((str(k if k != 3 else None), h, p, str(x), v) for k, u in enumerate(urls) for h, p, x, v in [brute_url(u)])
    none = url_filters.url_filters(pages, url_filters.rules_frame(spark).limit(0)).collect()
    assert len(none) == len(urls) and {r["verdict"] for r in none} == {"allow"}


# 10


@pytest.fixture(scope="module")
def public():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference_encoding(public):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public[1], mergeable_ranks=bpe.read_ranks(public[0]), special_tokens={})


def test_bpe_equals_the_library(public, reference_encoding):
    rng = random.Random(3)
    texts = ["", "a", "aaaa" * 50, "hello world's 123 <|endoftext|>", "x" * 3000, " \n\n \t  y", "é漢字🙂 \x1c\x85\xa0z\u200b", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(4000)), "ab" * 4100]
    texts += ["".join(rng.choice("abcdeéñ .,'\n") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    codec = bpe.Codec(bpe.read_ranks(public[0]), public[1])
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == reference_encoding.encode_ordinary(t), t[:40]
        assert codec.decode(ids) == t.encode()
    pieces = [t.encode()[:60] for t in texts if len(t) > 1]
    assert codec.merge_many(pieces) == [np.array(codec.merge_one(p), dtype="<u4").tobytes() for p in pieces]


def test_bpe_of_two_vocabularies_alike_in_size(spark, tmp_path):
    import base64

    pattern = r"\w+|\W+"
    for name, pair in (("one", b"ab"), ("two", b"cd")):
        (tmp_path / name).write_text("".join(f"{base64.b64encode(b).decode()} {k}\n" for k, b in enumerate([*(bytes([k]) for k in range(256)), pair])))
    docs = frame(spark, [(1, "ab"), (2, "cd"), (3, None)]).coalesce(1)
    for name, expect in (("one", {1: [256], 2: [99, 100], 3: []}), ("two", {1: [97, 98], 2: [256], 3: []}), ("one", {1: [256], 2: [99, 100], 3: []})):
        got = bpe.decode(bpe.encode(docs, str(tmp_path / name), pattern), str(tmp_path / name)).collect()
        assert {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in got} == expect and sorted(bytes(r["decoded"]) for r in got) == [b"", b"ab", b"cd"]
    assert bpe.encode(docs.limit(0), str(tmp_path / "one"), pattern).count() == 0


def test_bpe_round_trip_of_odd_rows(spark, public):
    got = bpe.decode(bpe.encode(frame(spark, ODD), *public), public[0]).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in ODD)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert Counter(map(tuple, bpe.round_trip(frame(spark, ODD), *public).collect())) == Counter(map(tuple, got))


# 5


def brute_tokens(token, scores, fallback):
    best = {0: (0.0, 0)}
    for end in range(1, len(token) + 1):
        size = len(token[end - 1].encode())
        options = [(best[end - 1][0] + fallback * size, -best[end - 1][1] - size)]
        options += [(best[s][0] + scores[token[s:end]], -best[s][1] - 1) for s in range(end) if token[s:end] in scores]
        v, n = max(options)
        best[end] = (v, -n)
    return best[len(token)][1]


def test_token_counts_match_brute_force(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.zipf_scores(token_counts.read_pieces(path))
    rng = random.Random(5)
    rows = list(ODD) + [(k, " ".join("".join(rng.choice("thenigorsaé漢") for _ in range(rng.randint(1, 14))) for _ in range(30))) for k in range(50, 60)]
    trie = token_counts.Trie(scores)
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    expect = Counter()
    for doc_id, text in rows:
        own = (text or "").split()
        expect[doc_id, sum(brute_tokens("▁" + w, scores, trie.fallback) if len(own) < 1000 else trie.insert("▁" + w) for w in own), len(own)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_pretokens"]) for r in got) == expect


def test_token_counts_of_words_with_the_mark(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "▁a"), (2, "▁a a"), (3, "a ▁a ▁▁a")]
    scores = token_counts.zipf_scores(token_counts.read_pieces(path))
    fallback = token_counts.Trie(scores).fallback
    got = token_counts.token_counts(frame(spark, rows).coalesce(1), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: sum(brute_tokens("▁" + w, scores, fallback) for w in t.split()) for d, t in rows}
    assert token_counts.token_counts(frame(spark, rows).limit(0), path).count() == 0


def test_trie_equals_a_library_unigram_model():
    import public_tokenizers
    from tokenizers import Tokenizer, models

    scores = token_counts.zipf_scores(token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], 0, False))
    trie = token_counts.Trie(scores)
    rng = random.Random(6)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("thenigorsa") for _ in range(rng.randint(1, 16)))
        assert trie.insert(w) == len(model.encode(w).ids), w


# 3


def test_language_id_learns_and_generalises(spark):
    rng = random.Random(4)
    kinds = {"aa": "the and ing tion ly".split(), "bb": "der ung ich sch keit".split(), "cc": "ción ado ñ os ará".split()}
    rows = [(k, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(40)), lang, "s", 0, "own", 1) for k, lang in ((k, rng.choice(list(kinds))) for k in range(300))]
    rows += [(1000, None, "aa", "s", 0, "", 1), (1001, "123 ... \n", "bb", "s", 0, "", 1), (1002, "", None, None, None, None, None), (None, rows[0][1], rows[0][2], "s", 0, "", 1)]
    got = language_id.language_id(spark.createDataFrame(rows, DOCS)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.95 * len(own)
    assert {r["lang_pred"] for r in language_id.language_id(spark.createDataFrame(rows, DOCS).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}


def test_language_windows_cover_every_run_of_bytes():
    for n in (0, 1, 191, 192, 193, 381, 1000):
        raw = bytes(1 + k % 255 for k in range(n))
        x, of = language_id.windows([raw, b"z"])
        own = [bytes(r) for r, o in zip(x, of, strict=True) if o == 0]
        assert all(any(raw[i : i + 4] in w for w in own) for i in range(max(0, n - 3)))


# 1


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(2)
    bad = ["vile", "scummy", "moronic", "rotten"]
    docs, labels = [(9000, None), (9001, ""), (None, "text")], [(9000, 1, None), (9001, 1, 0), (None, 1, 1)]
    for k in range(600):
        toxic = k % 4 == 0
        w = words(rng, 60)
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    got = toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    none = toxicity.toxicity(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(docs) and {r["score"] for r in none} == {0.0}


# 6


def test_streams_equal_texts():
    rng = random.Random(8)
    texts = ["Tom has 3.5 km, 20 % and Day\nÄpfel ² Hour 漢", "3 Hours AND €5 _x 3-4 * 5 - x", ""]
    texts += ["".join(rng.choice(["Tom ", "Ann ", "has ", "3 ", "3.5", "km ", "Day", "% ", "€", ". ", ", ", "\n", "_", "Äpfel ", "²", "x", " ", "漢", "Hour ", "- ", "+"]) for _ in range(30)) for _ in range(300)]
    (template, of), (literal, _) = decontamination.Tokens().streams(texts)
    owns = [decontamination.Text(t) for t in texts]
    assert template.tolist() == decontamination.codes([x for o in owns for x in o.template]).tolist()
    assert literal.tolist() == decontamination.codes([x for o in owns for x in o.values]).tolist()
    assert of.tolist() == [k for k, o in enumerate(owns) for _ in o.template]
    for t, o in zip(texts, owns, strict=True):
        assert [t[a:b].lower() for a, b in o.spans] == o.values


def brute_items(rows, items):
    """Every window of every item against every window of every document, by their tokens."""
    out = set()
    for (d, text), (i, item) in itertools.product({r for r in rows if r[1]}, {r for r in items if None not in r}):
        own, its, found = decontamination.Text(text), decontamination.Text(item), []
        for kind, width, at in decontamination.item_windows(item):
            stream = own.template if kind == decontamination.TEMPLATE else own.values
            for pos in range(len(stream) - width + 1):
                if stream[pos : pos + width] == its.tokens(kind, at, width):
                    (a, z), (first, after) = its.reach(kind, at, width), own.reach(kind, pos, width)
                    slots = (its.slots(at, width), own.slots(pos, width)) if kind == decontamination.TEMPLATE else ([], [])
                    found.append({"first": first, "after": after, "at": a, "to": z, "start": own.spans[first][0], "end": own.spans[after - 1][1], "item_slots": slots[0], "slots": slots[1]})
        if (got := decontamination.judge(found, len(its.values))) is not None:
            out.add((d, i, *got))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(17)
    item = lambda: " ".join(rng.choice([*words(rng, 6), "Tom", "Ann Lee", "3", "4.5", "12 km", "+", "7 * 8", "He"]) + rng.choice(["", "", "", ".", ",", "?"]) for _ in range(rng.randint(1, 30)))
    items = [(k, item()) for k in range(25)] + [(90, "12 + 45 * 3 - 7 / 2 = 18 or 19"), (91, "Who?"), (None, item()), (92, None)]
    rows = list(ODD)
    for k in range(100, 180):
        text = rng.choice([t for _, t in items if t])
        if rng.random() < 0.5:
            text = re.sub(r"\d+", lambda m: m.group() + "1", text).replace("Tom", "Max").replace("Ann Lee", "Eve")
        if rng.random() < 0.2:
            text = re.sub(r"\d+", lambda m: str(rng.randint(1, 99)), text)
        cut = rng.choice([0, 0, len(text) // 3])
        rows.append((k, " ".join(words(rng, 9)) + rng.choice([" ", ". "]) + text[cut:] + " " + " ".join(words(rng, 9))))
    got = decontamination.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    expect = brute_items(rows, items)
    assert {(r["doc_id"], r["item_id"], r["n_found"], r["start"], r["end"], r["slots"]) for r in got} == expect and len(expect) > 20
    assert len(got) == len(expect)


def test_decontamination_of_numbers_names_and_short_items(spark):
    items = [("a", "compute 12 + 45 * 3 - 7 / 2 = 18 or 19"), ("b", "Tom Smith gave the bank 3 dollars, then Tom Smith gave the shop 9 dollars more"), ("c", "Yes no")]
    rows = [("x", "so compute 12 + 45 * 3 - 7 / 2 = 18 or 19 now"), ("y", "here Bob gave the bank 5 dollars, then Bob gave the shop 8 dollars more"), ("z", "so yes no maybe"), ("w", "compute 12 + 45 then yes"), ("x", "other")]
    docs, bench = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, bench).collect()) == [("x", "a"), ("y", "b"), ("z", "c")]
    assert sorted(tuple(r) for r in decontamination.decontaminate(docs, bench).collect()) == [("w", rows[3][1]), ("x", "other")]
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0 and decontamination.find_items(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_copies_and_new_parameters(spark):
    items = [
        (1, "If Tom has 3 apples and buys 4 more apples for 2 dollars each, how many apples does he have when he gives 3 to Ann?"),
        (2, "zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups alpha beta gamma delta"), (3, "too few words"), (4, None), (None, "x y z"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    again = "say if Mary has 5 apples and buys 7 more apples for 9 dollars each, how many apples does he have when he gives 5 to Bob? And so on"
    other = "well how many apples does he have when he asks whether Tom has 3 apples and buys plums"
    rows = [(1, "before that " + items[0][1] + " after that"), (2, again), (3, "x " * 400 + items[1][1].upper().lower() + " y" * 9), (4, "nothing of it but apples and zeta eta theta iota kappa"), (5, None), (6, ""), (7, again), (7, again), (8, other)]
    got = decontamination.find_items(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (3, 2), (7, 1)]
    slots = next(r["slots"] for r in got if r["doc_id"] == 2)
    assert "3=5" in slots and "ann=bob" in slots
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(frame(spark, rows), bench).collect()) == [4, 5, 6, 8]
    assert decontamination.find_items(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_wants_consistent_slots():
    items = [(1, "there are 3 red balls and then 3 blue balls and 4 green balls in the box")]
    assert brute_items([(1, "well there are 8 red balls and then 8 blue balls and 9 green balls in the box")], items)
    assert not brute_items([(1, "well there are 8 red balls and then 7 blue balls and 8 green balls in the box")], items)


def test_decontamination_finds_copies_whatever_their_kind_of_tokens(spark):
    long = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)).replace("word", "w")
    items = [
        (1, "Compute 12 + 7, 15 + 9, 20 + 31, 44 + 5 and 18 + 3 now."), (2, "What is the capital city of the country Peru?"),
        (3, "When Ann Lee and Bob Ray met Cy Fox in Rome and Oslo they saw Dan Poe and Eve Orr"), (4, long), (5, "12 13 14 15 16"),
    ]
    own = long.split()
    rows = [
        (1, f"see {items[0][1]} then"), (2, "answer this What is the capital city of the country Peru? Well"), (3, "answer this What is the capital city of the country Chile? Well"),
        (4, f"so {items[2][1].lower()} there"), (5, "so " + " ".join(own[20:33]) + " there"), (6, "so " + " ".join(own[20:32]) + " there"), (7, "x 12 13 14 15 16 y"),
        (8, "Compute 13 + 7, 16 + 9, 21 + 31, 45 + 5 and 19 + 3 then."), (9, " ".join(own[:12]) + " no " + " ".join(own[12:20])),
    ]
    found = decontamination.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (7, 5)]
    assert {r["doc_id"]: (r["n_found"], r["slots"]) for r in found if r["doc_id"] in (2, 3, 4)} == {2: (9, ""), 3: (9, "peru=chile"), 4: (20, "")}


# 7


def brute_join(rows, width=5, t=0.8):
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets[frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else doc_id].append(doc_id)
    reps = {min(v): (k, len(v)) for k, v in sets.items()}
    parent = {r: r for r in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in itertools.combinations([r for r in reps if isinstance(reps[r][0], frozenset)], 2):
        x, y = reps[a][0], reps[b][0]
        if 10 * len(x & y) >= 8 * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d: (find(min(v)), min(v), len(v), links[min(v)]) for v in sets.values() for d in v}


@pytest.mark.parametrize("block", [400, 3])
def test_ngram_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LIGHT_BLOCK", 2 * block)
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "One, two!"), (6, "one two three")]
    k = 10
    for _ in range(8):
        base = words(rng, 120)
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((k, " ".join(w)))
            k += 1
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute_join(rows)
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(frame(spark, [*rows, (None, "one two")])).collect() if r["doc_id"])
    assert kept == sorted({v[0] for v in brute_join(rows).values()})


def test_keep_one_keeps_a_row_of_each_class_of_texts(spark):
    a, b, z = ("one two three four five six seven", "eight nine ten eleven twelve", "eight nine ten eleven twelve z")
    rows = [(1, a), (5, a), (5, b), (7, z), (9, a), (9, a), (3, z), (3, z), (None, b), (None, "only here"), (None, "only here"), (8, None), (8, ""), (8, None)]
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame(spark, rows)).collect())
    assert got == Counter([(1, a), (5, b), (3, z), (None, "only here"), (8, None), (8, ""), (8, None)])
    named = spark.createDataFrame([("x", a), ("y", a), ("y", b), (None, b)], "doc_id string, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_copies"]) for r in ngram_join.ngram_join(named).collect() if r["doc_id"]) == [("x", "x", 2), ("y", "x", 2), ("y", "y", 2)]
    assert sorted(map(tuple, ngram_join.keep_one(named).collect())) == [("x", a), ("y", b)]


def test_ngram_join_finds_the_links_of_a_whole_table(spark):
    """Recall on the supplied table, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    expect = brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])
    links = sum(v[3] for v in expect.values())
    assert sum(got[k][3] for k in expect) >= 0.95 * links and {k: v[1:3] for k, v in got.items()} == {k: v[1:3] for k, v in expect.items()}


def test_ngram_join_of_odd_rows(spark):
    got = ngram_join.ngram_join(frame(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ODD)
    assert all(r["n_copies"] == (2 if r["doc_id"] == 4 else 1) for r in got)
    assert ngram_join.ngram_join(frame(spark, ODD).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)], "u long, v long")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 150: 100, 200: 100}


def test_bands_reach_the_recall():
    b, r = ngram_join.plan_bands(0.8, 0.999, 128)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(7)]
    both = ngram_join.intersections(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7) for j in range(7) if i != j)


# 4


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def word_code(word):
    return mix((sum(mix(ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(word)) + len(word)) % (1 << 64))


def brute_units(text):
    """(first word, word after, kind, normalised) of each unit, from the text's words; larger ones first at each place."""
    words = [(m.start(), m.group().lower()) for m in re.finditer(r"\S+", text)]
    line = [text.count("\n", 0, a) for a, _ in words]
    n, out = len(words), []

    def add(i, j, kind):
        own = [w for _, w in words[i:j]]
        if kind != "chunk" and (j - i > 1 or own[0].strip(".!?")):
            own[-1] = own[-1].rstrip(".!?")
        out.append((i, j, kind, (kind == "chunk", " ".join(own).strip())))

    starts = lambda new: [(i, next((j for j in range(i + 1, n) if new(j)), n)) for i in range(n) if i == 0 or new(i)]
    lines = starts(lambda k: line[k] > line[k - 1])
    paragraphs = starts(lambda k: line[k] > line[k - 1] + 1)
    for i, j in lines:
        add(i, j, "line")
    for i, j in paragraphs:
        if line[i] != line[j - 1]:
            add(i, j, "paragraph")
    if len(paragraphs) > 1:
        add(0, n, "text")
    for i, j in starts(lambda k: line[k] > line[k - 1] or words[k - 1][1][-1] in ".!?"):
        if (i, j) not in lines and (j - i > 1 or words[i][1].strip(".!?")):
            add(i, j, "sentence")
    low = [word_code(w) for _, w in words]
    raw = [k > 0 and ((low[k - 1] * 0x9E3779B97F4A7C15 + low[k] * 0xD6E8FEB86659FD93) % (1 << 64) >> 32) % 4 == 0 for k in range(n)]
    cuts = [k for k in range(n) if raw[k] and not any(raw[max(0, k - 2) : k])]
    for i, j in zip(cuts, cuts[1:], strict=False):
        add(i, j, "chunk")
    return sorted(out, key=lambda u: (u[0], -u[1]))


def brute_gone(rows, least):
    """(doc_id, text, word) of every word that goes."""
    first, out = {}, set()
    order = lambda r: (r[0] is None, r[0] or 0, "")
    texts = sorted({r for r in rows if r[1]}, key=order)
    for doc_id, text in texts:
        for u in brute_units(text):
            first.setdefault(u[3], (doc_id, text, u[0]))
    for doc_id, text in texts:
        repeats = [u for u in brute_units(text) if first[u[3]][0] != doc_id or first[u[3]][1] == text and first[u[3]][2] != u[0]]
        cover = {k for u in repeats for k in range(u[0], u[1])}
        run = lambda k: next(j for j in itertools.count(k) if j not in cover) - next(j for j in itertools.count(k, -1) if j not in cover) - 1
        out |= {(doc_id, text, k) for u in repeats for k in range(u[0], u[1]) if u[2] in ("line", "paragraph", "text") or run(k) >= least}
    return out


def gone_words(rows, spans):
    out = set()
    texts = {r for r in rows if r[1]}
    for r in spans:
        owners = [t for d, t in texts if d == r["doc_id"] and t[r["start"] : r["end"]].strip() and len(t[r["start"] : r["end"]].split()) == r["n_words"]]
        text = owners[0] if len(owners) == 1 else next(t for t in owners if row_digest(t) == r["row"])
        at = len(text[: r["start"]].split())
        out |= {(r["doc_id"], text, k) for k in range(at, at + r["n_words"])}
    return out


def row_digest(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def test_substring_units_match_brute_force():
    rng = random.Random(14)
    pieces = ["word", "Word.", "two", "three!", "...", "?", "\n", "\n\n", " \n \n", "ä", "İx", "漢字.", "3.5", "a.b", "end?!", "\u00a0", "\x1c", "\t", "🙂.", "\uffff"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    of, *whole, digests = substring_dedup.all_units(texts)
    keys = defaultdict(set)
    assert len(substring_dedup.all_units([""])[0]) == 0 == len(substring_dedup.all_units([])[0])
    for k, text in enumerate(texts):
        start, end, first, after, kind, again = (c[of == k] for c in whole)
        digest = digests[:, of == k]
        expect = brute_units(text)
        names = {"chunk": substring_dedup.CHUNK, "sentence": substring_dedup.SENTENCE}
        assert sorted(zip(first.tolist(), after.tolist(), kind.tolist(), strict=True)) == sorted((i, j, names.get(k, substring_dedup.WHOLE)) for i, j, k, _ in expect), text
        low = [w.lower() for w in text.split()]
        norms = {(i, j, names.get(k, substring_dedup.WHOLE)): norm for i, j, k, norm in expect}
        for a, z, i, j, k, h1, h2 in zip(start.tolist(), end.tolist(), first.tolist(), after.tolist(), kind.tolist(), *digest.tolist(), strict=True):
            assert text[a:z].split() == text.split()[i:j]
            keys[norms[i, j, k]].add((h1, h2))
            assert text.lower().split()[i:j] == low[i:j]
        seen = [norms[x] for x in zip(first.tolist(), after.tolist(), kind.tolist(), strict=True)]
        assert again.tolist() == [x in seen[:m] for m, x in enumerate(seen)]
    assert all(len(v) == 1 for v in keys.values()) and len(set(map(tuple, keys.values()))) == len(keys)
    long = ["z" * 400, "Z" * 400 + ".", "y" * 400]
    assert len({tuple(h) for h in substring_dedup.all_units(long)[-1].T.tolist()}) == 2


def test_substring_dedup_of_repeated_rows_ids_and_nulls(spark):
    row = " ".join(f"w{k}" for k in range(40))
    rows = [(1, row), (1, row), (2, row), (None, row), (None, row), (None, "x\n" + row)]
    spans = substring_dedup.removable_spans(frame(spark, rows))
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept_doc_id"]) for r in spans.collect()) == [("2", 40, 1), ("None", 40, 1), ("None", 40, 1)]
    left = [(r["doc_id"], r["text"]) for r in substring_dedup.remove_spans(frame(spark, rows), spans).collect()]
    assert Counter(left) == Counter({(1, row): 2, (2, ""): 1, (None, ""): 2, (None, "x\n"): 1})
    named = spark.createDataFrame([("b", row), ("a", row), (None, row), ("c", None)], "doc_id string, text string")
    spans = substring_dedup.removable_spans(named)
    assert sorted((str(r["doc_id"]), r["kept_doc_id"]) for r in spans.collect()) == [("None", "a"), ("b", "a")]
    assert Counter((r["doc_id"], r["text"]) for r in substring_dedup.remove_spans(named, spans).collect()) == Counter([("a", row), ("b", ""), (None, ""), ("c", None)])
    assert substring_dedup.removable_spans(named.limit(0)).count() == 0


def test_substring_dedup_removes_short_lines_paragraphs_and_documents(spark):
    line = "see our terms and the other pages for more"
    rows = [(1, "Short copy."), (2, "short  copy"), (3, f"own a b\n{line}\nown c d"), (4, f"else e f\n{line.upper()}!\nelse g h. Short copy. Else i"), (5, "x one\n\ny two\nz three"), (6, "q four\n\ny\ntwo z three\n\nr five"), (7, "twice\nnew k\ntwice")]
    df = frame(spark, rows)
    spans = substring_dedup.removable_spans(df)
    text = {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(df, spans).collect()}
    assert text == {1: "Short copy.", 2: "", 3: rows[2][1], 4: "else e f\n\nelse g h. Short copy. Else i", 5: rows[4][1], 6: "q four\n\n\n\nr five", 7: "twice\nnew k\n"}
    assert {(r["doc_id"], r["n_words"], r["kept_doc_id"]) for r in spans.collect()} == {(2, 2, 1), (4, 9, 3), (6, 4, 5), (7, 1, 7)}


def test_substring_dedup_removes_what_brute_force_finds(spark):
    rng = random.Random(12)
    sentence = lambda: " ".join(words(rng, rng.randint(1, 9))) + rng.choice([".", "!", "?\n", "\n", ".\n\n"])
    pool = [sentence() for _ in range(25)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.6 else sentence() for _ in range(15))) for k in range(100, 130)]
    rows += [r for r in ODD if r[0] != 5]
    df = frame(spark, rows)
    spans = substring_dedup.removable_spans(df)
    got = gone_words(rows, spans.collect())
    assert got == brute_gone(rows, substring_dedup.MIN_WORDS) and len(got) > 100
    for r in substring_dedup.remove_spans(df, spans).collect():
        text = dict(rows)[r["doc_id"]]
        assert (r["text"] is None) == (text is None) and (r["text"] or "").split() == [w for k, w in enumerate((text or "").split()) if (r["doc_id"], text, k) not in got]


def test_substring_dedup_sees_passages_without_sentence_ends(spark):
    rng = random.Random(13)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [new(60) for _ in range(20)]
    rows = [(2 * k + side, f"{new(30)} {p} {new(30)}") for k, p in enumerate(passages) for side in (0, 1)]
    spans = substring_dedup.removable_spans(frame(spark, rows)).collect()
    lost = {r["doc_id"]: r for r in spans}
    assert len(lost) == len(spans) >= 18 and all(d % 2 and 25 <= r["n_words"] <= 60 and r["kept_doc_id"] == d - 1 for d, r in lost.items())
    assert all(dict(rows)[d][r["start"] : r["end"]] in passages[d // 2] for d, r in lost.items())


def test_shingles():
    assert len(shingles.shingle_set("a b c d e f", 5)) == 2 and len(shingles.shingle_set("a b", 5)) == 1 and not len(shingles.shingle_set("--", 5))
    assert hashlib.sha256(shingles.shingle_set("A, b C d e", 5).tobytes()).hexdigest() == hashlib.sha256(shingles.shingle_set("a b c d e", 5).tobytes()).hexdigest()
