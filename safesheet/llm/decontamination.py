"""Benchmark decontamination by template canonicalisation and a hash join of windows (operator 6)."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keep, python_ready, row_key, tidy, without, written
from .shingles import window_hashes

#: Tokens of a window; a shorter item is one window. A document holds an item when windows cover MIN_TOKENS of its
#: tokens, or half of it where that is more; all of it where it is shorter. MIN_TOKENS in a row are enough for an item of any length.
WINDOW, MIN_TOKENS, MIN_SHARE = 8, 13, 0.5
#: Of a template window's tokens at least this share are words or signs, not placeholders; an item of fewer tokens than MIN_TEMPLATE has no
#: template window. Literal windows are taken at all places of all items.
MIN_WORDS, MIN_TEMPLATE = 0.5, 5
#: Bits, as a power of two, of the filter of the benchmark's windows that is sent to the workers, whatever the benchmark's size; PROBES of them for each window.
FILTER_BITS, PROBES = 26, 3
#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees celsius fahrenheit "
    "meter meters metre metres kilometer kilometers kilometre kilometres watt watts volt volts joule joules newton newtons".split()
)
#: Words, numbers, signs that are units, signs of arithmetic, and the other marks.
STREAM = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]|_|\n")
CURRENCY, SIGNS = frozenset("%€$£"), frozenset("-+*/=^×÷")
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
PLACE = {NUMBER, NAME, UNIT}
TEMPLATE, LITERAL = range(2)


class Text:
    """A text's literal tokens with their places, and its template.

    Literal tokens are words, numbers, unit symbols and signs between two numbers, in lower case. In the template numbers, units (a word of
    UNITS right after a number, or a symbol) and names (capitalised words; of neighbouring ones those after the first make one name if the
    first opens a sentence, else all) are placeholders with their kind. A name at the start of a sentence is marked as loose: it may be any word.
    """

    def __init__(self, text: str):
        found = list(STREAM.finditer(text))
        kinds = [kind_of(m.group()) for m in found]
        self.spans: list[tuple[int, int]] = []
        self.values: list[str] = []
        self.template: list[str] = []
        self.first: list[int] = []  # literal token at which each template token begins
        self.loose: list[bool] = []
        before, named = BREAK, False
        for k, (m, kind) in enumerate(zip(found, kinds, strict=True)):
            if kind == SIGN and not (before == DIGITS and k + 1 < len(kinds) and kinds[k + 1] == DIGITS):
                kind = BREAK
            if kind != BREAK:
                low = m.group().lower()
                unit = kind & 7 == SYMBOL or kind & 7 == MEASURE and before == DIGITS
                name = kind >= 8 and not unit
                tight = before != BREAK
                if not (name and named):
                    self.template.append(NUMBER if kind == DIGITS else UNIT if unit else NAME if name else low)
                    self.first.append(len(self.spans))
                    self.loose.append(name and not tight)
                self.spans.append(m.span())
                self.values.append(low)
                named = name and tight
            else:
                named = False
            before = kind

    def windows(self, kind: int, width: int) -> np.ndarray:
        """Hash of each window of the template or of the literal tokens."""
        return window_hashes(codes(self.template if kind == TEMPLATE else self.values), width)

    def reach(self, kind: int, at: int, width: int) -> tuple[int, int]:
        """Literal tokens of a window: the first, and the one after the last."""
        if kind == LITERAL:
            return at, at + width
        return self.first[at], self.first[at + width] if at + width < len(self.first) else len(self.spans)

    def slots(self, at: int, width: int) -> list[str]:
        """Kind and value of each placeholder of a template window; no kind for a loose name."""
        out = []
        for k in range(at, at + width):
            if self.template[k] in PLACE:
                a, z = self.reach(TEMPLATE, k, 1)
                out.append(("" if self.loose[k] else self.template[k]) + "\t" + " ".join(self.values[a:z]))
        return out

    def tokens(self, kind: int, at: int, width: int) -> list[str]:
        return (self.template if kind == TEMPLATE else self.values)[at : at + width]


WORD, DIGITS, MEASURE, SYMBOL, SIGN, BREAK = range(6)
STORE = 200_000


def kind_of(token: str) -> int:
    """The kind of a token or mark by itself, with 8 added for a capital."""
    c = token[0]
    if c.isdecimal():
        return DIGITS
    if c in CURRENCY:
        return SYMBOL
    if c in SIGNS:
        return SIGN
    if not c.isalnum():
        return BREAK
    return (MEASURE if token.lower() in UNITS else WORD) + (8 if c.isupper() else 0)


class Known(dict):
    """Numbers of tokens; a new one is added by ``add``."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, token: str) -> int:
        return self.add(token)


class Tokens:
    """A worker's table of the tokens it has seen: kind and code. Codes are alike in all processes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index = Known(self.add)
        self.kinds, self.codes = array("b"), array("Q")

    def add(self, token: str) -> int:
        self.kinds.append(kind_of(token))
        self.codes.append(int(code_of(token.lower())))
        self.index[token] = len(self.kinds) - 1
        return self.index[token]

    def streams(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Codes of all texts' template tokens in turn and the text of each, and the same of the literal tokens: what ``Text`` has."""
        if len(self.index) > STORE:
            self.clear()
        parts = [STREAM.findall(t) for t in texts]
        for p in parts:
            p.append("\n")
        lengths = [len(p) for p in parts]
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(lengths))
        of = np.repeat(np.arange(len(texts)), lengths)
        kinds, literal = np.frombuffer(self.kinds, dtype=np.int8)[flat], np.frombuffer(self.codes, dtype=np.uint64)[flat]
        upper, kinds = kinds >= 8, kinds & 7
        number = kinds == DIGITS
        after = np.concatenate([[False], number[:-1]])
        kinds = np.where((kinds == SIGN) & ~(after & np.concatenate([number[1:], [False]])), BREAK, kinds)
        unit = (kinds == SYMBOL) | (kinds == MEASURE) & after
        name = upper & ~unit
        tight = np.concatenate([[False], kinds[:-1] != BREAK])
        code = np.where(number, code_of(NUMBER), np.where(unit, code_of(UNIT), np.where(name, code_of(NAME), literal)))
        solid = kinds != BREAK
        lead = solid & ~(name & np.concatenate([[False], (name & tight)[:-1]]))
        return (code[lead], of[lead]), (literal[solid], of[solid])


def code_of(token: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")))


def codes(tokens: list[str]) -> np.ndarray:
    return np.array([code_of(t) for t in tokens], dtype=np.uint64)


def item_windows(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, width, place) of each window that an item is searched by: all literal ones, and the template ones with a placeholder and enough words."""
    own = Text(text)
    width = min(WINDOW, len(own.values))
    for at in range(len(own.values) - width + 1 if width else 0):
        yield LITERAL, width, at
    width = min(WINDOW, len(own.template))
    for at in range(len(own.template) - width + 1 if width >= MIN_TEMPLATE else 0):
        places = sum(t in PLACE for t in own.template[at : at + width])
        if 0 < places <= (1 - MIN_WORDS) * width:
            yield TEMPLATE, width, at


#: One window in one text: its tokens, its literal tokens' numbers, its slots.
WINDOW_SCHEMA = "kind int, width int, h long, tokens array<string>, first int, after int, slots array<string>"
_WINDOW = [("kind", pa.int32()), ("width", pa.int32()), ("h", pa.int64()), ("tokens", pa.list_(pa.string())), ("first", pa.int32()), ("after", pa.int32()), ("slots", pa.list_(pa.string()))]


def _window(own: Text, kind: int, width: int, at: int, h: int) -> tuple:
    return kind, width, h, own.tokens(kind, at, width), *own.reach(kind, at, width), own.slots(at, width) if kind == TEMPLATE else []


def _batch(carried: dict, rows: list[tuple], fields: list[tuple[str, pa.DataType]], owner: list[int]) -> pa.RecordBatch:
    """Rows as a batch, with the carried columns of the row ``owner`` of each."""
    at = pa.array(owner, pa.int64())
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in carried.values()), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], [*carried, *[n for n, _ in fields]])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, u, n_item, and the columns of WINDOW_SCHEMA) of each window of each item; u is a digest of the text, n_item its literal tokens."""
    python_ready(benchmark.sparkSession)
    fields = [("n_item", pa.int32()), *_WINDOW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                own, hashes = Text(text), {}
                for kind, width, at in item_windows(text):
                    if (kind, width) not in hashes:
                        hashes[kind, width] = own.windows(kind, width).view(np.int64).tolist()
                    rows.append((len(own.values), *_window(own, kind, width, at, hashes[kind, width][at])))
                    owner.append(k)
            yield _batch({c: b.column(c) for c in ("item_id", "u")}, rows, fields, owner)

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("u"), "text").distinct()
    return items.mapInArrow(run, f"item_id {kind}, u long, n_item int, {WINDOW_SCHEMA}")


def probes(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(19 * k)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


def window_filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the windows' hashes as words of 64 bits, made by the executors; the driver gets its words that aren't 0."""
    places = F.array(*[F.expr(f"shiftrightunsigned(h, {19 * k}) & {(1 << FILTER_BITS) - 1}L") for k in range(PROBES)])
    bits = windows.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    got = bits.toPandas()
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def held(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter has."""
    left = np.arange(len(h))
    for k in range(PROBES):
        p = probes(h[left])[k]
        left = left[(words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return left


_tokens = Tokens()


def document_windows(docs: DataFrame, words: np.ndarray, shapes: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, __t0..2, columns of WINDOW_SCHEMA, start, end) of the documents' windows of the (kind, width) that the filter lets through; offsets in characters."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(words)
    fields = [*_WINDOW, ("start", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("decontamination")
        words, tokens = shared.value, _tokens
        for b in batches:
            texts, rows, owner = b.column("text").to_pylist(), [], []
            for base in range(0, len(texts), 100):
                part = texts[base : base + 100]
                streams = tokens.streams(part)
                maybe = set()
                for kind, width in shapes:
                    code, of = streams[kind]
                    maybe.update(of[held(words, window_hashes(code, width))].tolist())
                for k in sorted(maybe):
                    own = Text(part[k])
                    for kind, width in shapes:
                        h = own.windows(kind, width)
                        for at in held(words, h).tolist():
                            w = _window(own, kind, width, at, int(h[at : at + 1].view(np.int64)[0]))
                            rows.append((*w, own.spans[w[4]][0], own.spans[w[5] - 1][1]))
                            owner.append(base + k)
            yield _batch({c: b.column(c) for c in ("doc_id", *ROW)}, rows, fields, owner)
        tokens.clear()
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *row_key(), "text").filter("text is not null")
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in ROW)}, {WINDOW_SCHEMA}, start int, end int")


def judge(windows: list[dict], n: int) -> tuple[int, int, int, str] | None:
    """(tokens found, start, end, changed slots) of an item of ``n`` tokens by the windows that it shares with a document; None if it isn't held.

    Windows that continue each other in both texts are a copy. Along a copy one value of the item stands for one value of the
    document and the other way round; else only windows with the item's own values count.
    """
    done: list[list[dict]] = []
    open_: list[list[dict]] = []
    for w in sorted(windows, key=lambda w: (w["first"], w["at"], w["after"])):
        ended = [c for c in open_ if max(x["after"] for x in c[-WINDOW:]) < w["first"]]
        done += ended
        open_ = [c for c in open_ if c not in ended] if ended else open_
        fits = [c for c in open_ if c[-1]["at"] <= w["at"] <= max(x["to"] for x in c[-WINDOW:])]
        shift = lambda c, w=w: abs(c[-1]["first"] - c[-1]["at"] - w["first"] + w["at"])
        best = min(fits, key=shift, default=None)
        if best is None or shift(best) > WINDOW:
            open_.append([w])
        else:
            best.append(w)
    covered: set[int] = set()
    where: list[int] = []
    changed: set[str] = set()
    longest = 0
    for copy in [*done, *open_]:
        to: dict[tuple[str, str], str] = {}
        back: dict[tuple[str, str], str] = {}
        alike, same, own = True, [], set()
        for w in copy:
            equal = True
            for x, y in zip(w["item_slots"], w["slots"], strict=True):
                (kind, old), (other, now) = x.split("\t"), y.split("\t")
                equal &= old == now
                if kind and other:  # a loose name may be any word; names are compared by their last word, as the first may open a sentence
                    x, y = (old, now) if kind != NAME else (old.split()[-1], now.split()[-1])
                    alike &= to.setdefault((kind, x), y) == y and back.setdefault((kind, y), x) == x
                if old != now:
                    own.add(f"{old}={now}")
            same.append(equal)
        begin = end = d_end = -1
        for w, equal in zip(copy, same, strict=True):
            if alike or equal:
                begin = begin if w["at"] <= end and w["first"] <= d_end else w["at"]
                end, d_end = max(end, w["to"]) if begin != w["at"] else w["to"], w["after"]
                longest = max(longest, end - begin)
                covered.update(range(w["at"], w["to"]))
                where += [w["start"], w["end"]]
        if alike:
            changed |= own
    if covered and (len(covered) >= min(n, max(MIN_TOKENS, MIN_SHARE * n)) or longest >= MIN_TOKENS):
        return len(covered), min(where), max(where), ";".join(sorted(changed))
    return None


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_items`` with the digests __t0..2 of the row."""
    spark = docs.sparkSession
    python_ready(spark)
    indexed = written(benchmark_windows(benchmark), "benchmark-windows")
    shapes = [(r["kind"], r["width"]) for r in indexed.select("kind", "width").distinct().collect()]
    mine = document_windows(docs, window_filter(indexed), sorted(shapes))
    theirs = indexed.select("item_id", "u", "n_item", "kind", "width", "h", F.col("tokens").alias("item_tokens"), F.col("first").alias("at"), F.col("after").alias("to"), F.col("slots").alias("item_slots"))
    hits = mine.join(theirs, ["kind", "width", "h"]).filter("tokens = item_tokens")
    one = F.struct("first", "after", "at", "to", "start", "end", "slots", "item_slots")
    grouped = hits.groupBy("doc_id", *ROW, "item_id", "u", "n_item").agg(F.collect_set(one).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for k, (windows, n) in enumerate(zip(b.column("windows").to_pylist(), b.column("n_item").to_pylist(), strict=True)):
                if (got := judge(windows, n)) is not None:
                    rows.append((got[0], n, *got[1:]))
                    owner.append(k)
            fields = [("n_found", pa.int32()), ("n_item", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("slots", pa.string())]
            yield _batch({c: b.column(c) for c in ("doc_id", "item_id", *ROW)}, rows, fields, owner)

    kinds = {f.name: f.dataType.simpleString() for f in [docs.schema["doc_id"], benchmark.schema["item_id"]]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, {', '.join(f'{c} long' for c in ROW)}, n_found int, n_item int, start int, end int, slots string"
    return grouped.mapInArrow(run, schema)


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_found, n_item, start, end, slots) of each benchmark item that a document holds.

    Template and literal windows of the items are a table. Whole texts are searched in one pass: windows that a filter of fixed size lets
    through are joined with that table by hash, and their tokens compared. The windows of a document and an item are then judged: along a
    copy the template's slots have to be filled consistently, else only windows with the item's own values count. New parameters
    of a passage of mostly numbers, or of names in lower case, aren't told from other text. start and end are offsets in characters of
    what was found; slots lists the item's values that the document changed. An item of any length is searched; null items and those without id
    or token are never found; equal items under several ids each give theirs. Null or empty texts hold nothing; repeated rows,
    equal in doc_id and text, give their items once; a null doc_id is an id like others.
    """
    return _found(docs, benchmark).drop(*ROW)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Rows are told apart by doc_id and text, so another text under the same
    doc_id stays; a null doc_id is an id like others."""
    bad = written(_found(docs, benchmark).select(*ROW).distinct(), "leaks")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *row_key())
    return without(rows, bad, ROW).select("__row.*")
