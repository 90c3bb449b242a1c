"""Ranked lexical search of stated queries over all documents, by sorted impacts (operator 11)."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import keep, python_ready, tidy, written
from .terms import words

#: Results of an item.
TOP = 20
#: Items are searched in blocks of about so many bytes of text, which is what the driver and each worker hold of them.
BLOCK_BYTES = 4 << 20
#: Impacts sorted at once are about so many.
IMPACTS = 1 << 19
#: Digits of the radix sort, in bits: numpy sorts keys of 16 bits by counting.
DIGIT = 16
#: Ranges that the candidates of one item are parted into.
SALT = 16


class Items:
    """A block of items: ids, numbers of terms, and for each term the items that hold it, how often."""

    def __init__(self, ids: list, texts: list[bytes | None]) -> None:
        self.ids, self.number = ids, {}
        places: list[list[tuple[int, int]]] = []
        for u, text in enumerate(texts):
            for term, q in Counter(w for part in words(text or b"") for w in part).items():
                t = self.number.setdefault(term, len(places))
                if t == len(places):
                    places.append([])
                places[t].append((u, q))
        flat = np.array([p for found in places for p in found], dtype=np.int64).reshape(-1, 2)
        self.of, self.times = flat[:, 0], flat[:, 1]
        self.first = np.concatenate([[0], np.cumsum([len(found) for found in places], dtype=np.int64)]).astype(np.int64)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Order of non-negative keys of so many bits, from the lowest digit to the highest; equal keys keep their order."""
    order = np.argsort((keys & ((1 << DIGIT) - 1)).astype(np.uint16), kind="stable")
    for shift in range(DIGIT, bits, DIGIT):
        order = order[np.argsort((keys[order] >> shift & ((1 << DIGIT) - 1)).astype(np.uint16), kind="stable")]
    return order


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of the impacts of each pair of item and document, by item and document."""
    low = max(1, int(n_docs - 1).bit_length())
    keys = item << low | doc
    if not len(keys):
        return item, doc, impact
    order = radix_order(keys, low + int(item.max()).bit_length())
    keys = keys[order]
    starts = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[starts] >> low, keys[starts] & ((1 << low) - 1), np.add.reduceat(impact[order], starts)


class Best:
    """The k best documents of each item: highest score, then least id, null ids last. An item's worst is at the top of its heap."""

    def __init__(self, k: int, n_items: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, dtype=np.int64)  # what a document has to reach

    def add(self, item: np.ndarray, place: np.ndarray, score: np.ndarray, ids: list) -> None:
        """Documents by their place among ``ids``, which are in order, nulls last."""
        able = np.nonzero(score >= self.least[item])[0]
        able = able[np.lexsort((place[able], -score[able], item[able]))]
        of = item[able]
        starts = np.nonzero(np.diff(of, prepend=-1))[0]
        nth = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        for j in able[nth < self.k].tolist():
            self.push(int(item[j]), int(score[j]), ids[place[j]])

    def push(self, u: int, score: int, doc_id) -> None:
        heap, entry = self.heaps[u], (score, _Late(doc_id))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.least[u] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for u, heap in enumerate(self.heaps):
            for score, late in heap:
                yield u, late.doc_id, score


class _Late:
    """An id in reversed order: the greatest is the least, and null is below all."""

    __slots__ = ("doc_id",)

    def __init__(self, doc_id) -> None:
        self.doc_id = doc_id

    def __lt__(self, other: _Late) -> bool:
        if self.doc_id is None or other.doc_id is None:
            return self.doc_id is None and other.doc_id is not None
        return other.doc_id < self.doc_id

    def __eq__(self, other: object) -> bool:
        return self.doc_id == other.doc_id


def postings(docs: DataFrame, items) -> DataFrame:
    """(doc_id, n, terms, times): of each document with a term, its number of terms, and which of the items' terms it has how often. ``items`` is a broadcast Items."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("lexical_search")
        get = items.value.number.get
        for b in batches:
            lengths, terms, times, ends = [], [], [], [0]
            for text in b.column("text").to_pylist():
                n, found = 0, Counter()
                for part in words(text or b""):
                    n += len(part)
                    found.update(map(get, part))
                found.pop(None, None)
                lengths.append(n)
                terms += found.keys()
                times += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            made = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])
            yield made.filter(pc.greater(made.column("n"), 0))
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, times array<long>")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and the documents of each of the items' terms; a task gives a row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 2, dtype=np.int64)
        for b in batches:
            df[:n_terms] += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
            df[n_terms:] += len(b), pc.sum(b.column("n")).as_py() or 0
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["t", "n"])

    got = found.select("n", "terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms + 2, dtype=np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return int(out[n_terms]), int(out[n_terms + 1]), out[:n_terms]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * float(n_docs) + 2) / (2 * float(d) + 1))) for d in df], dtype=np.int64)


def scores(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, items: Items, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) for entries (doc, term, tf) in order of their documents: about IMPACTS concatenated impacts are sorted and summed at a time."""
    value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    fan = items.first[term + 1] - items.first[term]
    ends = np.cumsum(fan)
    last_of_doc = np.append(np.nonzero(np.diff(doc))[0], len(doc) - 1) if len(doc) else []
    begin = done = 0
    for last in last_of_doc:
        if ends[last] - done < IMPACTS and last != len(doc) - 1:
            continue
        part = slice(begin, last + 1)
        n = fan[part]
        entry = np.repeat(np.arange(begin, last + 1), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + items.first[term[entry]]
        low = int(doc[begin])
        item, d, score = summed(items.of[at], doc[entry] - low, items.times[at] * weight[term[entry]] * value[entry], int(doc[last]) - low + 1)
        yield item, d + low, score
        begin, done = last + 1, ends[last]


def _emit(best: Best, ids: list, base: int, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    rows = list(best.rows())
    columns = [pa.array([base + u for u, _, _ in rows], pa.int64()), pa.array([ids[u] for u, _, _ in rows], kinds[0]), pa.array([d for _, d, _ in rows], kinds[1])]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, _, s in rows], pa.int64())], ["u", "item_id", "doc_id", "score"])


def _arrow(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def candidates(found: DataFrame, items, weight: np.ndarray, n_docs: int, n_all: int, base: int, top: int, kinds: tuple[DataType, DataType]) -> DataFrame:
    """(u, item_id, doc_id, score): of each task the best documents of each item of a block; u tells the items' rows apart."""
    arrow = tuple(map(_arrow, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("lexical_search")
        block = items.value
        best = Best(top, len(block.ids))
        for b in batches:
            order = pc.sort_indices(b.column("doc_id"))  # nulls at the end
            b = b.take(order)
            ids, lists = b.column("doc_id").to_pylist(), b.column("terms")
            doc = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            m = 75 + (25 * b.column("n").to_numpy() * n_docs) // n_all
            for item, d, score in scores(doc, lists.flatten().to_numpy(zero_copy_only=False), b.column("times").flatten().to_numpy(zero_copy_only=False), m, block, weight):
                best.add(item, d, score, ids)
        yield _emit(best, block.ids, base, arrow)
        tidy()

    return found.mapInArrow(run, f"u long, item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score long")


def selected(found: DataFrame, top: int) -> DataFrame:
    """The best candidates of each item and range of hashed ids: a task sees a range of items, and keeps a heap for each item it sees."""
    arrow = [_arrow(found.schema[c].dataType) for c in ("item_id", "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        names: dict[int, object] = {}
        for b in batches:
            for u, item_id, doc_id, score in zip(*(b.column(c).to_pylist() for c in ("u", "item_id", "doc_id", "score")), strict=True):
                names[u] = item_id
                heap = heaps.setdefault(u, [])
                (heapq.heappush if len(heap) < top else heapq.heappushpop)(heap, (score, _Late(doc_id)))
        rows = [(u, names[u], late.doc_id, score) for u, heap in heaps.items() for score, late in heap]
        u, item_id, doc_id, score = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(item_id, arrow[0]), pa.array(doc_id, arrow[1]), pa.array(score, pa.int64())], ["u", "item_id", "doc_id", "score"])

    parted = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).repartitionByRange("u", "__salt").drop("__salt")
    return parted.mapInArrow(run, found.schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each row of ``items`` (item_id, text), scored by the words they share.

    N documents have a term, L terms in all; a term in df of them weighs w = floor(1000 ln((2N+2)/(2df+1))). A document of n terms has
    m = 75 + (25nN div L), and scores the sum over the item's terms, repeats included, of w * (1000000000 tf div (1000 tf + 12 m)). Ranks begin at
    1; equal scores go by smaller doc_id, null ids last; documents of score 0 aren't given. Every row of ``items`` is a query of its own, also under
    an item_id that others have or that is null; null, empty and unmatched ones give no row. Repeated rows of ``docs`` are documents each; null
    and empty texts are none. Empty tables give no row; other columns don't matter.

    Items are taken in blocks of bounded bytes, documents all at once: one scan of the texts gives the counts of the block's terms in each
    document (a written table), of which the statistics come. Then each batch concatenates the arrays of items, documents and impacts that it matches,
    sorts the packed keys by radix and sums runs of equal keys; a document's impacts lie in one row, so its sums are whole. Heaps keep the
    best by item, first of a task, then of a range of the candidates, then all.
    """
    spark = docs.sparkSession
    sized = items.select("item_id", F.col("text").cast("binary").alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    kinds = (items.schema["item_id"].dataType, docs.schema["doc_id"].dataType)
    parts = []
    for k in range(n_blocks):
        mine = (sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else sized).toArrow()
        block = Items(mine.column("item_id").to_pylist(), mine.column("text").to_pylist())
        shared = spark.sparkContext.broadcast(block)
        found = written(postings(docs, shared), "postings")
        n_docs, n_all, df = statistics(found, len(block.number))
        if n_docs:
            parts.append(selected(candidates(found, shared, term_weights(n_docs, df), n_docs, n_all, k << 32, top, kinds), top))
    if not parts:
        return spark.createDataFrame([], f"item_id {kinds[0].simpleString()}, rank int, doc_id {kinds[1].simpleString()}, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    by = Window.partitionBy("u").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
