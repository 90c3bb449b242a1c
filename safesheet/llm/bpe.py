"""Byte-level BPE encoding and decoding with a segment tree (operator 10)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import caches, keep, python_ready, tidy

#: Larger than any (rank, position) key.
NONE = np.int64(1) << 62
#: Bits of a position in a tree's key; pieces beyond use the scalar tree, whose integers have no bound.
SHIFT = 24
#: Pieces kept with their ids in a worker; beyond, the store starts anew.
STORE = 200_000
#: Characters encoded at once.
CHUNK = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bytes_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


def join_ids(bytes_of: list[bytes], ids: bytes) -> bytes:
    """The bytes that ids (little-endian unsigned 32-bit integers) stand for."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Codec:
    """Encodes pieces by the ranks and decodes ids. The rank of two neighbours is that of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = bytes_by_id(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = np.int64(len(self.bytes_of))
        pairs = {ranks[b[:k]] * int(self.base) + ranks[b[k:]]: r for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.pair_keys = np.fromiter(pairs.keys() if pairs else [-1], dtype=np.int64)
        self.pair_ranks = np.fromiter(pairs.values() if pairs else [0], dtype=np.int64)
        order = np.argsort(self.pair_keys)
        self.pair_keys, self.pair_ranks = self.pair_keys[order], self.pair_ranks[order]
        self.store: dict[str, bytes] = {}

    def _pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbours, -1 where their bytes have none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece. Leaf i of the tree has (rank, i) of the pair that starts at byte i; the root has the leftmost
        pair of least rank. A merge changes three leaves, each in logarithmic time."""
        n = len(piece)
        ids = [int(self.single[b]) for b in piece]
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        none, bytes_of, ranks = (1 << 62, 0), self.bytes_of, self.ranks
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(bytes_of[ids[i]] + bytes_of[ids[i + 1]])
            if r is not None:
                tree[size + i] = (r, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(i: int, value: tuple[int, int]) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        def pair(i: int, j: int) -> tuple[int, int]:
            r = ranks.get(bytes_of[ids[i]] + bytes_of[ids[j]])
            return none if r is None else (r, i)

        while tree[1] != none:
            rank, i = tree[1]
            j = after[i]
            ids[i], live[j] = rank, False
            after[i] = k = after[j]
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
                put(i, pair(i, k))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return [x for x, y in zip(ids, live, strict=True) if y]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge_one`` for pieces of at most 2**SHIFT bytes, all trees in step as rows of one array; ids as bytes."""
        lengths = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(lengths.max())
        size = max(1, 1 << (max(width - 1, 1) - 1).bit_length())
        raw = np.zeros((n, width), dtype=np.uint8)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ids = self.single[raw]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = inside.copy()
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        if width > 1:
            rank = self._pair_ids(ids[:, :-1], ids[:, 1:])
            fits = (rank >= 0) & inside[:, 1:]
            tree[:, size : size + width - 1] = np.where(fits, (rank << SHIFT) + np.arange(width - 1), NONE)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            at = at + size
            tree[rows, at] = value
            while size > 1 and at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank = self._pair_ids(ids[rows, i], ids[rows, j])
            return np.where(rank >= 0, (rank << SHIFT) + i, NONE)

        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            i = root & ((1 << SHIFT) - 1)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = root >> SHIFT
            live[rows, j] = False
            after[rows, i] = k
            some = j < width - 1
            if some.any():
                put(rows[some], j[some], np.full(some.sum(), NONE))
            right = k < lengths[rows]
            value = np.full(len(rows), NONE)
            before[rows[right], k[right]] = i[right]
            value[right] = pair(rows[right], i[right], k[right])
            put(rows, i, value)
            h = before[rows, i]
            left = h >= 0
            if left.any():
                put(rows[left], h[left], pair(rows[left], h[left], i[left]))
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[live].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(live.sum(axis=1))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of new pieces in the store."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            r = self.ranks.get(b)
            if r is not None:
                self.store[p] = r.to_bytes(4, "little")
            else:
                by_size.setdefault((len(b) - 1).bit_length(), []).append((p, b))
        for bits, own in by_size.items():
            step = max(1, (1 << 18) >> bits)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                if len(part) < 8 or bits >= 12:
                    for p, b in part:
                        self.store[p] = np.array(self.merge_one(b), dtype="<u4").tobytes()
                else:
                    for (p, _), ids in zip(part, self.merge_many([b for _, b in part]), strict=True):
                        self.store[p] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        part: list[list[str]] = []
        chars = 0
        for k, t in enumerate(texts):
            part.append(self.pattern.findall(t))
            chars += len(t)
            if chars >= CHUNK or k == len(texts) - 1:
                if len(self.store) > STORE:
                    self.store = {}
                new: set[str] = set()
                for p in part:
                    new.update(p)
                self.learn(new - self.store.keys())
                find = self.store.__getitem__
                out += [b"".join(map(find, p)) for p in part]
                part, chars = [], 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return join_ids(self.bytes_of, ids)


_codecs: dict[str, Codec] = {}
caches["bpe"] = _codecs.clear


def digest(ranks: dict[bytes, int], pattern: str) -> str:
    """A digest of all ranks and the pattern."""
    made = hashlib.sha256(pattern.encode())
    for b, r in sorted(ranks.items()):
        made.update(b"%d %d " % (len(b), r) + b)
    return made.hexdigest()


def _codec(shared) -> Codec:
    """The worker's codec: made once for a vocabulary, as its tables and store serve all tasks."""
    key, ranks, pattern = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _shared(spark: SparkSession, vocabulary: str, pattern: str):
    ranks = read_ranks(vocabulary)
    return spark.sparkContext.broadcast((digest(ranks, pattern), ranks, pattern))


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, decoded: bool) -> DataFrame:
    spark = docs.sparkSession
    python_ready(spark)
    shared = _shared(spark, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("bpe")
        codec = _codec(shared)
        for b in batches:
            ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
            columns = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            back = [pa.array([codec.decode(x) for x in ids], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*columns, *back], ["doc_id", "n_tokens", "ids", "decoded"][: 3 + len(back)])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of ``docs`` (doc_id, text); ids is binary: little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately, without special tokens. Null text counts as empty (no ids). Repeated
    rows each get their row; an empty table gives none. Nothing is shuffled. The vocabulary file is read on the driver; its ranks, which don't
    grow with the data, are sent to the workers. A worker keeps the ids of at most STORE pieces.
    """
    return _encoded(docs, vocabulary, pattern, False)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``decode`` of ``encode``, in one worker with one copy of the vocabulary."""
    return _encoded(docs, vocabulary, pattern, True)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``encode``'s result; decoded is binary. Null ids count as none."""
    spark = encoded.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(bytes_by_id(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([join_ids(bytes_of, x or b"") for x in b.column("ids").to_pylist()], pa.binary())], [*b.schema.names, "decoded"])
        tidy()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
