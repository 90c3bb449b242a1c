"""Removal of passages that earlier documents hold, by a distributed merge sort of suffixes (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import _flagged, keep, python_ready, tidy, written

#: A string of WIDTH bytes that a smaller doc_id holds too is removed.
WIDTH = 50
#: Each string of WIDTH bytes is found by the run of ANCHOR bytes in it whose hash is least: its anchor. Strings in a row that share theirs are one suffix
#: of the text that begins there, and the bytes before it.
ANCHOR = 20
#: Texts worked on at once have about so many bytes; longer ones are cut into overlapping pieces. Places in a part fit PLACE bits.
PART, PLACE = 1 << 18, 24
#: Suffixes of a sorted run, and bytes of suffixes that one merge gets.
RUN, MERGE_BYTES = 200_000, 12 << 20
#: Bits of the filter of anchors that several texts have: 32 MB, whatever the corpus; once it is full it holds back less, with the same results.
BITS = 28
#: An anchor that has more than one of so many parts of all suffixes is hot: its strings are dealt out by all of their bytes, each for itself.
HOT_PARTS, HOT_LEAST = 20_000, 1000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Suffixes:
    """Suffixes of texts. Each stands for the strings that begin at 0 to ``before`` bytes before it and end within its ``size`` bytes."""

    hash: np.ndarray  #: what deals it out
    right: np.ndarray  #: its bytes, WIDTH at most, then zeros
    left: np.ndarray  #: the bytes before it, nearest first, then zeros
    size: np.ndarray
    before: np.ndarray
    at: np.ndarray  #: place in the text of the first string
    late: np.ndarray  #: whether the document has no id
    key: np.ndarray  #: the id
    row: np.ndarray  #: digest of the text

    def take(self, which: np.ndarray | slice) -> Suffixes:
        return Suffixes(*(getattr(self, f.name)[which] for f in fields(self)))

    def __len__(self) -> int:
        return len(self.at)


def joined(parts: list[Suffixes]) -> Suffixes:
    return parts[0] if len(parts) == 1 else Suffixes(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)))


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Concatenated texts of about PART bytes, with the text, the start in it and the end in the whole of each piece; long texts overlap themselves by WIDTH - 1 bytes."""
    part: list[bytes] = []
    of, begins, size = [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - WIDTH + 1), PART):
            piece = text[a : a + PART + WIDTH - 1]
            if len(piece) >= WIDTH:
                part.append(piece)
                of.append(k)
                begins.append(a)
                size += len(piece)
            if size >= PART:
                yield b"".join(part), np.array(of), np.array(begins), np.cumsum([len(p) for p in part])
                part, of, begins, size = [], [], [], 0
    if part:
        yield b"".join(part), np.array(of), np.array(begins), np.cumsum([len(p) for p in part])


def _gram_hashes(c: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place, by doubling."""
    h, width = _BYTES[c], 1
    while width < ANCHOR:
        step = min(width, ANCHOR - width)  # the last two runs may overlap
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ h[step:]
        h ^= h >> np.uint64(29)
        width += step
    return _mix(h)


def anchors(c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, hash): the anchors of all strings of WIDTH bytes inside the pieces that end at ``ends``, with their first and last string.

    The anchor of a string is the first of its runs of ANCHOR bytes with the least hash, so it depends on these bytes only."""
    h = _gram_hashes(c)
    low = np.uint64((1 << PLACE) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = WIDTH - ANCHOR + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & low).astype(np.int64)
    inside = np.ones(len(place), dtype=bool)
    for e in ends[:-1]:
        inside[max(0, e - WIDTH + 1) : e] = False
    string = np.nonzero(inside)[0]
    starts = np.nonzero(np.diff(place[string], prepend=-1))[0]
    at = place[string[starts]]
    return at, string[starts], string[np.append(starts[1:], len(string)) - 1], h[at]


def _rows_of(c: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """``size`` bytes from each place onwards (step 1) or backwards from the byte before (step -1), then zeros to ``width``."""
    k = np.arange(width)
    where = at[:, None] + (k if step > 0 else -1 - k)
    return np.where(k < size[:, None], c[np.clip(where, 0, len(c) - 1)], 0).astype(np.uint8)


def suffixes(texts: list[bytes], late: np.ndarray, key: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> Iterator[Suffixes]:
    """Those whose anchor the filter ``wanted`` has."""
    for data, of, begins, ends in pieces(texts):
        c = np.frombuffer(data, dtype=np.uint8)
        at, first, last, h = anchors(c, ends)
        some = np.nonzero(has(wanted, h))[0]
        at, first, last, h = at[some], first[some], last[some], h[some]
        piece = np.searchsorted(ends, at, side="right")
        text = of[piece]
        size, before = last + WIDTH - at, at - first
        begin = begins[piece] + first - np.append(0, ends)[piece]
        yield Suffixes(
            h, _rows_of(c, at, size, WIDTH, 1), _rows_of(c, at, before, WIDTH - ANCHOR, -1), size.astype(np.uint8), before.astype(np.uint8), begin.astype(np.uint32), late[text], key[text], row[text]
        )


def strings(s: Suffixes) -> Suffixes:
    """Each string of some suffixes as a suffix of its own, dealt out by its bytes."""
    n = s.size.astype(np.int64) + s.before - WIDTH + 1
    owner = np.repeat(np.arange(len(s)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    both = np.concatenate([s.left[:, ::-1], s.right], axis=1)  # the bytes in their order; what is missing is at the edges
    begin = s.left.shape[1] - s.before[owner].astype(np.int64) + nth
    right = both[owner[:, None], begin[:, None] + np.arange(WIDTH)]
    h = np.zeros(len(owner), dtype=np.uint64)
    for column in _columns(right).T:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ column)
    none = np.zeros(len(owner), dtype=np.uint8)
    return Suffixes(h, right, np.zeros((len(owner), WIDTH - ANCHOR), dtype=np.uint8), none + np.uint8(WIDTH), none, (s.at[owner] + nth).astype(np.uint32), s.late[owner], s.key[owner], s.row[owner])


def _columns(m: np.ndarray) -> np.ndarray:
    """Rows of bytes as numbers of 64 bits in the order of the bytes."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : m.shape[1]] = m
    return wide.view(">u8").astype(np.uint64)


def in_order(s: Suffixes, n_parts: int) -> tuple[Suffixes, np.ndarray, Suffixes]:
    """The suffixes by part, bytes, bytes before and document; the parts; and those that go for sure, as a smaller id of the run has the same."""
    part = (s.hash >> np.uint64(PLACE)) % np.uint64(n_parts)
    wide = np.concatenate([s.right, s.size[:, None], s.left, s.before[:, None]], axis=1)
    columns = _columns(wide)
    order = np.lexsort((s.key, s.late, *columns.T[::-1], part))
    s, part, columns = s.take(order), part[order], columns[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (columns[1:] != columns[:-1]).any(axis=1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    gone = ~s.late[head] & (s.late | (s.key != s.key[head]))
    return s.take(~gone), part[~gone].astype(np.int32), s.take(gone)


def _common(m: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one above."""
    other = m[1:] != m[:-1]
    return np.concatenate([[0], np.where(other.any(axis=1), other.argmax(axis=1), m.shape[1])]).astype(np.uint8)


def front_coded(s: Suffixes, part: np.ndarray, gone: Suffixes, gone_part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, run): the sorted suffixes of each part without the bytes that they share with the one before; and what goes for sure."""
    new = np.diff(part, prepend=-1) != 0
    shared, near = _common(s.right), _common(s.left)
    for own, size in ((shared, s.size), (near, s.before)):
        own[1:] = np.minimum(own[1:], np.minimum(size[1:], size[:-1]))
        own[new] = 0
    k, j = np.arange(s.right.shape[1]), np.arange(s.left.shape[1])
    tails = s.right[(k >= shared[:, None]) & (k < s.size[:, None])]
    sides = s.left[(j >= near[:, None]) & (j < s.before[:, None])]
    tail_end = np.append(0, np.cumsum(s.size.astype(np.int64) - shared))
    side_end = np.append(0, np.cumsum(s.before.astype(np.int64) - near))
    order = np.argsort(gone_part, kind="stable")
    gone, gone_part = gone.take(order), gone_part[order]
    for p in np.unique(np.concatenate([part, gone_part])).tolist():
        a, z = np.searchsorted(part, [p, p + 1])
        g, y = np.searchsorted(gone_part, [p, p + 1])
        body = [shared[a:z], s.size[a:z], near[a:z], s.before[a:z], s.late[a:z], s.at[a:z], s.key[a:z], s.row[a:z]]
        body += [gone.size[g:y], gone.before[g:y], gone.late[g:y], gone.at[g:y], gone.key[g:y], gone.row[g:y]]
        yield p, packed(b"".join([np.array([z - a, y - g], dtype=np.int64).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in body), tails[tail_end[a] : tail_end[z]].tobytes(), sides[side_end[a] : side_end[z]].tobytes()]))


def packed(data: bytes) -> bytes:
    """Compressed by entropy too, which Spark's own codec for shuffles doesn't do; the length first."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def decoded(run: bytes) -> tuple[dict[str, np.ndarray], list[int], list[bytes], np.ndarray, dict[str, np.ndarray]]:
    """Of a run: columns of the suffixes, the numbers of shared bytes, the suffixes, rows of the bytes before, and columns of what goes for sure."""
    run = unpacked(run)
    n, m = np.frombuffer(run, dtype=np.int64, count=2).tolist()
    at = 16

    def column(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(run, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    shared, size, near, before = (column(np.uint8, n) for _ in range(4))
    kinds = (("late", np.bool_), ("at", np.uint32), ("key", np.int64), ("row", np.int64))
    own = {"size": size, "before": before, **{name: column(kind, n) for name, kind in kinds}}
    gone = {"size": column(np.uint8, m), "before": column(np.uint8, m), **{name: column(kind, m) for name, kind in kinds}}
    found: list[list[bytes]] = []
    for cut, length in ((shared, size), (near, before)):
        out, last = [], b""
        for c, z in zip(cut.tolist(), (length.astype(np.int64) - cut).tolist(), strict=True):
            last = last[:c] + run[at : at + z]
            at += z
            out.append(last)
        found.append(out)
    left = np.frombuffer(b"".join(x.ljust(WIDTH - ANCHOR, b"\0") for x in found[1]), dtype=np.uint8).reshape(n, WIDTH - ANCHOR)
    return own, shared.tolist(), found[0], left, gone


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """(run, common): of each suffix in the order of all runs, its run and the bytes it shares with the one before, by a tree of losers.

    Each loser keeps how many bytes it shares with the winner that it met. Of two suffixes that share different numbers with
    the last one put out, that with more comes first; only when the numbers are equal are bytes compared, and only those after them.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [r[0] if r else None for r in runs] + [None] * (width - len(runs))
    known = [0 if h is not None else -1 for h in heads]  # -1: the run is at its end, after all others
    nth = [0] * width
    losers = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's known bytes become those shared with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = heads[a], heads[b]
        s, t = s[x:], t[x:]
        if s == t:
            if b < a:
                a, b = b, a
            known[b] = x + len(s)
            return a, b
        n = min(len(s), len(t))
        u, v = int.from_bytes(s[:n], "big"), int.from_bytes(t[:n], "big")
        if u == v:
            first = len(s) < len(t)
            same = n
        else:
            first = u < v
            same = n - 1 - ((u ^ v).bit_length() - 1) // 8
        if not first:
            a, b = b, a
        known[b] = x + same
        return a, b

    winners = [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    out, common = [], []
    while known[best] >= 0:
        out.append(best)
        common.append(known[best])
        nth[best] += 1
        k, run = nth[best], runs[best]
        if k < len(run):
            heads[best], known[best] = run[k], shared[best][k]
        else:
            heads[best], known[best] = None, -1
        node = (best + width) >> 1
        while node:
            other = losers[node]
            x, y = known[best], known[other]
            if x < y:
                best, losers[node] = other, best
            elif x == y and x >= 0:
                best, losers[node] = play(best, other)
            node >>= 1
    return out, common


def repeats(common: np.ndarray, left: np.ndarray, own: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffix, start, end): bytes of the texts that go, by suffixes in their order that share ``common`` bytes with the one before.

    The strings that begin ``a`` bytes before a suffix are equal where the suffixes share WIDTH - a bytes and the ``a`` bytes before them are equal
    too; both are runs of equal numbers in the order of the suffixes and in that of the bytes before. One goes if a smaller id has it.
    """
    span = WIDTH - ANCHOR
    group = np.cumsum(common < ANCHOR)
    some = np.nonzero(np.bincount(group)[group] > 1)[0]
    if not len(some):
        return
    # what stands between two of a group is of that group, so leaving whole groups out keeps the shared numbers
    common, left, own = common[some], np.ascontiguousarray(left[some]), {k: v[some] for k, v in own.items()}
    common[np.diff(group[some], prepend=-1) != 0] = 0
    size, before, late, key = own["size"].astype(np.int64), own["before"].astype(np.int64), own["late"], own["key"]
    order = np.argsort(left.view(f"S{span}").ravel(), kind="stable")
    near = _common(left[order])
    gone = np.zeros((len(some), span + 3), dtype=bool)  # by suffix and a, with an edge on both sides
    side = np.empty(len(some), dtype=np.int64)
    for a in range(span + 1):
        able = np.nonzero((before >= a) & (size >= WIDTH - a))[0]
        if len(able) < 2:
            continue
        side[order] = np.cumsum(near < a)
        code = np.cumsum(common < WIDTH - a)[able] * (len(some) + 1) + side[able]
        by = np.argsort(code, kind="stable")
        starts = np.nonzero(np.diff(code[by], prepend=-1))[0]
        n = np.diff(np.append(starts, len(by)))
        if n.max() < 2:
            continue
        who, none = key[able][by], late[able][by]
        least = np.repeat(np.minimum.reduceat(np.where(none, np.iinfo(np.int64).max, who), starts), n)
        known = np.repeat(np.logical_or.reduceat(~none, starts), n)
        gone[able[by], a + 1] = np.where(none, known, least < who)
    edge = np.diff(gone.astype(np.int8), axis=1)
    s, low = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    first = own["at"][s].astype(np.int64) + before[s]
    yield some[s], first - (after - 1), first - low + WIDTH


def bits(hashes: DataFrame) -> np.ndarray:
    """A filter of the column h, made by the executors; the driver gets its words of 64 bits that aren't 0, 2 ** (BITS - 6) at most."""
    at = F.pmod("h", F.lit(1 << BITS))
    made = hashes.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int")).alias("b"))
    got = made.groupBy("word").agg(F.bit_or("b").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << BITS) - 1)
    return words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def _anchor_counts(rows: DataFrame) -> DataFrame:
    """(h, n): the texts that have each anchor, summed by batch."""
    python_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("suffix_dedup")
        for b in batches:
            found, owner = [], []
            for data, of, _, ends in pieces(b.column("text").to_pylist()):
                at, _, _, h = anchors(np.frombuffer(data, dtype=np.uint8), ends)
                found.append(h)
                owner.append(of[np.searchsorted(ends, at, side="right")])
            if not found:
                continue
            h, of = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            each = np.ones(len(h), dtype=bool)
            each[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h = h[each]
            starts = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(h))))], ["h", "n"])
        tidy()

    return rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _sorted_runs(rows: DataFrame, wanted: np.ndarray, hot: np.ndarray, n_parts: int) -> DataFrame:
    """(part, run): front-coded sorted runs of the suffixes whose anchors several texts have."""
    shared = rows.sparkSession.sparkContext.broadcast((wanted, hot))

    def coded(s: Suffixes, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, part, gone = in_order(s, n_parts)
        gone_part = ((gone.hash >> np.uint64(PLACE)) % np.uint64(n_parts)).astype(np.int32)
        is_hot = np.isin(found.hash, hot)
        runs = [front_coded(found.take(~is_hot), part[~is_hot], gone, gone_part)]
        burning, step = found.take(is_hot), max(1, RUN // (WIDTH - ANCHOR + 1))
        for k in range(0, len(burning), step):
            alone, part, gone = in_order(strings(burning.take(slice(k, k + step))), n_parts)
            runs.append(front_coded(alone, part, gone, ((gone.hash >> np.uint64(PLACE)) % np.uint64(n_parts)).astype(np.int32)))
        for r in runs:
            for p, body in r:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([body], pa.binary())], ["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("suffix_dedup")
        wanted, hot = shared.value
        waiting: list[Suffixes] = []
        for b in batches:
            late, key, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("late", "id", "row"))
            for s in suffixes(b.column("text").to_pylist(), late, key, row, wanted):
                waiting.append(s)
                if sum(map(len, waiting)) >= RUN:
                    yield from coded(joined(waiting), hot)
                    waiting = []
        if sum(map(len, waiting)):
            yield from coded(joined(waiting), hot)
        waiting.clear()
        tidy()

    return rows.select("late", "id", "row", "text").mapInArrow(run, "part int, run binary")


def _merge_parts(runs: DataFrame, n_parts: int) -> DataFrame:
    """(late, id, row, start, end): the bytes that go, of each part's runs merged."""
    names = ["late", "id", "row", "start", "end"]

    def batch(own: dict[str, np.ndarray], which: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(own[c][which]) for c in ("late", "key", "row")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], names)

    def merge(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs, shared, owns, lefts = [], [], [], []
        for body in bodies:
            own, cut, found, left, gone = decoded(body)
            if len(gone["at"]):
                start = gone["at"].astype(np.int64)
                yield batch(gone, np.arange(len(start)), start, start + gone["before"] + gone["size"])
            runs.append(found)
            shared.append(cut)
            owns.append(own)
            lefts.append(left)
        order, common = merged(runs, shared)
        of, sizes = np.array(order, dtype=np.int64), np.array([len(r) for r in runs])
        place = np.empty(len(of), dtype=np.int64)
        place[np.argsort(of, kind="stable")] = np.arange(len(of))  # suffixes of a run come in its order
        assert int(sizes.sum()) == len(of)
        own = {k: np.concatenate([o[k] for o in owns])[place] for k in owns[0]}
        for found in repeats(np.array(common, dtype=np.int64), np.concatenate(lefts)[place], own):
            yield batch(own, *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("suffix_dedup")
        now, bodies = None, []
        for b in batches:
            for p, body in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                if p != now and bodies:
                    yield from merge(bodies)
                    bodies = []
                now = p
                bodies.append(body)
        if bodies:
            yield from merge(bodies)
        bodies.clear()
        tidy()

    return runs.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(run, "late boolean, id long, row long, start long, end long")


def _rows(docs: DataFrame) -> DataFrame:
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be an integer")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def repeated_bytes(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(late, id, row, start, end): stretches of each text that smaller ids have too, which may overlap; late tells a null id, row is xxhash64 of the text."""
    rows = _rows(docs).filter(F.octet_length("text") >= WIDTH)
    counts = written(_anchor_counts(rows).filter("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot_least, total // HOT_PARTS)
    hot = np.sort(counts.filter(F.col("n") > least).select("h").toArrow().column("h").to_numpy().view(np.uint64))  # HOT_PARTS at most
    n_parts = max(1, total * 80 // MERGE_BYTES)
    return _merge_parts(_sorted_runs(rows, bits(counts.select("h")), hot, n_parts), n_parts)


def _packed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (late, id, row, text) with their texts compressed, for a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([packed(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("late", "id", "row")), texts], ["late", "id", "row", "text"])

    return rows.select("late", "id", "row", "text").mapInArrow(run, "late boolean, id long, row long, text binary")


def _cut(text: bytes, found: list[dict] | None) -> tuple[bytes, list[dict]]:
    """The bytes that stay, and the maximal stretches that go."""
    spans: list[dict] = []
    for s in sorted(found or [], key=lambda x: x["start"]):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], s["end"])
        else:
            spans.append(dict(s))
    begin, out = 0, []
    for s in spans:
        out.append(text[begin : s["start"]])
        begin = s["end"]
    return b"".join([*out, text[begin:]]), spans


def suffix_dedup(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row with the bytes of its text that stay, and the stretches (start, end) that went, in bytes of its UTF-8 form.

    A byte goes if it lies in a string of 50 bytes that also begins in a document of a smaller doc_id; strings overlap, are judged on the input,
    and don't cross documents. The strings around one anchor (the run of 20 bytes in them with the least hash) are one suffix that begins
    there, with the bytes before it; anchors of one text only are left out by a filter of fixed size. Tasks sort their suffixes, exchange
    them front-coded by the hash of the anchor, and each part is merged by a tree of losers that compares no known prefix. Of suffixes that a run
    holds twice, the smallest id's is sent, as the others go for sure; a hot anchor's strings are dealt out singly, by all their bytes.

    Repeated rows, and different texts under one doc_id, don't remove each other's bytes. A null doc_id comes after all others: such rows lose what any
    document with an id has, and remove nothing. Null texts count as empty, and keep nothing; texts under 50 bytes stay. doc_id has to
    be an integer of any size. Empty tables give no row; other columns don't matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(repeated_bytes(docs, hot_least), "repeats")
    rows = _flagged(_rows(docs), found.select("late", "id", "row"), ["late", "id", "row"])
    same = F.col("text").alias("kept")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    doc_id = F.when(~F.col("late"), F.col("id")).cast(kind).alias("doc_id")
    whole = rows.filter("not __maybe").select(doc_id, F.octet_length("text").cast("long").alias("n_bytes"), none, same)
    lists = found.groupBy("late", "id", "row").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    held = _packed_texts(rows.filter("__maybe").drop("__maybe")).join(lists, ["late", "id", "row"], "left").select("late", "id", "text", "found")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("suffix_dedup")
        for b in batches:
            texts = list(map(unpacked, b.column("text").to_pylist()))
            cut = [_cut(t, f) for t, f in zip(texts, b.column("found").to_pylist(), strict=True)]
            columns = [b.column("late"), b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([s for _, s in cut], span), pa.array([k for k, _ in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["late", "id", "n_bytes", "spans", "kept"])

    less = held.mapInArrow(run, "late boolean, id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return whole.unionByName(less.select(doc_id, "n_bytes", "spans", "kept"))
