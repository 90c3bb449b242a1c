"""Substring dedup by hashing documents, paragraphs, lines, sentences and chunks of words (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_null_safe, likely, keep, python_ready, tidy, written

#: A run of repeated sentences and chunks goes if it has this many words; a repeated line, paragraph or document goes whatever its length.
MIN_WORDS = 25
#: Kinds of units: WHOLE is a line, a paragraph of several lines or a text of several paragraphs; CHUNK doesn't depend on marks.
WHOLE, SENTENCE, CHUNK = range(3)
#: A chunk may begin where the hash of a word and the one before is 0 modulo CHUNK_STEP, and no chunk does so at the two words before.
CHUNK_STEP = np.uint64(4)
#: Marks that end a sentence; at a unit's end they aren't compared.
MARKS = ".!?"
#: Longer words, which a polynomial doesn't tell apart surely, are hashed one by one.
LONG_WORD = 256
_SPACE = np.zeros(12289, dtype=bool)
_SPACE[[k for k in range(12289) if chr(k).isspace()]] = True
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
_powers = np.ones((2, 1), dtype=np.uint64)
_inverse = np.ones((2, 1), dtype=np.uint64)
#: Texts worked on at once have about so many characters.
PART = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHARS = _mix(np.arange(1, 65537, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the two bases and of their inverses modulo 2**64, n of each at least."""
    global _powers, _inverse
    if _powers.shape[1] < n:
        size = max(4096, 1 << n.bit_length())
        inverse = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], dtype=np.uint64)
        tables = []
        for bases in (_BASES, inverse):
            t = np.ones((2, size), dtype=np.uint64)
            t[:, 1:] = bases[:, None]
            tables.append(np.multiply.accumulate(t, axis=1))
        _powers, _inverse = tables
    return _powers, _inverse


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_places(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of anything but white space, and places of the line ends."""
    space = _SPACE[np.minimum(chars, 12288)] & (chars <= 12288)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0], np.nonzero(chars == 10)[0]


def word_codes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two codes of each word, two of it without closing marks (0 if nothing is left), whether it ends with one, whether it is marks only.

    A code is a polynomial of the characters' values, all words' at once by differences of running sums, spread over 64 bits."""
    n = len(chars)
    values = _CHARS[np.minimum(chars, 65535)]
    rare = np.nonzero(chars >= 65535)[0]
    values[rare] = _mix(chars[rare].astype(np.uint64) + np.uint64(1))
    powers, inverse = _power_tables(n + 1)
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    np.cumsum(values * powers[:, :n], axis=1, out=sums[:, 1:])
    unmarked = np.ones(n, dtype=bool)
    for m in MARKS:
        unmarked &= chars != ord(m)
    stop = np.maximum(np.maximum.accumulate(np.where(unmarked, np.arange(n), -1))[end - 1] + 1, start)
    code, bare = (_mix((sums[:, z] - sums[:, start]) * inverse[:, start] + (z - start).astype(np.uint64)) for z in (end, stop))
    for k in np.nonzero(end - start > LONG_WORD)[0].tolist():
        for own, z in ((code, end[k]), (bare, stop[k])):
            own[:, k] = np.frombuffer(xxhash.xxh3_128_digest(chars[start[k] : z].tobytes()), dtype=np.uint64)
    only = stop == start
    bare[:, only] = 0
    return code, bare, stop < end, only


def _spans(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after of the stretches that begin at the marked words."""
    first = np.nonzero(cuts)[0]
    return first, np.append(first[1:], len(cuts))


def all_units(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Arrays text, start, end, first word, word after, kind, again, digest (two rows) of the units of some texts, in order of text and start, larger ones first.

    Whole units are each line that isn't blank, each paragraph (between blank lines) of several lines, and the text if it has
    several paragraphs. Sentences end with a line or with a word that ends in MARKS; one that is its line is that line only.
    Chunks are words between two places that four words around decide on, so that a passage has the same ones in any
    text. A digest is a polynomial in 128 bits of the words in lower case, without the MARKS at the unit's end unless there is nothing
    else; chunks keep them and never equal other units. So units are equal whatever blanks and line ends part their words. Words
    and characters are counted inside each text; ``again`` says that the text has an equal unit before.
    """
    whole_text = "\n".join(texts)
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    chars = _chars(whole_text)
    start, end, breaks = word_places(chars)
    n = len(start)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none, none.astype(bool), np.zeros((2, 0), dtype=np.uint64)
    low = _chars(whole_text.lower())
    # a letter whose lower case has another number of characters moves the words' places, not their number
    places = (start, end) if len(low) == len(chars) else word_places(low)[:2]
    code, bare, marked, only = word_codes(low, *places)
    of = np.searchsorted(offset, start, side="right") - 1
    new_text = np.diff(of, prepend=-1) > 0
    line = np.searchsorted(breaks, start)
    step = np.diff(line, prepend=-2)
    new_line, new_paragraph = step > 0, (step > 1) | new_text
    la, lz = _spans(new_line)
    pa_, pz = _spans(new_paragraph)
    several = new_line.cumsum()[pz - 1] > new_line.cumsum()[pa_]
    ta, tz = _spans(new_text)
    parted = new_paragraph.cumsum()[tz - 1] > new_paragraph.cumsum()[ta]
    sa, sz = _spans(new_line | np.concatenate([[True], marked[:-1]]))
    inside = ~(new_line[sa] & np.append(new_line, True)[sz])
    inside &= ~only[sa] | (sz - sa > 1)  # marks alone are no sentence
    raw = np.zeros(n, dtype=bool)
    raw[1:] = (code[0, :-1] * _BASES[0] + code[0, 1:] * _BASES[1]) >> np.uint64(32) & (CHUNK_STEP - np.uint64(1)) == 0
    raw &= ~new_text
    clear = raw.copy()
    clear[1:] &= ~raw[:-1]  # the first word of a text is never raw, so only the word after it could see the text before
    clear[2:] &= ~raw[:-2] | new_text[1:-1]
    cuts = np.nonzero(clear)[0]
    ca, cz = cuts[:-1], cuts[1:]
    same = of[ca] == of[cz]
    ca, cz = ca[same], cz[same]
    first, after = np.concatenate([la, pa_[several], ta[parted], sa[inside], ca]), np.concatenate([lz, pz[several], tz[parted], sz[inside], cz])
    kind = np.repeat([WHOLE, SENTENCE, CHUNK], [len(la) + int(several.sum()) + int(parted.sum()), int(inside.sum()), len(ca)])
    powers, inverse = _power_tables(n + 1)
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    np.cumsum(code * powers[:, :n], axis=1, out=sums[:, 1:])
    digest = sums[:, after] - sums[:, first]
    last = after - 1
    whole = kind != CHUNK
    trimmed = whole & ~(only[last] & (after - first == 1))
    digest += np.where(trimmed, (bare[:, last] - code[:, last]) * powers[:, last], np.uint64(0))
    digest *= inverse[:, first]
    digest ^= np.where(whole, np.uint64(0), np.uint64(0xA5A5A5A55A5A5A5A))
    a, z = start[first], end[last]
    lines = np.arange(len(first)) < len(la)  # a line goes with the blanks around its words
    edges = np.concatenate([[-1], breaks, [len(whole_text)]])
    a = np.where(lines, edges[np.minimum(line[first], len(edges) - 2)] + 1, a)
    z = np.where(lines, edges[np.minimum(line[last] + 1, len(edges) - 1)], z)
    owner = of[first]
    order = np.lexsort((kind, -z, a))
    owner, digest = owner[order], digest[:, order]
    mixed = digest[0] ^ digest[1] * _BASES[0]
    by = np.lexsort((mixed, owner))  # stable: equal units of a text come in their order
    again = np.zeros(len(by), dtype=bool)
    again[by[1:]] = (mixed[by[1:]] == mixed[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]])
    base = np.nonzero(new_text)[0][np.cumsum(new_text) - 1]
    first, after = first[order], after[order]
    return owner, a[order] - offset[owner], z[order] - offset[owner], first - base[first], after - base[first], kind[order], again, digest


#: What orders the occurrences of a unit: the id; rows without one come after all others, by ``late``, a digest of their text.
RANK = ["id", "late"]


def _all_rows(docs: DataFrame) -> DataFrame:
    """A row for each unit of each text: id, late, row, start, end, w0, w1, kind, again (the text has it before), h1, h2."""
    python_ready(docs.sparkSession)
    names = ["start", "end", "w0", "w1", "kind", "again", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("substring_dedup")
        for b in batches:
            texts = b.column("text").to_pylist()
            part: list[str] = []
            size = 0
            for k, text in enumerate(texts):
                part.append(text)
                size += len(text)
                if size > PART or k == len(texts) - 1:
                    yield batch(b, part, k + 1 - len(part))
                    part, size = [], 0
        tidy()

    def batch(b: pa.RecordBatch, part: list[str], begin: int) -> pa.RecordBatch:
        owner, *found, digest = all_units(part)
        of = pa.array(owner + begin, pa.int64())
        columns = [pa.array(c, t, safe=False) for c, t in zip(found, [*[pa.int32()] * 5, pa.bool_()], strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in (*RANK, "row")), *columns, *(pa.array(h.view(np.int64)) for h in digest)], [*RANK, "row", *names])

    digest = F.xxhash64("text")
    rows = docs.filter("text is not null").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), digest).alias("late"), digest.alias("row"), "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, late long, row long, start int, end int, w0 int, w1 int, kind int, again boolean, h1 long, h2 long"
    return rows.mapInArrow(run, schema)


def _islands(found: DataFrame) -> DataFrame:
    """``found`` with island: a number for the units of a text that overlap or follow each other without a word between."""
    order = Window.partitionBy(*RANK, "row").orderBy("w0", F.desc("w1"), "start", "kind")
    reach = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("island", F.coalesce(F.col("w0") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("island").over(order))


def removable_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end, n_words, n_units, kept_doc_id): a row for each stretch of a text that goes.

    Units are hashed to 128 bits; of equal ones over all documents, that in the least doc_id, and there the first in its text,
    stays, and the others are repeats. Every repeated line, paragraph and whole text goes whatever its length, and so does every run of
    repeated units, sentences and chunks among them, of ``min_words`` words. start and end are offsets in characters of the original text,
    n_units counts the repeated units in the span, kept_doc_id is the least document that keeps some unit of it. doc_id may
    be of any type that has an order. Rows without one come after all others, by a digest of their text (kept_doc_id is null where one of
    them keeps the unit). row is xxhash64 of the text, so that different texts under one doc_id are told apart; their units don't repeat each
    other. Repeated rows of a doc_id and text are one document. Null texts, and those without a word, have no spans.

    Digests are grouped after partial sums; the digests found twice are a written table. Units are made again for the join with it, which
    costs less than writing them all, and most that aren't repeats go before the shuffle by a bit filter of fixed size.
    """
    made = _all_rows(docs)
    first = made.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.min("late").alias("first_late"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "repeated-units")
    later = "again or id > first or id is null and (first is not null or late > first_late)"
    found = likely(made, first, "h1", "h2").join(first, ["h1", "h2"]).filter(later).select(*RANK, "row", "start", "end", "w0", "w1", "kind", "first")
    found = found.repartition(*RANK, "row").dropDuplicates([*RANK, "row", "start", "end", "kind"])
    of = Window.partitionBy(*RANK, "row", "island")
    found = _islands(found).withColumn("run", F.max("w1").over(of) - F.min("w0").over(of))
    gone = _islands(found.filter((F.col("kind") == WHOLE) | (F.col("run") >= min_words)).drop("island"))
    spans = gone.groupBy(*RANK, "row", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).cast("long").alias("n_words"), F.count("*").alias("n_units"), F.min("first").alias("kept_doc_id")
    )
    return spans.select(F.col("id").alias("doc_id"), "row", "start", "end", "n_words", "n_units", "kept_doc_id")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the spans (doc_id, row, start, end) in text, and with ``removed``: their original offsets, sorted; replaces a column of that name.

    Repeated rows are all cut alike; no row goes, and null text stays null. An empty table gives none."""
    columns = [c for c in docs.columns if c != "removed"]
    lists = spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("d"), "doc_id", F.xxhash64("text").alias("row"))
    rows = join_null_safe(rows, lists, ["doc_id", "row"], "left")
    text, cuts = F.col("d.text"), F.col("removed")
    ends = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["end"]))
    starts = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.length(text)))
    kept = F.when(cuts.isNull(), text).otherwise(F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a + 1, b - a)), ""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(*[kept.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in columns], F.coalesce("removed", none).alias("removed"))
