"""Chunks of documents for retrieval, split at the largest mark that fits."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

SIZE, OVERLAP, MARKS = 1000, 200, ["\n\n", "\n", " ", ""]


def _pieces(text: str, mark: str) -> list[str]:
    """The text parted before each mark, which stays at the head of its piece; without a mark, its characters."""
    if not mark:
        return list(text)
    first, *rest = text.split(mark)
    return [p for p in [first, *(mark + x for x in rest)] if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size`` characters; the next chunk begins with as many of the last pieces as ``overlap`` allows."""
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, marks: list[str] = MARKS) -> list[str]:
    """Chunks of at most ``size`` characters (longer only where a piece has no mark left to part it): the first of ``marks`` that the text has parts it,
    pieces that are still too long are parted by the marks after it, and the others are packed."""
    text = text or ""
    k = next((k for k, m in enumerate(marks) if m == "" or m in text), len(marks) - 1)
    mark, later = marks[k], marks[k + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, mark):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _packed(short, size, overlap) if short else []
        short = []
        out += split_text(piece, size, overlap, later) if later else [piece]
    return out + (_packed(short, size, overlap) if short else [])


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, marks: list[str] = MARKS) -> DataFrame:
    """The columns of ``docs``, with text a chunk, and chunk_index and total_chunks, which replace columns of these names: a row for each chunk. Null and blank texts have none. Nothing is shuffled."""
    if overlap > size:
        raise ValueError("the overlap is larger than the chunk")
    split = F.udf(lambda t: split_text(t, size, overlap, marks), "array<string>", useArrow=True)
    kept = [c for c in docs.columns if c not in ("chunk_index", "total_chunks")]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], split("text").alias("__chunks"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "__chunk"))
    return rows.select(*[F.col("__chunk").alias(c) if c == "text" else F.col(f"`{c}`") for c in kept], "chunk_index", "total_chunks")
