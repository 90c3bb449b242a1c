"""Word n-grams as sorted sets of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import tidy

WORD = re.compile(r"\w+")
#: Words kept with their codes in a worker.
STORE = 150_000
_known: dict[str, int] = {}


def forget() -> None:
    """Empties the store, at a task's end."""
    _known.clear()
    tidy()


def word_codes(words: list[str]) -> np.ndarray:
    """64 bits of each word, alike in all processes."""
    get = _known.get
    found = [get(w) for w in words]
    if None in found:
        if len(_known) > STORE:
            _known.clear()
        for k, w in enumerate(words):
            if found[k] is None:
                found[k] = _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(found, dtype=np.uint64)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` codes."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-case words; a shorter text is one n-gram, one without words none."""
    codes = word_codes(WORD.findall(text.lower()))
    if not len(codes):
        return codes
    return np.unique(window_hashes(codes, min(width, len(codes))) + np.uint64(width - min(width, len(codes))))
