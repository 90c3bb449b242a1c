"""Words of UTF-8 texts for the operators that count and look up words."""

from __future__ import annotations

from collections.abc import Iterator

#: A word's bytes: digits, small letters (A-Z are lower-cased) and all bytes of characters outside ASCII; any other byte parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words are given in lists from about so many bytes, so that a very long text needs no list of all its words.
PART = 1 << 20


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size."""
    low, at = text.translate(_FOLD), 0
    while at < len(low):
        end = low.find(b" ", at + PART)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end
