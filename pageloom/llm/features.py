"""Numpy views of a batch of texts: code points with document bounds, and character classes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, UPPER, DIGIT, SPACE, MARK = 1, 2, 4, 8, 16


#: Code points, and the ranges of those that Unicode assigns by character (the rest is unassigned or for private use).
CODES, ASSIGNED = 0x110000, (range(0x34000), range(0xE0000, 0xE1000))


@lru_cache
def classes() -> np.ndarray:
    """A bit set for each code point, by its own Unicode category."""
    table = np.full(CODES, MARK, dtype=np.uint8)
    for some in ASSIGNED:
        for c in some:
            ch = chr(c)
            kind = unicodedata.category(ch)
            found = LETTER * kind.startswith("L") | UPPER * (kind in ("Lu", "Lt")) | DIGIT * kind.startswith("N") | SPACE * ch.isspace()
            table[c] = found or MARK * (not kind.startswith("M"))
    return table


def code_points(texts: list[str], gap: str = "\0") -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by one gap; the start of each text and the end of all."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(t + gap for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def classes_of(codes: np.ndarray) -> np.ndarray:
    return classes()[codes]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between the starts (each text holds its gap, so none is empty)."""
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.zeros(0, dtype=values.dtype)
