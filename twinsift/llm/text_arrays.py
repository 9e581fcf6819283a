"""Texts as NumPy arrays of folded code points, a bounded block of characters at a time."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 400_000
BLOCK_TEXTS = 500


@lru_cache(maxsize=None)
def fold_table(digits: bool) -> np.ndarray:
    """Per code point: the lower-case letter (or mark, or digit if wanted), 0 for all else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        if kind in "LM" or (digits and kind == "N"):
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) in runs of up to ``BLOCK_CHARS`` and ``BLOCK_TEXTS``; a longer text is its own run."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > BLOCK_CHARS or i - start >= BLOCK_TEXTS):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def folded(texts: list[str], digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text number per code) of the texts, each followed by a 0."""
    raw = "\0".join([*texts, ""]).encode("utf-32-le", "replace")
    codes = fold_table(digits)[np.frombuffer(raw, dtype="<u4")]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.repeat(np.arange(len(texts)), sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
