"""Texts as arrays of code points: the vectorised form that several operators share."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def folding() -> np.ndarray:
    """For every code point: the letter, mark or digit that it counts as, apart from case and width; 0 for what does not count
    (punctuation, white space, symbols, invisible characters)."""
    table = np.zeros(0x110000, np.uint32)
    for cp in [*range(0xD800), *range(0xE000, 0x10000)]:
        folded = unicodedata.normalize("NFKC", chr(cp)).lower()
        c = folded[:1]
        if c and unicodedata.category(c)[0] in "LMN" and not 0xFE00 <= cp <= 0xFE0F:
            table[cp] = ord(c)
    high = np.arange(0x10000, 0x110000, dtype=np.uint32)
    letters = (high < 0x1F000) | ((high >= 0x20000) & (high < 0x32000))
    table[0x10000:] = np.where(letters, high, 0)
    return table


def chunks(texts: list[str | None], budget: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``budget`` characters together (or one longer text)."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total + n > budget and i > begin:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[str | None], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with ``gap`` zeros after each, and the offset of each text (one more at the end)."""
    sep = "\0" * gap
    big = sep.join(t if t else "" for t in texts) + sep
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64) + gap
    return code_points(big), np.concatenate([[0], np.cumsum(lengths)])
