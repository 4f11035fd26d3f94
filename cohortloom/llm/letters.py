"""Texts as letters and digits only: folded, lower case, one code-point array per batch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohortloom.functions import codepoints as cp
from cohortloom.llm.fold import fold_codepoints

#: Code points that one numpy step holds; a longer text is a step by itself.
STEP = 1_000_000


@lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    major = cp.categories().astype("S1")
    lower = np.arange(cp.LIMIT, dtype=np.uint32)
    for i in np.flatnonzero(cp.categories() == b"Lu"):
        x = chr(i).lower()
        if len(x) == 1:
            lower[i] = ord(x)
    return lower, np.isin(major, [b"L", b"N"])


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of the letters and digits of each text; null gives none."""
    lower, kept = _tables()
    cps, off, _ = fold_codepoints(texts)
    keep = kept[cps]
    return lower[cps[keep]], np.concatenate([[0], np.cumsum(keep)])[off]


def steps(texts: pa.Array, most: int = STEP):
    """Slices (first row, array) of at most ``2 * most`` bytes of text, or of one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    total = np.cumsum(size)
    a = 0
    while a < len(texts):
        base = total[a] - size[a]
        b = max(a + 1, int(np.searchsorted(total, base + 2 * most, "right")))
        yield a, texts.slice(a, b - a)
        a = b


_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(cps: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all windows of q code points, modulo 2^64."""
    n = len(cps) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = cps.astype(np.uint64) + np.uint64(1)
    h = c[:n].copy()
    for j in range(1, q):
        h *= _BASE
        h += c[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
