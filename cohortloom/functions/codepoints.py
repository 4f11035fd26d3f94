"""Arrow string arrays as flat code-point arrays, and character classes as lookup tables over all code points."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

LIMIT = 0x110000


def explode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows in one array, row offsets (n+1) and the null mask. Null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    nulls = np.asarray(arr.is_null())
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), nulls
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    first = (raw & 0xC0) != 0x80
    starts = np.concatenate([[0], np.cumsum(first)])
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return cps, starts[offsets - offsets[0]], nulls


def implode(cps: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``explode``."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    data = np.ascontiguousarray(cps, "<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    byte_offsets = at[offsets]
    valid = None
    if nulls is not None and nulls.any():
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    if byte_offsets[-1] < 2**31 - 1:
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(byte_offsets.astype(np.int32).tobytes()), pa.py_buffer(data), valid)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(byte_offsets.astype(np.int64).tobytes()), pa.py_buffer(data), valid)
    return out


def row_counts(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many code points of each row have the flag."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


@lru_cache(maxsize=None)
def categories() -> np.ndarray:
    """Two-letter general category of every code point, as bytes."""
    return np.array([unicodedata.category(chr(i)) for i in range(LIMIT)], dtype="S2")


@lru_cache(maxsize=None)
def frequent_han() -> np.ndarray:
    """Han characters of the first, frequency-chosen level of the two national double-byte sets."""
    out = np.zeros(LIMIT, bool)
    for codec, leads, trails in (("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)), ("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)])):
        for a in leads:
            for b in trails:
                try:
                    c = bytes((a, b)).decode(codec)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1 and (codec == "gb2312" or "一" <= c <= "鿿"):
                    out[ord(c)] = True
    return out


def is_han() -> np.ndarray:
    out = np.zeros(LIMIT, bool)
    out[0x3400:0x4DC0] = out[0x4E00:0xA000] = out[0x20000:0x32000] = True
    return out


def expand(cps: np.ndarray, off: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by the ``size`` code points from ``start`` in ``flat``: gathers and offsets, no call per row."""
    n = size[cps]
    ends = np.concatenate([[0], np.cumsum(n)])
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    return flat[np.repeat(start[cps], n) + inner], ends[off]


@lru_cache(maxsize=None)
def casefold_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start, flat) of the full case folding of every code point."""
    size, start = np.ones(LIMIT, np.int64), np.arange(LIMIT, dtype=np.int64)
    more: list[int] = []
    for i in np.flatnonzero(np.isin(categories().astype("S1"), [b"L", b"M", b"N", b"S"])):
        f = chr(i).casefold()
        if f != chr(i):
            size[i], start[i] = len(f), LIMIT + len(more)
            more += map(ord, f)
    return size, start, np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(more, np.uint32)])
