"""Canonical composition of whole batches: marks are put in order and composed array-wise, without a call per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cohortloom.functions import codepoints as cp


@lru_cache(maxsize=None)
def tables() -> dict[str, np.ndarray]:
    """Combining classes, sorted pairs that compose with what they make, and the canonical decomposition of each code point as for ``codepoints.expand``."""
    size, start, more = np.ones(cp.LIMIT, np.int64), np.arange(cp.LIMIT, dtype=np.int64), []
    ccc = np.zeros(cp.LIMIT, np.uint8)
    pairs = []
    category = cp.categories()
    plain = np.isin(category, [b"Cn", b"Co", b"Cs"])
    plain[0x3400:0x4DC0] = plain[0x4E00:0xA000] = plain[0xAC00:0xD7A4] = plain[0x20000:0x2F800] = True
    for i in np.flatnonzero(~plain):
        c = chr(i)
        ccc[i] = unicodedata.combining(c)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            full = unicodedata.normalize("NFD", c)
            size[i], start[i] = len(full), cp.LIMIT + len(more)
            more += map(ord, full)
            if " " in d and unicodedata.normalize("NFC", c) == c:
                a, b = (int(h, 16) for h in d.split())
                pairs.append((a << 21 | b, i))
    pairs.sort()
    flat = np.concatenate([np.arange(cp.LIMIT, dtype=np.uint32), np.array(more, np.uint32)])
    follows = np.zeros(cp.LIMIT, bool)
    follows[[p & 0x1FFFFF for p, _ in pairs if not ccc[p & 0x1FFFFF]]] = True
    return {"follows": follows, "ccc": ccc, "pair": np.array([p for p, _ in pairs], np.int64), "made": np.array([m for _, m in pairs], np.uint32), "size": size, "start": start, "flat": flat}


def keep(cps: np.ndarray, off: np.ndarray, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cps[stays], np.concatenate([[0], np.cumsum(stays)])[off]


def _starters(cps: np.ndarray, off: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Composition of neighbouring letters of class 0, such as the vowel signs of some scripts."""
    second = np.flatnonzero(t["follows"][cps[1:]]) if len(cps) else np.zeros(0, np.int64)
    if not len(second):
        return cps, off
    key = cps[second].astype(np.int64) << 21 | cps[second + 1]
    k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    begins = np.zeros(len(cps) + 1, bool)
    begins[off] = True
    fits = (t["pair"][k] == key) & ~begins[second + 1]
    second, k = second[fits], k[fits]
    alone = np.append(True, second[1:] != second[:-1] + 1)[: len(second)]  # of three in a row the first two
    second, k = second[alone], k[alone]
    cps = cps.copy()
    cps[second] = t["made"][k]
    stays = np.ones(len(cps), bool)
    stays[second + 1] = False
    return keep(cps, off, stays)


def compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition of each run of marks with its starter, mark by mark over all runs at once."""
    t = tables()
    cps, off = _starters(*_starters(cps, off, t), t)  # the longest compositions have three letters
    ccc = t["ccc"][cps]
    if ccc.any():
        first = np.zeros(len(cps), bool)
        first[off[:-1][off[:-1] < len(cps)]] = True
        head = (ccc == 0) | first
        run = np.cumsum(head) - 1
        order = np.lexsort((np.arange(len(cps)), ccc, run))
        cps, ccc = cps[order].copy(), ccc[order]
        heads = np.flatnonzero(head)
        length = np.diff(np.append(heads, len(cps)))
        stays, last = np.ones(len(cps), bool), np.zeros(len(heads), np.uint8)
        for j in range(1, int(length.max())):
            r = np.flatnonzero(length > j)
            m = heads[r] + j
            key = cps[heads[r]].astype(np.int64) << 21 | cps[m]
            k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
            joins = (t["pair"][k] == key) & ~((last[r] >= ccc[m]) & (last[r] > 0)) & (ccc[heads[r]] == 0)
            cps[heads[r][joins]] = t["made"][k[joins]]
            stays[m[joins]] = False
            last[r[~joins]] = ccc[m[~joins]]
        cps, off = keep(cps, off, stays)
    return _hangul(cps, off)


def _hangul(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining letters to syllables, by the arithmetic of the standard: first and middle, then the final letter."""
    if not ((cps >= 0x1100) & (cps < 0x1200)).any():
        return cps, off
    cps = cps.astype(np.int64)
    for final in (False, True):
        row = np.searchsorted(off, np.arange(len(cps)), "right")
        nxt = np.append(cps[1:], 0)
        near = np.append(row[1:] == row[:-1], False)
        if final:
            i = np.flatnonzero(near & (cps >= 0xAC00) & (cps < 0xD7A4) & ((cps - 0xAC00) % 28 == 0) & (nxt > 0x11A7) & (nxt < 0x11C3))
            cps[i] += nxt[i] - 0x11A7
        else:
            i = np.flatnonzero(near & (cps >= 0x1100) & (cps < 0x1113) & (nxt >= 0x1161) & (nxt < 0x1176))
            cps[i] = 0xAC00 + ((cps[i] - 0x1100) * 21 + nxt[i] - 0x1161) * 28
        stays = np.ones(len(cps), bool)
        stays[i + 1] = False
        cps, off = keep(cps, off, stays)
    return cps.astype(np.uint32), off


def nfc(texts: pa.Array) -> pa.Array:
    """Canonical composition of each text; null stays null."""
    t = tables()
    cps, off, nulls = cp.explode(texts)
    return cp.implode(*compose(*cp.expand(cps, off, t["size"], t["start"], t["flat"])), nulls).cast(pa.string())
