"""Syntax and vocabulary features of whole texts, for Han and alphabetic writing, from code-point arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.functions import codepoints as cp
from cohortloom.llm.letters import steps

#: Buckets of hashed words or Han pairs, for each kind of writing.
BUCKETS = 512
SYNTAX = 10
WIDTH = 2 * (BUCKETS + SYNTAX) + 1


@lru_cache(maxsize=None)
def _classes() -> dict[str, np.ndarray]:
    cat = cp.categories()
    major = cat.astype("S1")
    han = cp.is_han()
    mark = lambda s: np.isin(np.arange(cp.LIMIT), [ord(c) for c in s])
    lower = np.arange(cp.LIMIT, dtype=np.uint32)
    for i in np.flatnonzero(cat == b"Lu"):
        if len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    return {"han": han, "letter": ((major == b"L") | (major == b"M")) & ~han, "end": mark(".!?。！？…;；"), "pause": mark(",，、:：—"), "digit": cat == b"Nd", "lower": lower}


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: a bias for the writing, then syntax and square-rooted word frequencies in the columns of that writing.

    Blank and null texts give zeros. The whole text counts, however long.
    """
    t = _classes()
    cps, off, _ = cp.explode(texts)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    han, letter = t["han"][cps], t["letter"][cps]
    count = lambda flag: np.bincount(row[flag], minlength=n).astype(float)
    n_han, n_letter = count(han), count(letter)
    script = (n_letter > n_han).astype(int)
    before = np.append(False, letter[:-1])
    before[off[:-1][off[:-1] < len(cps)]] = False
    start = np.flatnonzero(letter & ~before)
    at = np.flatnonzero(letter)
    word = np.cumsum((letter & ~before)[at]) - 1
    inner = at - start[word] if len(at) else at
    lengths = np.bincount(word, minlength=len(start))
    code = (t["lower"][cps[at]].astype(np.uint64) + np.uint64(7)) * _POWERS[np.minimum(inner, 63)]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
    words = np.add.reduceat(code, first) if len(first) else np.zeros(0, np.uint64)
    wrow = row[start]
    pair = np.flatnonzero(han[:-1] & han[1:] & (row[:-1] == row[1:])) if len(cps) > 1 else np.zeros(0, np.int64)
    pairs = cps[pair].astype(np.uint64) * _POWERS[3] + cps[pair + 1].astype(np.uint64) * _POWERS[9]
    vocab = np.zeros((n, BUCKETS))
    for rows, h, kind in ((wrow, words, 1), (row[pair], pairs, 0)):
        use = script[rows] == kind
        vocab += np.bincount(rows[use] * BUCKETS + _bucket(h[use]), minlength=n * BUCKETS).reshape(n, BUCKETS)
    vocab = np.sqrt(vocab / np.maximum(1, vocab.sum(1, keepdims=True)))
    ends, pauses = np.maximum(1, count(t["end"][cps])), count(t["pause"][cps])
    n_words = np.maximum(1, np.bincount(wrow, minlength=n)).astype(float)
    body = np.maximum(1, n_han + n_letter)
    share = lambda k: np.bincount(wrow[lengths >= k], minlength=n) / n_words
    syntax = np.stack([
        np.log(body / ends), np.log1p(pauses / ends), pauses / body * 20, np.log(np.maximum(1, n_letter) / n_words), share(7), share(10), share(13),
        np.log(n_words / ends), count(t["digit"][cps]) / body * 10, np.log(body) / 5,
    ], 1)
    out = np.zeros((n, WIDTH), np.float32)
    half = BUCKETS + SYNTAX
    block = np.hstack([syntax * 0.3, vocab])
    for kind in (0, 1):
        r = np.flatnonzero((script == kind) & (n_han + n_letter > 0))
        out[r, 1 + kind * half : 1 + (kind + 1) * half] = block[r]
    out[:, 0] = script
    return out


def scored(df: DataFrame, key: str, model, names: list[str]) -> DataFrame:
    """(key, *names): ``model`` maps a feature matrix to one column per name; batches stay where they lie."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0)
            for first, texts in steps(b.column(1)):
                y = model(features(texts))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), *[pa.array(y[:, k].astype(float)) for k in range(len(names))]], [key, *names])

    return df.select(key, "text").mapInArrow(run, schema)


def sampled(ids: DataFrame, df: DataFrame, key: str, most: int, label: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``most`` labelled rows, chosen by a hash of the key: the documented bound of a fit.

    ``ids``: (key, label). Keys are chosen before texts are touched, and texts become features where they lie, so that
    neither the driver nor one task ever holds texts. Of a repeated key one row counts.
    """
    from pyspark.sql import functions as F

    chosen = ids.select(key, label).orderBy(F.xxhash64(key), key).limit(most)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, texts in steps(b.column("text")):
                x = features(texts)
                part = b.slice(first, len(texts))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("y"), rows], [key, "y", "x"])

    texts = df.where(F.col("text").isNotNull()).select(key, "text").join(F.broadcast(chosen.withColumnRenamed(label, "y")), key).select(key, F.col("y").cast("double").alias("y"), "text")
    rows = texts.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, y double, x array<float>").toArrow()  # ``most`` rows of fixed width
    order = np.argsort(np.asarray(rows.column(key)), kind="stable")
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, WIDTH)[order] if rows.num_rows else np.zeros((0, WIDTH), np.float32)
    keys = np.asarray(rows.column(key))[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    mix = np.random.default_rng(0).permutation(int(first.sum()))
    return x[first][mix], np.asarray(rows.column("y"))[order][first][mix]
