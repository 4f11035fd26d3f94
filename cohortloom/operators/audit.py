"""Counts, distributions, conflicts, duplicates, constraints and digests of a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import quantiles
from cohortloom.operators.joins import null_safe_join

# Fixed values of the record contract.
REQUIRED = ("dataset_version", "paradigm", "subject_id", "session_id", "book_id", "sentence_id", "eeg_file", "event_source", "alignment_source", "quality_flag", "split_group_id", "split", "record_id", "run_id", "block_id")
PARADIGMS = ("silent_reading", "passive_listening", "reading_aloud")
SPLITS = ("train", "valid", "test")
ALIGNMENTS = ("exact", "normalized", "fuzzy", "manual", "unresolved")
SEMANTICS = "exclusive ROWE event-onset sample; EEG interval is [eeg_start_sample,eeg_end_sample)"
VERSION = "trial-manifest-v1"
DERIVED = ("normalized_text", "text_hash", "raw_text_hash", "normalized_text_hash", "char_count", "raw_char_count", "highlight_char_count", "word_count")
NEAR_RATIO = 96.0


def group_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows per combination; nulls are shown as empty text."""
    return df.groupBy(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, exact interpolated quantiles, range and mean of the finite numbers; NaN, infinities and null are left out."""
    v = F.when(F.abs(value) <= 1e300, F.col(value))
    base = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    q = quantiles.quantiles(df.select(*by, v.alias("_x")), by, "_x", {"p05": 0.05, "median": 0.5, "p95": 0.95}).drop("n")
    return null_safe_join(base, q, by, "left").select(*by, "n", "min", *[F.round(n, 9).alias(n) for n in ("p05", "median", "p95")], "max", F.round("mean", 9).alias("mean"))


def violations(df: DataFrame) -> Column:
    """Array of the rules that a record breaks."""
    c = F.col
    expected = F.try_divide((c("eeg_end_sample") - c("eeg_start_sample")).cast("double"), c("eeg_sampling_rate"))
    nulls = c("audio_start_sec").isNull(), c("audio_end_sec").isNull()
    rules = {
        **{f"empty_{r}": F.coalesce(c(r), F.lit("")) == "" for r in REQUIRED},
        "unknown_paradigm": ~c("paradigm").isin(*PARADIGMS), "unknown_split": ~c("split").isin(*SPLITS), "unknown_alignment": ~c("text_alignment_status").isin(*ALIGNMENTS),
        "eeg_interval": (c("eeg_start_sample") < 0) | (c("eeg_end_sample") <= c("eeg_start_sample")), "eeg_rate": c("eeg_sampling_rate") <= 0,
        "eeg_duration": ~F.coalesce(F.abs(expected - c("eeg_duration_sec")) <= 1e-9, F.lit(False)), "eeg_semantics": c("eeg_end_sample_semantics") != SEMANTICS,
        "audio_bounds_half_null": nulls[0] != nulls[1], "audio_without_bounds": nulls[0] & nulls[1] & (c("audio_duration_sec").isNotNull() | c("audio_file").isNotNull()),
        "audio_interval": ~nulls[0] & ~nulls[1] & ((c("audio_start_sec") < 0) | (c("audio_end_sec") <= c("audio_start_sec"))), "audio_duration_missing": ~nulls[0] & ~nulls[1] & c("audio_duration_sec").isNull(),
        "derived_without_text": c("raw_text").isNull() & F.coalesce(*[c(d).cast("string") for d in DERIVED]).isNotNull(), "schema_version": c("manifest_schema_version") != VERSION,
    }
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))


#: Rows that one digest bucket should hold.
BUCKET_ROWS = 100_000


def bucket_digits(n: int) -> int:
    """Hex digits that spread ``n`` rows into buckets of about BUCKET_ROWS, two at least."""
    digits = 2
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def ordered_digest(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(digest, n): a digest of all rows in key order that is built in two levels, so that no task holds all rows.

    Fields are joined by 0x1F and rows by 0x0A, null as empty; rows fall into buckets by the first hex digits of their
    key's hash, as many as keep a bucket small, each bucket is digested in order of key and line, and the digests are
    digested in bucket order. ``stream_digest`` gives the plain digest of the rows in order.
    """
    buckets = bucket_digits(df.count())
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(F.substring(F.sha2(k.cast("binary"), 256), 1, buckets).alias("b"), k.alias("k"), F.sha2(line.cast("binary"), 256).alias("h"))
    per = rows.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n").cast("binary"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n").cast("binary"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


#: Letters up to which pairs are worked on together; longer ones go one by one, on whole integers.
TOGETHER = 1024


def _lcs_long(x: str, y: str) -> int:
    full = (1 << len(x)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << j
    v = full
    for c in y:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence of each pair, by the bit-parallel recurrence for all pairs of like length at once, letter by letter of ``b``."""
    out = np.zeros(len(a), np.int64)
    n = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    for i in np.flatnonzero(n.max(1, initial=0) > TOGETHER):
        out[i] = _lcs_long(a[i], b[i])
    words = -(-n[:, 0] // 64)
    for w in np.unique(words[(n.max(1, initial=0) <= TOGETHER) & (n.min(1, initial=TOGETHER) > 0)]):
        own = np.flatnonzero((words == w) & (n.max(1) <= TOGETHER) & (n.min(1) > 0))
        own = own[np.argsort(-n[own, 1], kind="stable")]
        grid = lambda texts, size: np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), (0, size - len(t))) for t in texts])
        x, y = grid([a[i] for i in own], int(w) * 64), grid([b[i] for i in own], int(n[own, 1].max()))
        real = np.arange(int(w) * 64) < n[own, 0][:, None]
        pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8")
        full = pack(real)
        v = full.copy()
        ending = np.searchsorted(-n[own, 1], -np.arange(y.shape[1]), "left")  # pairs whose text goes on, the longest first
        for j in range(y.shape[1]):
            k = ending[j]
            old = v[:k]
            u = old & pack((x[:k] == y[:k, j : j + 1]) & real[:k])
            carry = np.zeros(k, np.uint64)
            new = np.empty_like(old)
            for q in range(int(w)):
                t = old[:, q] + u[:, q]
                s = t + carry
                carry = ((t < old[:, q]) | (s < t)).astype(np.uint64)
                new[:, q] = s | (old[:, q] & ~u[:, q])  # u is part of v, so v - u only clears bits
            v[:k] = new & full[:k]
        out[own] = n[own, 0] - np.bitwise_count(v).sum(1)
    return out


def similarity(pairs: DataFrame, left: str, right: str, name: str = "score") -> DataFrame:
    """Adds 200 * LCS / (lengths): the normalized insert-delete similarity in percent; two empty texts are 100."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = b.column(left).to_pylist(), b.column(right).to_pylist()
            total = np.array([len(p) + len(q) for p, q in zip(x, y)])
            score = np.where(total > 0, 200.0 * lcs_lengths(x, y) / np.maximum(total, 1), 100.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + f", `{name}` double"
    return pairs.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, block: str, text: str, ratio: float = NEAR_RATIO) -> DataFrame:
    """(text_a, text_b, score) of distinct texts of a block with equal first and last characters and lengths within 2.

    Texts meet once, however many rows carry them. Blocks are joined on (block, first, last, length) with the length
    spread by two to either side, an equi join; the length bound on the score is checked before the costly measure.
    """
    t = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(block).alias("g"), F.col(text).alias("t")).distinct()
    t = t.select("g", "t", F.left("t", F.lit(1)).alias("f"), F.right("t", F.lit(1)).alias("l"), F.length("t").alias("n"))
    a = t.select("g", "f", "l", F.col("t").alias("text_a"), F.col("n").alias("na"), F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n"))
    pairs = a.join(t.withColumnRenamed("t", "text_b"), ["g", "f", "l", "n"]).where(F.col("text_a") < F.col("text_b"))
    pairs = pairs.where(200.0 * F.least("na", "n") >= ratio * (F.col("na") + F.col("n"))).select("text_a", "text_b").distinct()
    return similarity(pairs, "text_a", "text_b").where(F.col("score") >= ratio)


def pearson(x: str, y: str) -> Column:
    """Pearson's r; null with fewer than three pairs or without variance on either side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    n, su, sv, suu, svv, suv = F.count(u), F.sum(u), F.sum(v), F.sum(u * u), F.sum(v * v), F.sum(u * v)
    r = F.try_divide(n * suv - su * sv, F.sqrt(F.greatest(F.lit(0.0), n * suu - su * su)) * F.sqrt(F.greatest(F.lit(0.0), n * svv - sv * sv)))
    return F.when((n >= 3) & (F.min(u) < F.max(u)) & (F.min(v) < F.max(v)), r)


def stream_digest(df: DataFrame, key: str, fields: list[str]) -> str:
    """The SHA-256 of the rows in key order, fields joined by 0x1F and each row ended by 0x0A, null as empty.

    A plain digest is of one stream by its nature: the sort is distributed, and lines then pass through the driver one
    partition at a time. For comparing with digests made elsewhere; equal keys are ordered by their line.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("line")
    total = hashlib.sha256()
    for r in df.select(F.col(key).alias("k"), line).orderBy("k", "line").select("line").toLocalIterator(prefetchPartitions=True):
        total.update(r.line.encode() + b"\n")
    return total.hexdigest()


def twins(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: whether two copies of a table, such as Parquet and CSV, have as many rows, the same keys and the same digest of ``fields``."""
    x, y = ordered_digest(a, key, fields), ordered_digest(b, key, fields)
    kx, ky = ordered_digest(a, key, [key]), ordered_digest(b, key, [key])
    named = lambda d, n: d.select(F.col("digest").alias(f"d{n}"), F.col("n").alias(f"n{n}"))
    one = named(x, 1).join(named(y, 2)).join(named(kx, 3)).join(named(ky, 4))  # one row each
    return one.select((F.col("n1") == F.col("n2")).alias("same_count"), F.col("d3").eqNullSafe(F.col("d4")).alias("same_keys"), F.col("d1").eqNullSafe(F.col("d2")).alias("same_rows"))
