"""Stable identifiers and hash fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def text_hash(c: Column) -> Column:
    """``sha256:`` and the hexadecimal digest of the UTF-8 bytes; null for null."""
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def json_string(c: Column) -> Column:
    """A JSON string literal with non-ASCII kept; null gives ``null``."""
    body = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    return F.regexp_extract(body, r'(?s)^\{"x":(.*)\}$', 1)


def stable_id(version: str, *parts: Column, digits: int = 24) -> Column:
    """``version-`` and the first hex digits of the hash of the compact JSON array [version, *parts]."""
    inner = F.concat_ws(",", F.lit(f'"{version}"'), *[json_string(p) for p in parts])
    return F.concat(F.lit(version + "-"), F.substring(F.sha2(F.concat(F.lit("["), inner, F.lit("]")).cast("binary"), 256), 1, digits))


def joined_id(*parts: Column, digits: int = 24) -> Column:
    """First hex digits of the hash of NUL-joined parts; null where a part is null."""
    full = parts[0]
    for p in parts[1:]:
        full = F.concat(full, F.lit(NUL), p)
    return F.substring(F.sha2(full.cast("binary"), 256), 1, digits)


def hash_fraction(seed: Column, value: Column) -> Column:
    """The first 8 bytes of SHA-256(seed NUL value), big endian, over 2^64: uniform in [0, 1)."""
    digest = F.sha2(F.concat(seed, F.lit(NUL), value).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def partition_of(fraction: Column, train: float = 0.8, valid: float = 0.1, name: str = "valid") -> Column:
    return F.when(fraction < train, F.lit("train")).when(fraction < train + valid, F.lit(name)).otherwise(F.lit("test"))


def check_ratios(train: float, valid: float, test: float) -> None:
    if min(train, valid, test) < 0 or train <= 0 or test <= 0 or abs(train + valid + test - 1) > 1e-12:
        raise ValueError("ratios must be non-negative, sum to 1, and train and test be positive")
