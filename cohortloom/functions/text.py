"""Text normalization, counts, identifiers and per-character timing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortloom.functions import codepoints as cp
from cohortloom.functions import compose

# The six invisible characters, the punctuation map, and the white space of the normalization contract.
INVISIBLE = r"[\x{ad}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]"
PUNCTUATION = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'", "‛": "'", "′": "'",
    "〈": "《", "〉": "》", "﹤": "《", "﹥": "》", "﹐": "，", "﹑": "、", "﹒": "。", "⋯": "…",
}
WHITE_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Unassigned code points differ between regex engines, so category C is named by its assigned parts.
UNLIT = r"[\p{P}\p{Z}\p{Cc}\p{Cf}\p{Cs}\p{Co}]"
WIDE = r"[\x{ff01}-\x{ff5e}\x{3000}]"
RULES = ("newline_style_to_lf", "remove_invisible_format_character", "unicode_nfc", "fullwidth_ascii_to_ascii", "punctuation_variant_canonicalization", "remove_linebreak", "remove_whitespace")
_WIDE_FROM = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_WIDE_TO = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)) + " "


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return compose.nfc(texts)


@F.arrow_udf(StringType())
def _casefold(texts: pa.Array) -> pa.Array:
    cps, off, nulls = cp.explode(texts)
    return cp.implode(*cp.expand(cps, off, *cp.casefold_table()), nulls).cast(pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition; the one step without a built-in function."""
    return _nfc(c)


def _stages(c: Column) -> list[Column]:
    a = F.regexp_replace(c, r"\r\n?", "\n")
    b = F.regexp_replace(a, INVISIBLE, "")
    n = nfc(b)
    w = F.translate(n, _WIDE_FROM, _WIDE_TO)
    p = F.translate(w, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    s = F.replace(p, F.lit("\n"), F.lit(""))
    return [c, a, b, n, w, p, s, F.regexp_replace(s, WHITE_SPACE, "")]


def normalize(c: Column) -> Column:
    """The seven steps in their fixed order; null gives null."""
    return _stages(c)[-1]


def normalize_trace(c: Column) -> Column:
    """Array of (rule, count) of the steps that changed the text; canonical composition counts as 1."""
    x, a, b, n, w, p, s, z = _stages(c)
    length = lambda y: F.length(y)
    counts = [
        F.when(a != x, F.regexp_count(x, F.lit(r"\r\n?|\n"))).otherwise(0), length(a) - length(b), F.when(n != b, 1).otherwise(0),
        F.regexp_count(n, F.lit(WIDE)), F.regexp_count(w, F.lit("[" + "".join(PUNCTUATION) + "]")), length(p) - length(s), length(s) - length(z),
    ]
    return F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), k.cast("int").alias("count")) for r, k in zip(RULES, counts)]), lambda e: e["count"] > 0)


def trace_json(trace: Column) -> Column:
    """Compact JSON with sorted keys, as stored in manifests."""
    return F.to_json(F.transform(trace, lambda e: F.struct(e["count"].alias("count"), e["rule"].alias("rule"))))


def normalize_identifier(c: Column) -> Column:
    """NFC, strip, case fold, white space runs to a hyphen; blank gives null instead of an error."""
    s = F.regexp_replace(F.regexp_replace(nfc(c), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", ""), "^$", "")
    out = F.regexp_replace(_casefold(s), f"{WHITE_SPACE}+", "-")
    return F.when(out != "", out)


def raw_count(c: Column) -> Column:
    return F.length(c)


def visible_count(c: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(c, WHITE_SPACE, ""))


def lit_count(c: Column) -> Column:
    """Code points that are neither punctuation, separators nor control or format characters."""
    return F.length(F.regexp_replace(c, UNLIT, ""))


def word_count(c: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    """Tokens of a pattern; a dictionary segmenter can be put in its place by passing another count column."""
    return F.regexp_count(c, F.lit(pattern))


def is_missing(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, WHITE_SPACE, "") == "")


def safe_filename(c: Column, suffix: str = "") -> Column:
    """Readable stem of at most 80 characters, 12 hex digits of the hash, and a suffix."""
    stem = F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), 1, 80)
    return F.concat(F.when(stem == "", F.lit("artifact")).otherwise(stem), F.lit("-"), F.substring(F.sha2(c.cast("binary"), 256), 1, 12), F.lit(suffix))


def char_spans(df, key: str, text: str, onset: str, pace: float):
    """One row per lit character: its position in the text, its ordinal and its half-open time span at a fixed pace.

    Skipped characters keep their positions. Null and empty texts give no rows.
    """
    from pyspark.sql.window import Window

    chars = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, onset, F.posexplode(F.split(text, "")).alias("position", "char"))
    lit = chars.where((F.col("char") != "") & ~F.col("char").rlike(UNLIT))
    k = F.row_number().over(Window.partitionBy(key).orderBy("position")) - 1
    return lit.select(key, "position", "char", k.cast("int").alias("ordinal"), (F.col(onset) + k * pace).alias("start_sec"), (F.col(onset) + (k + 1) * pace).alias("end_sec"))
