"""One form for texts that print alike.

A batch of Arrow text becomes one numpy array of code points. Lookup tables over all code points give each its
expansion (gathers and offsets), marks are put in canonical order and composed array-wise. No call is made per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortloom.functions import codepoints as cp
from cohortloom.functions import compose

# Characters of other scripts or blocks with the shape of a Latin letter or a common Han character.
SAME_SHAPE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ι": "i", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ѵ": "V", "Һ": "h", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Armenian
    "Ս": "U", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p",
    # Latin variants
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ſ": "f",
    # hyphens
    "‐": "-", "‑": "-",
    # CJK radicals with an equivalent ideograph (the other block of radicals has compatibility mappings)
    "⺁": "厂", "⺇": "几", "⺌": "小", "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺑": "尣", "⺒": "巳", "⺓": "幺", "⺛": "旡", "⺝": "月", "⺟": "母", "⺠": "民",
    "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺯": "糹", "⺰": "纟",
    "⺱": "罓", "⺲": "罒", "⺳": "㓁", "⺴": "㓁", "⺵": "冈", "⺶": "羊", "⺷": "羊", "⺸": "羋", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹",
    "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅",
    "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣",
    "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻲": "亀",
}
# Kinds of compatibility mapping that keep the shape; those of kind <compat> only in the ranges given.
SHAPE_KEPT = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<font>")
COMPAT_RANGES = ((0x2E80, 0x2FE0), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4), (0xB5, 0xB6), (0x17F, 0x180))
# Format characters that do print, and blank or invisible characters outside the space and format categories.
PRINTED_FORMAT = (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
INVISIBLE = (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x1810), 0x2800, 0x17B4, 0x17B5)
#: Code points that TESTDATA drops from both sides before texts are compared.
PLAIN_SPACE = "[ \\t\\r\\n]"


def _unseen(i: int, category: str) -> bool:
    return category in ("Zs", "Zl", "Zp") or (category == "Cf" and i not in PRINTED_FORMAT) or i in _INVISIBLE or 9 <= i <= 13 or 28 <= i <= 31 or i == 0x85


_INVISIBLE = frozenset(INVISIBLE)


def _form(c: str, depth: int = 0) -> str:
    i = ord(c)
    if _unseen(i, unicodedata.category(c)):
        return ""
    if 0xAC00 <= i < 0xD7A4:
        return c
    out = []
    for x in unicodedata.normalize("NFD", c):
        kind, _, rest = unicodedata.decomposition(x).partition(" ")
        fits = kind in SHAPE_KEPT or (kind == "<compat>" and any(a <= ord(x) < b for a, b in COMPAT_RANGES))
        if fits and depth < 4:
            out += [_form(chr(int(h, 16)), depth + 1) for h in rest.split()]
        else:
            out.append(SAME_SHAPE.get(x, x))
    return "".join(out)


@lru_cache(maxsize=None)
def tables() -> dict[str, np.ndarray]:
    """Expansion length and start of each code point in ``flat``, and what comparison drops."""
    size, start, flat = np.ones(cp.LIMIT, np.int64), np.zeros(cp.LIMIT, np.int64), [np.arange(cp.LIMIT, dtype=np.uint32)]
    start[:] = np.arange(cp.LIMIT)
    at = cp.LIMIT
    category = cp.categories()
    plain = np.isin(category, [b"Cn", b"Co", b"Cs"])
    plain[0x3400:0x4DC0] = plain[0x4E00:0xA000] = plain[0xAC00:0xD7A4] = plain[0x20000:0x2F800] = True
    plain[list(INVISIBLE)] = False
    for i in np.flatnonzero(~plain):
        c = chr(i)
        f = _form(c)
        if f != c:
            size[i], start[i] = len(f), at
            flat.append(np.array([ord(x) for x in f], np.uint32))
            at += len(f)
    major = category.astype("S1")
    dropped = np.isin(major, [b"P", b"Z"]) | np.isin(category, [b"Cc", b"Cf"])
    return {"size": size, "start": start, "flat": np.concatenate(flat), "dropped": dropped}


def fold_codepoints(texts: pa.Array, compare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = tables()
    cps, off, nulls = cp.explode(texts)
    cps, off = compose.compose(*cp.expand(cps, off, t["size"], t["start"], t["flat"]))
    if compare:
        cps, off = compose.keep(cps, off, ~t["dropped"][cps])
    return cps, off, nulls


def fold_array(texts: pa.Array, compare: bool = False) -> pa.Array:
    """The form of each text; null stays null. ``compare``: also without punctuation and white space."""
    out = cp.implode(*fold_codepoints(texts, compare))
    return out.cast(pa.string())


@F.arrow_udf(StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return fold_array(texts)


@F.arrow_udf(StringType())
def _fold_compare(texts: pa.Array) -> pa.Array:
    return fold_array(texts, True)


def fold(text: Column) -> Column:
    """One form of a text: canonical composition, ordinary width, same-shaped characters joined, without spaces and invisible characters.

    Null gives null, blank text gives an empty form. Another letter, accent or punctuation mark keeps another form.
    """
    return _fold(text)


def fold_compare(text: Column) -> Column:
    """``fold`` without punctuation, for comparing wordings."""
    return _fold_compare(text)
