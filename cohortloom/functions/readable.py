"""Is a text a readable sentence, or blank, a filler, a spreadsheet residue or a wrong decoding?"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cohortloom.functions import codepoints as cp

# Fillers that stand where a text should be (compared in lower case without outer white space and brackets).
FILLERS = (
    "n/a", "na", "nan", "nil", "none", "null", "todo", "tbd", "tba", "undefined", "missing", "empty", "blank", "unknown", "test", "xxx",
    "空", "缺", "无", "待补", "待定", "缺失", "暂无", "未知", "未录", "未录入", "同上", "略", "空白", "无内容",
)
#: A text with at least this share of question marks lost its characters on the way.
QUESTION_SHARE = 0.25
#: Han characters outside the frequent levels: above this share the text was decoded with the wrong table.
RARE_SHARE = 0.5
#: Fewer letters than this, without an end mark, are no sentence.
LEAST_LETTERS = 4


@lru_cache(maxsize=None)
def _tables() -> dict[str, np.ndarray]:
    cat = cp.categories()
    major = cat.astype("S1")
    han = cp.is_han()
    compat = np.zeros(cp.LIMIT, bool)
    compat[0x2E80:0x2FE0] = compat[0xF900:0xFB00] = compat[0x2F800:0x2FA20] = True
    broken = np.isin(cat, [b"Cc", b"Co", b"Cs", b"Cn"])
    broken[[9, 10, 11, 12, 13]] = False
    broken[0xFFFD] = True
    unseen = np.isin(cat, [b"Zs", b"Zl", b"Zp", b"Cf"])
    unseen[[9, 10, 11, 12, 13]] = True
    unseen[0xFE00:0xFE10] = True
    lead, tail = np.zeros(cp.LIMIT, bool), np.zeros(cp.LIMIT, bool)
    lead[0xC2:0xF5] = True
    tail[0x80:0xC0] = True
    tail[[0xA0, 0xAD, 0xAB, 0xBB, 0xB7]] = False
    for b in range(0x80, 0xA0):
        try:
            tail[ord(bytes([b]).decode("cp1252"))] = True
        except UnicodeDecodeError:
            pass
    end = np.zeros(cp.LIMIT, bool)
    end[[ord(c) for c in ".!?…。！？；;"]] = True
    high = np.zeros(cp.LIMIT, bool)
    high[0xA1:0x100] = True
    return {
        "broken": broken, "unseen": unseen, "letter": (major == b"L") | compat, "han": han, "rare": han & ~cp.frequent_han(),
        "question": np.isin(np.arange(cp.LIMIT), [0x3F, 0xFF1F]), "lead": lead, "tail": tail, "end": end, "high": high,
    }


def readable_rows(texts: pa.Array) -> np.ndarray:
    """True for each readable sentence, False for every other text; null rows are False here.

    Not readable: blank; holding replacement, control, private or unassigned characters; mostly question marks;
    without letters; a filler word or a spreadsheet formula or error; UTF-8 read as a single-byte table or as a
    double-byte Chinese table; fewer than four letters without an end mark; a single bare Latin word.
    """
    t = _tables()
    cps, off, nulls = cp.explode(texts)
    c = {k: v[cps] for k, v in t.items()}
    n = {k: cp.row_counts(v, off) for k, v in c.items()}
    length = np.diff(off)
    seen = length - n["unseen"]
    pair = np.zeros(len(cps), bool)
    if len(cps) > 1:
        pair[:-1] = c["lead"][:-1] & c["tail"][1:]
        ends = off[1:-1]
        pair[ends[(ends > 0) & (ends < len(cps))] - 1] = False
    pairs = cp.row_counts(pair, off)
    bad = nulls | (seen == 0) | (n["broken"] > 0) | (n["letter"] == 0)
    bad |= (n["question"] >= 3) & (n["question"] > QUESTION_SHARE * seen)
    bad |= (n["han"] > 0) & (n["rare"] > RARE_SHARE * n["han"])
    bad |= (pairs >= 2) & (4 * pairs >= n["letter"])
    bad |= (n["high"] > 0.6 * seen) & (seen >= 8)
    bad |= (n["letter"] < LEAST_LETTERS) & (n["end"] == 0)
    short = np.flatnonzero(~bad & (seen < 24))  # fillers and residues are short
    if len(short):
        few = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        few = pc.utf8_trim(pc.utf8_lower(pc.utf8_trim_whitespace(few.take(pa.array(short)))), characters="()（）[]【】<>《》{} ")
        residue = pc.or_(pc.starts_with(few, "="), pc.starts_with(few, "#"))
        bare = pc.and_(pc.string_is_ascii(few), pc.invert(pc.match_substring_regex(few, "[ ,.!?]")))
        bad[short] |= np.asarray(pc.or_(pc.or_(pc.is_in(few, value_set=pa.array(FILLERS, few.type)), residue), bare))
    return ~bad


@F.arrow_udf(BooleanType())
def _readable(texts: pa.Array) -> pa.Array:
    return pa.array(readable_rows(texts))


def readable(text: Column) -> Column:
    """Column form of ``readable_rows``; null gives false."""
    return _readable(text)
