import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.functions import codepoints as cp
from cohortloom.functions import ids, text as X
from cohortloom.functions.readable import readable_rows


def _one(frame, value, expr):
    return frame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_normalize_goldens(frame):
    assert _one(frame, "Ａ B　Ｃ", X.normalize) == "ABC"
    assert _one(frame, "“你好” ……", X.normalize) == '"你好"……'
    assert _one(frame, None, X.normalize) is None and _one(frame, "", X.normalize) == ""
    trace = _one(frame, "Ａ ​B\r\nＣ", X.normalize_trace)
    assert _one(frame, "Ａ ​B\r\nＣ", X.normalize) == "ABC" and len(trace) == 5
    assert _one(frame, "a\nb", X.normalize_trace)[0].rule == "remove_linebreak"  # a bare line feed is no change of newline style


def test_counts_and_ids(frame):
    assert [_one(frame, "你，好 !", f) for f in (X.raw_count, X.visible_count, X.lit_count)] == [5, 4, 2]
    a, b = (_one(frame, x, lambda c: X.safe_filename(c, ".npz")) for x in ("a:b", "a/b"))
    assert a != b and a.startswith("a_b-")
    assert _one(frame, "///", X.safe_filename).startswith("artifact-")
    assert _one(frame, " Little  Prince ", X.normalize_identifier) == "little-prince" and _one(frame, " ", X.normalize_identifier) is None
    assert _one(frame, "x", ids.text_hash) == "sha256:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_char_spans(frame):
    rows = X.char_spans(frame([("a", "你，好！", 1.0), ("b", "", 1.0), ("c", None, 1.0)], "k string, t string, o double"), "k", "t", "o", 0.35).orderBy("position").collect()
    assert [(r.position, r.char, round(r.start_sec, 2), round(r.end_sec, 2)) for r in rows] == [(0, "你", 1.0, 1.35), (2, "好", 1.35, 1.7)]


def test_ratios():
    import pytest

    with pytest.raises(ValueError):
        ids.check_ratios(0.8, 0.2, 0.2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=8))
def test_explode_round_trip(rows):
    rows = [None if r is None else r.encode("utf-8", "ignore").decode() for r in rows]
    a = pa.array(rows, pa.string())
    assert cp.implode(*cp.explode(a)).to_pylist() == rows
    assert cp.implode(*cp.explode(a.slice(1))).to_pylist() == rows[1:]


def test_readable():
    good = ["恩洛贝在码头修好旧钟，因为山坡很远。", "It was a round ladder.", "Ìì在谷地慢慢擦亮温热的茶壶。", "「好。」", unicodedata.normalize("NFD", "Néla在驿站修好钟。")]
    bad = ["", " 　", "????????", "#REF!", "=A242", "4.5", "N/A", "(空)", "待补", "-", "TODO", "恩洛贝�好旧钟，因为山坡很远。"]
    bad += ["渡口的黑板被借走了，连磨坊主也认真说起".encode().decode("latin-1"), "渡口的黑板被借走了，连磨坊主也认真说".encode().decode("gb18030", "replace")]
    assert readable_rows(pa.array(good)).all(), [g for g, r in zip(good, readable_rows(pa.array(good))) if not r]
    assert not readable_rows(pa.array([*bad, None])).any()
    assert np.array_equal(readable_rows(pa.array([], pa.string())), np.zeros(0, bool))


def test_composition_and_case_folding_are_the_standard_ones():
    import random
    import unicodedata

    from cohortloom.functions import codepoints as cp
    from cohortloom.functions import compose

    r = random.Random(1)
    blocks = ((32, 127), (0xA0, 0x600), (0x900, 0xE00), (0x1100, 0x1200), (0x1E00, 0x2000), (0x300, 0x370), (0xAC00, 0xD7A4), (0xF900, 0xFB00))
    texts = ["".join(chr(r.randrange(*r.choice(blocks))) for _ in range(20)) for _ in range(8000)] + [None, "", "A" * 5000]
    a = pa.array(texts)
    assert compose.nfc(a).to_pylist() == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    cps, off, nulls = cp.explode(a)
    assert cp.implode(*cp.expand(cps, off, *cp.casefold_table()), nulls).to_pylist() == [None if t is None else t.casefold() for t in texts]
