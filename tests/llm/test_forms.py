"""Folding (3), overlaps across splits (1)."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.functions import codepoints as cp
from cohortloom.llm import alike, overlap
from cohortloom.llm.fmindex import FmIndex, suffix_array
from cohortloom.llm.fold import _form, fold_array

LETTERS = st.text(st.sampled_from("Aaéẹ́̀̈ốoū漢가각が​ Ａ，．⼈аο ﬁⅷ"), max_size=10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=6))
def test_fold_equals_row_by_row(rows):
    want = [None if r is None else unicodedata.normalize("NFC", "".join(map(_form, r))) for r in rows]
    assert fold_array(pa.array(rows, pa.string())).to_pylist() == want
    assert fold_array(fold_array(pa.array(rows, pa.string()))).to_pylist() == want  # a form is its own form


def test_fold_goldens():
    same = [("ＡＢ１２，", "AB12,"), ("á", "á"), ("⼈⽊", "人木"), ("Каѕе", "Kase"), ("a​b　c ", "abc"), ("里", "里"), ("ὸ", "ò")]
    other = [("己", "已"), ("é", "e"), ("。", "."), ("«", "《"), ("①", "1"), ("²", "2")]
    form = lambda x: fold_array(pa.array([x])).to_pylist()[0]
    assert all(form(a) == form(b) for a, b in same) and all(form(a) != form(b) for a, b in other)


def test_alike(frame):
    s = "恩洛在码头修好旧钟，因为山坡很远。"
    trials = frame([("a", s), ("b", s.replace("，", ",")), ("c", "恩洛 在码头修好旧钟，因为山坡很远。\n"), ("d", None), ("e", "????"), ("f", s.replace("钟", "镜")), ("b", s.replace("，", ",")), ("g", s[:3] + "​" + s[3:])], "record_id string, raw_text string")
    units = frame([(1, s), (2, None), (3, ""), (4, s.replace("人", "⼈").replace("山", "⼭"))], "unit_id long, normalized_text string")
    got = {(r.record_id, r.unit_id) for r in alike.alike(trials.selectExpr("*", "1 AS f"), "record_id", "raw_text", units, "unit_id", "normalized_text").collect()}
    assert got == {("b", 1), ("g", 1), ("a", 4), ("b", 4), ("c", 4), ("g", 4)}
    assert alike.alike(trials.limit(0), "record_id", "raw_text", units, "unit_id", "normalized_text").count() == 0


def test_index_finds_all_occurrences():
    rng = random.Random(3)
    for _ in range(40):
        docs = ["".join(rng.choice("abc漢") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        cps, off, _ = cp.explode(pa.array(docs))
        x = FmIndex.load(FmIndex.build(cps, off).save())
        pats = ["".join(rng.choice("abc漢z") for _ in range(rng.randrange(1, 4))) for _ in range(20)]
        pc, po, _ = cp.explode(pa.array(pats))
        lo, hi = x.search(x.symbols(pc), po[:-1], po[1:])
        for p, a, b in zip(pats, lo, hi):
            pos = x.locate(np.arange(a, b))
            doc = np.searchsorted(x.starts, pos, "right") - 1
            got = sorted(zip(doc.tolist(), (pos - x.starts[doc]).tolist()))
            assert got == sorted((d, i) for d, t in enumerate(docs) for i in range(len(t)) if t.startswith(p, i))
    t = np.array([2, 1, 2, 1, 0])
    assert suffix_array(t).tolist() == sorted(range(5), key=lambda i: t[i:].tolist())


def _lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_near_links_against_all_pairs(frame, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_CHARS", 300)  # several shards and blocks
    monkeypatch.setattr(overlap, "STEP_HITS", 50)
    rng = random.Random(8)
    base = ["".join(rng.choice("山水风雨人木石田") for _ in range(n)) for n in (4, 9, 10, 19, 20, 27, 40, 41, 64)]
    forms = set(base)
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.randrange(0, len(b) // 8 + 2)):
                i = rng.randrange(len(t) + 1)
                k = rng.randrange(3)
                t[i : i + (k > 0)] = [] if k == 1 else [rng.choice("山水风雨人木石田")]
            forms.add("".join(t) or "山")
    rows = [(f, i % 3 != 0, i % 2 == 0) for i, f in enumerate(sorted(forms))]
    got = {r.eval_form: (r.n_links, r.edits, r.train_form) for r in overlap.near_links(frame(rows, "form string, train boolean, held boolean")).collect()}
    want = {}
    for a, _, h in rows:
        near = [(d, b) for b, t, _ in rows if h and t and 10 * (d := _lev(a, b)) <= max(len(a), len(b))]
        if near:
            want[a] = (len(near), *min(near))
    assert got == want and sum(x[0] for x in got.values()) > 40
    assert overlap.near_links(frame([], "form string, train boolean, held boolean")).count() == 0


def test_many_links_are_one_row_a_form(frame):
    rng = random.Random(4)
    stem = "".join(rng.choice("山水风雨人木石田") for _ in range(60))
    rows = [(stem[:i] + "门窗" + stem[i:] + chr(0x5000 + j) + chr(0x5000 + i), j % 2 == 0, j % 2 == 1) for i in range(20) for j in range(20)]
    got = overlap.near_links(frame(rows, "form string, train boolean, held boolean")).collect()
    assert len(got) == 200 and sum(r.n_links for r in got) == 40_000


def test_banded_distances():
    rng = np.random.default_rng(5)
    a = [rng.integers(1, 4, rng.integers(0, 30)) for _ in range(300)]
    b = [np.delete(x, rng.integers(0, max(1, len(x)), rng.integers(0, 3)) % max(1, len(x))) if i % 2 and len(x) else rng.integers(1, 4, len(x) + rng.integers(0, 3)) for i, x in enumerate(a)]
    off = lambda x: np.append(0, np.cumsum([len(y) for y in x]))
    k = rng.integers(0, 6, 300)
    got = overlap.distances(np.concatenate(a), off(a)[:-1], np.diff(off(a)), np.concatenate(b), off(b)[:-1], np.diff(off(b)), k.copy())
    assert got.tolist() == [min(int(e) + 1, _lev(x.tolist(), y.tolist())) for x, y, e in zip(a, b, k)]


def test_overlapping_records(frame):
    s, u = "恩洛在码头修好旧钟，因为山坡很远，风也很大。", "卡娜在阁楼数过铁锚，却没有人提到旧信和石榴。"
    rows = [("t", s, "Train "), ("v", s.replace("钟", "镜"), "validation"), ("w", s.replace(",", ""), "TEST"), ("x", u, "test"), ("n", None, "test"), ("m", None, "train"), ("q", "N/A", "train"), ("r", "N/A", "valid"), ("y", u, None), ("v", s, "valid")]
    df = frame(rows, "record_id string, raw_text string, split string").selectExpr("*", "'clash' AS form", "'clash' AS text")
    assert {r.record_id for r in overlap.overlapping(df, "record_id").collect()} == {"v", "w"}
    texts, links = overlap.overlaps(df)
    rep = {r.clean_split: (r.n_rows, r.n_overlap, r.n_exact) for r in overlap.report(df, links, texts, []).collect()}
    assert rep == {"valid": (3, 2, 1), "test": (3, 1, 1)}
