"""Leaks (7), mixing (8), reading levels (9)."""

import os
import random

import numpy as np
import pytest

from cohortloom.llm import leak, mixing, reading
from cohortloom.llm.features import WIDTH, features


def test_distance_against_plain():
    rng = np.random.default_rng(1)
    for size in (8, 16, 32, 64):
        p, t = rng.integers(1, 4, (60, size)).astype(np.uint32), rng.integers(1, 4, (60, 90)).astype(np.uint32)

        def plain(a, b):
            prev = [0] * (len(b) + 1)
            for i, x in enumerate(a, 1):
                cur = [i]
                for j, y in enumerate(b, 1):
                    cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
                prev = cur
            return min(prev)

        assert leak.myers(p, t)[0].tolist() == [plain(a, b) for a, b in zip(p.tolist(), t.tolist())]


def _texts(rng, han, n):
    if han:
        return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n // 6))


def _altered(rng, t, rate):
    return "".join("" if (x := rng.random()) < rate / 3 else c + "の" if x < 2 * rate / 3 else "ん" if x < rate else c for c in t)


def test_leaks(frame, monkeypatch):
    monkeypatch.setattr(leak, "ITEM_LETTERS", 3000)  # several sets of items
    rng = random.Random(5)
    items = [(i, _texts(rng, i % 2, 120 if i % 2 else 300)) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        i, t = items[d % 30]
        noise = lambda: _texts(rng, i % 2, rng.randrange(50, 900))  # noqa: B023, E731
        half = len(t) // 2
        body = [t, _altered(rng, t, 0.06), t[: int(half * 1.3)], t[: int(len(t) * 0.35)] + noise() + t[int(len(t) * 0.6) :], t[: len(t) // 4], ""][d % 6]
        if d % 6 == 5:  # the same words in another order
            words = list(t) if i % 2 else t.split(" ")
            rng.shuffle(words)
            body = ("" if i % 2 else " ").join(words)
        docs.append((d, noise() + ("" if i % 2 else " ").join(("", body.upper() if d % 4 else body, "")) + noise()))
        if d % 6 < 4:
            want.add((d, i))
    docs += [(100, None), (101, ""), (102, " ，。"), (0, docs[0][1])]
    got = leak.leaks(frame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS cover"), frame([*items, (90, None), (91, ""), (92, "短")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    empty = frame([], "doc_id long, text string")
    assert leak.leaks(empty, frame(items, "item_id long, text string")).count() == 0 and leak.leaks(frame(docs, "doc_id long, text string"), frame([], "item_id long, text string")).count() == 0


def _spread(t, every):
    """One letter replaced in each ``every``."""
    return "".join("q" if i % every == every - 1 and c != "q" else c for i, c in enumerate(t))


def test_spread_edits_and_split_passages(frame):
    rng = random.Random(8)
    letters = lambda han, n: "".join(chr(0x4E00 + rng.randrange(3000)) if han else rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, letters(i % 2, 90 if i % 2 else 200)) for i in range(40)]
    docs, want, other = [], set(), set()
    for i, t in items:
        noise = lambda: letters(i % 2, 150)  # noqa: B023, E731
        n = len(t)
        for every in (5, 6, 7, 8, 9, 10, 11):
            docs.append((len(docs), noise() + _spread(t, every) + noise()))
            want.add((len(docs) - 1, i))
        for a, b in ((38, 14), (35, 17), (40, 15), (30, 25)):
            docs.append((len(docs), noise() + t[: n * a // 100] + noise() + t[n - n * b // 100 :] + noise()))
            want.add((len(docs) - 1, i))
        docs.append((len(docs), noise() + t[: n * 30 // 100] + noise()))
        other.add((len(docs) - 1, i))
    got = {(r.doc_id, r.item_id) for r in leak.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.99 * len(want) and not got - want and not got & other


def test_short_items_stand_whole(frame):
    docs = frame([(1, "Well, the Cat sat."), (2, "the cat sits"), (3, None)], "doc_id long, text string")
    items = frame([(7, "the cat sat"), (8, "!"), (9, "zz")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.cover) for r in leak.leaks(docs, items).collect()] == [(1, 7, 1.0)]


def test_a_very_long_text_is_searched_to_its_end(frame):
    rng = random.Random(9)
    item = _texts(rng, True, 100)
    long = _texts(rng, True, 1_500_000) + item
    assert leak.leaks(frame([(1, long), (2, "短")], "doc_id long, text string"), frame([(7, item)], "item_id long, text string")).count() == 1


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")
def test_mix(frame):
    rng = random.Random(2)
    words = {"alpha": "river stone cloud bridge", "beta": "tensor kernel matrix operator", "rare": "ledger audit invoice"}
    docs = []
    for i in range(600):
        s = "rare" if i % 60 == 0 else ("alpha", "beta")[i % 2]
        docs.append((i, " ".join(rng.choice(words[s].split()) for _ in range(rng.randrange(20, 200))), (s, s.upper() + " ", s)[i % 3]))
    docs += [(900, None, "alpha"), (901, "", "beta"), (902, "river stone cloud", None), (903, "tensor", "other")]
    df = frame(docs, "doc_id long, text string, source string")
    targets = frame([("alpha", 0.3, 2), ("beta", 0.68, 3), ("rare", 0.02, 4)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets).collect()
    assert len(out) == len(docs)
    cap = {"alpha": 2, "beta": 3, "rare": 4}
    assert all(0 <= r.repeats <= cap.get(r.source, 3) for r in out)
    total = sum(r.tokens for r in out)
    got = {s: sum(r.tokens * r.repeats for r in out if r.source == s) / total for s in cap}
    assert abs(got["alpha"] - 0.3) < 0.01 and abs(got["beta"] - 0.68) < 0.01 and abs(got["rare"] - 0.02) < 0.003
    assert {r.doc_id: r.repeats for r in out} == {r.doc_id: r.repeats for r in mixing.mix(df.repartition(5), targets).collect()}
    tight = frame([("alpha", 0.2, 1), ("beta", 0.3, 1), ("rare", 0.5, 2)], "source string, target_share double, max_repeats int")
    short = {r.source: r for r in mixing.shares(mixing.mix(df, tight), tight).collect()}
    assert short["rare"].most_repeats == 2 and short["rare"].actual_share < 0.1
    assert mixing.mix(df, targets.limit(0)).count() == 0 and mixing.mix(df.limit(0), targets).count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")
def test_the_text_of_mislabelled_documents_moves_the_mix(frame):
    rng = random.Random(12)
    words = {"alpha": "river stone cloud bridge meadow", "beta": "tensor kernel matrix operator gradient"}
    docs = []
    for i in range(1200):
        true = ("alpha", "beta")[i % 2]
        said = "beta" if true == "alpha" and i % 10 == 0 else true  # a fifth of alpha's texts say beta
        docs.append((i, " ".join(rng.choice(words[true].split()) for _ in range(rng.randrange(60, 90))), said))
    df = frame(docs, "doc_id long, text string, source string")
    targets = frame([("alpha", 0.5, 3), ("beta", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets).collect()
    total = sum(r.tokens for r in out)
    assert all(abs(sum(r.tokens * r.repeats for r in out if r.source == s) / total - 0.5) < 0.01 for s in words)  # by stated source, exact
    said_beta = [(r.rate, r.doc_id % 2) for r in out if r.source == "beta"]
    own, strange = (np.mean([x for x, odd in said_beta if odd == k]) for k in (1, 0))
    assert own > 1.03 * strange  # the text tells which documents of a source are taken
    by_text = lambda rate: sum(r.tokens * rate(r) for r in out if r.doc_id % 2 == 1) / total
    stated_only = {s: 0.5 * total / sum(r.tokens for r in out if r.source == s) for s in words}
    assert abs(by_text(lambda r: r.rate) - 0.5) < abs(by_text(lambda r: stated_only[r.source]) - 0.5)  # and brings the totals by text nearer to their targets
    fit = mixing.fitted(df, targets).first()
    assert fit.accuracy > 0.85 and 0.05 < fit.outvoted < 0.15 and fit.residual_stated < 0.01


def test_isotonic():
    k, v = reading.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 4.0]), np.array([2.0, 1.0, 4.0, 2.0, 5.0]))
    assert np.interp([1, 2, 3, 4], k, v).tolist() == [1.0, 8 / 3, 8 / 3, 5.0]


def test_reading_levels(frame):
    rng = random.Random(4)
    easy, hard = ["cat", "dog", "red", "hat", "sun"], ["approximation", "heteroscedastic", "phenomenological", "disambiguation"]

    def text(level):
        out = []
        for _ in range(6):
            n = 4 + 3 * level
            out.append(" ".join(rng.choice(hard) if rng.random() < (level - 1) / 5 else rng.choice(easy) for _ in range(n)) + ".")
        return " ".join(out)

    truth = {i: 1 + i % 5 for i in range(500)}
    docs = frame([(i, text(v)) for i, v in truth.items()] + [(900, None), (901, " "), (902, "123 456")], "doc_id long, text string").selectExpr("*", "9 AS level", "1 AS y")
    labels = frame([(i, v) for i, v in truth.items() if i < 250] + [(3, None), (5, truth[5]), (None, 3)], "doc_id long, level int")
    got = {r.doc_id: r.level for r in reading.levels(docs, labels).collect()}
    unseen = [abs(got[i] - truth[i]) for i in range(250, 500)]
    assert np.mean([x == 0 for x in unseen]) > 0.8 and max(unseen) <= 1
    assert got[900] is got[901] is got[902] is None
    assert all(r.level is None for r in reading.levels(docs, labels.limit(0)).collect()) and reading.levels(docs.limit(0), labels).count() == 0


def test_features():
    import pyarrow as pa

    x = features(pa.array(["我喜欢船。", None, "", "A cat, a dog.", "漢" * 5000]))
    assert x.shape == (5, WIDTH) and not x[1].any() and not x[2].any() and x[3, 0] == 1 and np.isfinite(x).all()
