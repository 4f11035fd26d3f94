"""Families and splits (2), permanent numbers (4), cutting (6)."""

import random

import pytest

from cohortloom.llm import cut, families, sample


def _components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(frame, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(35)] + [("hub", f"leaf{i}") for i in range(40)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(25)]
    edges = [e for e in edges if e[0] != e[1]]
    df = frame([*edges, *edges[:5], ("v00", "v00"), (None, "v01"), ("v01", None)], "a string, b string")
    assert {r.vertex: r.component for r in families.components(df).collect()} == _components(edges)
    assert families.components(frame([], "a string, b string")).count() == 0


def test_torn_families(frame):
    m = frame([("A ", "train"), ("a", "Train"), ("b", "validation"), ("b", "valid"), ("c", "test"), ("d", "train"), ("d", None), (None, "test"), ("e", "test"), ("e", "train")], "split_group_id string, split string")
    links = frame([("B", "a ", "accepted"), ("c", "d", "rejected"), ("a", "z", "accepted"), (None, "c", "accepted")], "left_group_id string, right_group_id string, review_status string")
    got = {r.family_id: r.splits for r in families.torn(*families.trial_families(m, links)).collect()}
    assert got == {"a": "train+valid", "e": "test+train"}


def test_rows_without_a_group_get_a_split(spark, frame, tmp_path):
    from cohortloom.llm import queries

    rows = [(i, f"r{i}", (None, " ", "A", "b")[i % 4], "train") for i in range(40)]
    frame(rows, "row_id long, record_id string, split_group_id string, split string").write.parquet(f"{tmp_path}/trial_manifest.parquet")
    frame([("a", "b", "accepted")], "left_group_id string, right_group_id string, review_status string").write.parquet(f"{tmp_path}/group_links.parquet")
    frame([(f"w{i}", (None, "", "s", "t")[i % 4]) for i in range(40)], "window_id string, subject_group_id string").write.parquet(f"{tmp_path}/pl_windows.parquet")
    got = queries.p2_assign(spark, str(tmp_path)).collect()
    assert sorted(r.row_id for r in got) == list(range(40)) and all(r.assigned for r in got)
    assert {r.row_id: r.family_id for r in got} == {i: "a" if i % 4 > 1 else f"row:{i}" for i in range(40)} and len({r.assigned for r in got if r.family_id == "a"}) == 1
    assert {r.window_id: r.subject_group_id for r in queries.p2_subjects(spark, str(tmp_path)).where("assigned IS NOT NULL").collect()} == {f"w{i}": ("s", "t")[i % 4 - 2] if i % 4 > 1 else f"window:w{i}" for i in range(40)}


def test_assign_shares(frame):
    rng = random.Random(3)
    rows = [(f"f{i}", rng.randrange(1, 30)) for i in range(3000)] + [("big", 15000), ("empty", 0), (None, 5)]
    df = frame(rows, "family string, weight long")
    got = {r.family: r.assigned for r in families.assign(df).collect()}
    assert got == {r.family: r.assigned for r in families.assign(df.repartition(7)).collect()} and len(got) == 3001
    total = sum(w for f, w in rows if f)
    share = {s: sum(w for f, w in rows if got.get(f) == s) / total for s in ("train", "valid", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["valid"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert families.assign(df.limit(0)).count() == 0


def test_sample_keeps_what_it_chose(frame):
    rows = [(f"Group-{i % 400} ", 1 + i % 5 if i % 400 < 200 else 4 + i % 2, 7 if i % 50 == 3 else 42) for i in range(2000)] + [(None, 1, 42), (" ", 2, 42)]
    df = frame(rows, "g string, load int, seed long")
    chosen = lambda d: {r.id for r in sample.replay(d, "g", "load", "seed").chosen().collect()}
    all_ = chosen(df)
    assert all_ == chosen(df.repartition(9)) and 15 < len(all_) < 70
    for k in range(1, 6):
        assert chosen(df.where(f"load <= {k}")) <= all_
    r = sample.replay(df, "g", "load", "seed")
    before = {x.id: x.u for x in r.numbers().collect()}
    from pyspark.sql import functions as F

    r.add(frame([("new", 9), ("group-1", 9), (None, 9)], "id string, first_load int"), F.lit(0.01))
    after = {x.id: x.u for x in r.numbers().collect()}
    assert {k: after[k] for k in before} == before and set(after) - set(before) == {"new"} and r.numbers().count() == len(after)
    ten = {x.id for x in r.chosen(0.1).collect()}
    assert {x.id for x in r.chosen(0.2).collect()} >= ten
    with pytest.raises(ValueError):
        r.chosen(0.1)
    assert sample.replay(df.limit(0), "g", "load", "seed").numbers().count() == 0


def test_a_register_met_again_keeps_its_numbers(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    ids = [f"g{i}" for i in range(60)]
    first = sample.Register(spark, str(tmp_path / "register"))
    first.seed(5)
    first.add(frame([(x, 1) for x in ids[:40]], "id string, first_load int"), F.when(F.col("id") == "g7", 0.5).otherwise((F.substring("id", 2, 9).cast("int") % 4) / 8))
    rows = frame([(x.upper(), k, 42) for x in ids for k in (1, 2)], "g string, load int, seed long")
    again = sample.replay(rows, "g", "load", "seed", sample.Register(spark, str(tmp_path / "register")))
    got = {r.id: r.u for r in again.numbers().collect()}
    assert len(got) == again.numbers().count() == 60 and all(got[x] == (0.5 if x == "g7" else int(x[1:]) % 4 / 8) for x in ids[:40])  # no hash is an eighth
    assert again.seed(99) == 5 and {r.id for r in again.chosen().collect()} >= {x for x in ids[:40] if int(x[1:]) % 4 == 0}
    with pytest.raises(ValueError):
        sample.Register(spark, str(tmp_path / "register")).chosen(0.05)


def test_groups_without_a_load_come_last(frame):
    rows = [("a", 2, 42), ("b", 1, 42), ("b", None, 42), ("c", None, 7), (None, None, 42)]
    got = {r.id: r.first_load for r in sample.replay(frame(rows, "g string, load int, seed long"), "g", "load", "seed").numbers().collect()}
    assert got == {"a": 2, "b": 1, "c": None}


WINDOW = "window_id string, eeg_file string, eeg_start_sample long, eeg_stop_sample long, window_sec double, stride_sec double, eeg_sampling_rate_hz int"


def test_pieces(frame, monkeypatch):
    monkeypatch.setattr(cut, "CELL", 64)
    rng = random.Random(6)
    windows = [("ok", "f", 0, 750, 3.0, 3.0, 250), ("ms", "f", 100, 1700, 2000.0, 1000.0, 250), ("none", "empty", 0, 1000, 1.0, None, 250), ("zero", "f", 0, 10, 0.0, 0.0, 250), ("null", "f", 0, None, 1.0, 1.0, 250), ("over", "f", 0, 900, 1.0, -5.0, 250)]
    windows += [(f"w{i}", f"f{i % 3}", s := rng.randrange(500), s + rng.randrange(10, 3000), rng.choice([1.0, 2.0]), rng.choice([0.5, 1.0]), 250) for i in range(40)]
    markers = [(f, k, rng.randrange(3500)) for f in ("f", "f0", "f1", "f2") for k in ("ROWS", "ROWE", "CH01") for _ in range(25)]
    m = frame([*markers, *markers[:9], ("f", "ROWS", None), ("f", None, 5)], "eeg_file string, trial_type string, sample long")
    got = {}
    for r in cut.pieces(frame([*windows, windows[1]], WINDOW).selectExpr("*", "1 AS limit", "1 AS cell"), m).orderBy("window_id", "piece").collect():
        got.setdefault(r.window_id, []).append((r.start_sample, r.stop_sample, r.cut))
    for name, f, a, z, size, stride, rate in windows:
        size, stride = (x / 1000 if x and name == "ms" else x for x in (size, stride))
        limit = round(size * rate)
        if z is None or limit <= 0 or z - a <= limit:
            assert name not in got
            continue
        over = max(0, min(limit - 1, round((size - stride) * rate) if stride is not None else 0))
        at = {k: sorted(x for g, kind, x in markers if g == f and kind == k and a < x < z) for k in ("ROWS", "ROWE", "CH01")}
        at["chapter"] = sorted({min(r) for c in at["CH01"] if (r := [x for x in at["ROWS"] if x >= c])})
        want, s = [], a
        while s + limit < z:
            for kind in ("chapter", "ROWS", "ROWE"):
                inside = [x for x in at[kind] if s + over < x <= s + limit]
                if inside:
                    want.append((s, max(inside), kind))
                    break
            else:
                want.append((s, s + limit, "sample"))
            s = want[-1][1] - over
        want.append((s, z, "end"))
        assert got[name] == want, name
    assert cut.pieces(frame([], WINDOW), m).count() == 0


def test_units_are_judged_by_the_row_and_differing_rows_all_stay(frame):
    m = frame([], "eeg_file string, trial_type string, sample long")
    w = frame([("long", "f", 0, 60_000, 150.0, 150.0, 250), ("ms", "f", 0, 1500, 2000.0, 2000.0, 250), ("two", "f", 0, 900, 1.0, 1.0, 250), ("two", "f", 100, 900, 2.0, 2.0, 250), ("two", "f", 100, 900, 2.0, 2.0, 250)], WINDOW)
    got = [(r.window_id, r.variant, r.start_sample, r.stop_sample) for r in cut.pieces(w, m).orderBy("window_id", "variant", "piece").collect()]
    assert got[:2] == [("long", 0, 0, 37_500), ("long", 0, 37_500, 60_000)] and [x for x in got if x[0] == "ms"] == [("ms", 0, 0, 500), ("ms", 0, 500, 1000), ("ms", 0, 1000, 1500)]
    assert {x[1] for x in got if x[0] == "two"} == {0, 1} and sum(x[0] == "two" for x in got) == 4 + 2
