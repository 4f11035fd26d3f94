import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.ids import hash_fraction
from cohortloom.operators import align as L
from cohortloom.operators import audit as A
from cohortloom.operators import profile as P
from cohortloom.operators import quantiles
from cohortloom.operators import splits as S


@pytest.fixture(scope="module")
def rows(spark):
    """Three cohorts of three subjects and forty contents; content 0 fuzzy, 1 without text, 2 of an uncertain variant."""
    out = []
    for c, domain in enumerate(("silent_reading", "passive_listening", "reading_aloud")):
        for s in range(3):
            for k in range(40):
                out.append((len(out), f"r{len(out)}", f"G{k} " if s else f"g{k}", f"d{c}", domain, f"sub-{s}", "fuzzy" if k == 0 else "exact", None if k == 1 else f"文{k}", "material_variant_uncertain" if k == 2 else "ok", "train"))
    m = spark.createDataFrame(out, "row_id int, record_id string, split_group_id string, dataset_version string, paradigm string, subject_id string, global_text_alignment_status string, raw_text string, quality_flag string, split string")
    return S.prepare(m).cache()


def test_quotas(frame):
    got = {r.n: (r.n_train, r.n_valid, r.n_test) for r in S.quota_counts(frame([(4,), (8,), (10,), (2,)], "n long")).collect()}
    assert got == {4: (2, 1, 1), 8: (6, 1, 1), 10: (8, 1, 1), 2: (2, 0, 0)}


def test_protocols_are_disjoint_and_accounted(rows):
    a, b, c = S.text_unseen(rows), S.diagonal(rows), S.cross_domain(rows)
    assert a.count() == b.count() == 360 and c.count() == 1080
    assert S.leakage(a, [], "content").count() == 0 and S.leakage(a, [], "entity").count() > 0
    assert S.leakage(b, [], "content").count() == 0 and S.leakage(b, [], "entity").count() == 0
    assert b.where("partition IS NULL AND reason NOT LIKE 'off_diagonal_subject_%'").count() == 0
    for x, by in ((a, []), (b, []), (c, ["protocol"])):
        assert all(r.unaccounted == 0 for r in S.accounting(x, by).collect())
    for name, _, target in S.CROSS:
        kept = c.where((F.col("protocol") == name) & F.col("partition").isNotNull())
        assert kept.where((F.col("domain") == target) & (F.col("partition") != "test")).count() == 0
    assert {r.content for r in S.strict_masks(rows).collect()} == {"g0", "g1", "g2"}


def test_seed_changes_and_repeats(rows):
    one = lambda seed: sorted((r.content, r.partition) for r in S.text_unseen(rows, seed).select("content", "partition").distinct().collect())
    assert one(42) == one(42) != one(43)


def test_hash_fraction(frame):
    import hashlib

    got = frame([("x",)], "v string").select(hash_fraction(F.lit("42"), F.col("v")).alias("f")).first().f
    assert got == int.from_bytes(hashlib.sha256(b"42\0x").digest()[:8], "big") / 2**64


def test_audit_numbers(frame):
    d = A.distribution(frame([(x,) for x in [1.0, 2.0, 3.0, 4.0, None, float("nan")]], "v double"), "v", []).first()
    assert (d.n, d.min, d.median, d.max, d.p05) == (4, 1.0, 2.5, 4.0, 1.15)
    x = frame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.1), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "g string, a double, b double")
    r = {r.g: r.r for r in x.groupBy("g").agg(A.pearson("a", "b").alias("r")).collect()}
    assert r["b"] is None and abs(r["a"] - np.corrcoef([1, 2, 3], [2, 4, 6.1])[0, 1]) < 1e-9
    import statistics

    for n in (2, 3, 7, 40):
        v = [float((i * 37) % 101) for i in range(n)]
        got = quantiles.p95_exclusive(frame([(1, x) for x in v], "g int, v double"), ["g"], "v").first().p95
        assert abs(got - statistics.quantiles(v, n=20)[18]) < 1e-9


def test_digest_ignores_partitioning(frame):
    rows = [(i, f"t{i % 7}", None if i % 3 else "x") for i in range(200)]
    df = frame(rows, "k int, a string, b string")
    one = A.ordered_digest(df, "k", ["a", "b"]).first()
    assert one == A.ordered_digest(df.repartition(7, "a"), "k", ["a", "b"]).first() != A.ordered_digest(df.where("k > 0"), "k", ["a", "b"]).first()


def test_similarity_and_near_duplicates(frame):
    assert A.lcs_lengths(["abcde", "", "aaa"], ["axcxe", "x", "aa"]).tolist() == [3, 0, 2]
    long = "山" * 30
    df = frame([("b", long + "甲水"), ("b", long + "乙水"), ("b", long + "甲水"), ("c", long + "丙水"), ("b", None), ("b", "")], "book string, t string")
    assert [(r.text_a, r.text_b) for r in A.near_duplicates(df, "book", "t").collect()] == [tuple(sorted((long + "甲水", long + "乙水")))]


def test_alignment(frame):
    seq = lambda rows: frame([("g", i, t) for i, t in enumerate(rows)], "g string, pos long, text string")
    a, b = seq(["甲", "插入", "乙", None]), seq(["甲", "乙", None])
    m = L.anchors(a, b, "g")
    assert sorted((r.source_pos, r.target_pos) for r in m.collect()) == [(0, 0), (2, 1)]
    base = "一二三四五六七八九十" * 3
    a, b = seq(["头", base + "甲", base + "乙丙", "尾"]), seq(["头", base + "甲丁", "尾"])
    got = L.gap_matches(a, b, L.anchors(a, b, "g"), "g").collect()
    assert [(r.source_pos, r.target_pos) for r in got] == [(1, 1)]
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_duration_alignment():
    unit, _ = L.align_durations(np.array([1.0, 2.0, 3.0]), np.array([1.0, 3.0]), 0.25)
    assert unit[0] == 0 and unit[2] == 1 and unit[1] == -1
    rng = np.random.default_rng(4)
    for _ in range(30):  # against the plain recurrence
        x, y = rng.uniform(0, 5, rng.integers(1, 7)), rng.uniform(0, 5, rng.integers(1, 7))
        off, scale = np.median(x) - np.median(y), 0.25
        t = np.zeros((len(x) + 1, len(y) + 1))
        t[:, 0], t[0] = np.arange(len(x) + 1) * 2.0, np.arange(len(y) + 1) * 2.0
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = min(t[i, j] + min(abs(x[i] - y[j] - off) / scale, 5.0), t[i, j + 1] + 2, t[i + 1, j] + 2)
        unit, _ = L.align_durations(x, y, 0.25)
        used = unit[unit >= 0]
        assert (np.diff(used) > 0).all()


MANIFEST = "row_id long, load_no int, audio_file string, audio_start_sec double, audio_end_sec double, eeg_start_sample long, eeg_end_sample long, eeg_sampling_rate double, eeg_duration_sec double, quality_flag string, raw_text string"


def test_contract_violations(frame):
    ok = (1, 1, "x", 1.0, 2.0, 0, 250, 250.0, 1.0, "ok", "恩洛在码头修好旧钟。")
    put = lambda i, **k: (i, *[k.get(f.split()[0], v) for f, v in list(zip(MANIFEST.split(", "), ok))[1:]])
    cases = [
        ok, put(2, audio_start_sec=None), put(3, audio_start_sec=None, audio_end_sec=None, audio_file=None), put(4, audio_start_sec=float("nan")), put(5, audio_start_sec=11.0, audio_end_sec=12.0), put(6, audio_file="unknown"),
        put(7, audio_start_sec=2.0), put(8, eeg_duration_sec=1.0000005), put(9, eeg_duration_sec=1.1), put(10, eeg_sampling_rate=0.0), put(11, quality_flag="missing_text|audio_events_missing"),
        put(12, quality_flag="audio_events_missing|missing_text"), put(13, quality_flag="ok|missing_text"), put(14, quality_flag=None), put(15, quality_flag="Missing_text"), put(16, quality_flag=""), put(17, raw_text="N/A"), put(18, raw_text=None), put(2, audio_start_sec=None),
    ]
    audio = frame([("x", 10, 100), ("x", 10, 100), (None, 1, 1)], "audio_file string, sample_rate_hz int, frame_count long")
    got = {(r.row_id, r.column_name) for r in P.violations(frame(cases, MANIFEST).withColumn("column_name", F.lit("clash")), audio).collect()}
    bad_audio = {(i, "audio_start_sec") for i in (2, 4, 5, 6, 7)}
    assert got == bad_audio | {(i, "eeg_duration_sec") for i in (9, 10)} | {(i, "quality_flag") for i in (11, 13, 14, 15, 16)} | {(17, "raw_text")}
    assert P.violations(frame([], MANIFEST), audio).count() == 0


def test_profile_and_drift(frame):
    rng = np.random.default_rng(1)
    rows = [(i, 1 + i % 2, float(rng.normal(3 * (i % 2))), float(rng.normal()), None if i % 5 else "v") for i in range(600)]
    df = frame(rows, "row_id long, load_no int, moved double, still double, s string")
    p = {(r.load, r.column_name): r for r in P.profile(df, "load_no").collect()}
    assert p[1, "s"].n_null == 240 and p[1, "s"].distinct_count == 1 and p[2, "moved"].distinct_count == 300 and p[1, "row_id"].min_number == 0
    d = {r.column_name: r for r in P.drift(df, "load_no", "row_id", ["moved", "still"]).collect()}
    assert d[None].auc > 0.9 and d["moved"].loss > 0.3 and abs(d["still"].loss) < 0.05
    assert P.drift(df.where("load_no = 1"), "load_no", "row_id", ["moved"]).count() == 0
    assert P.profile(df.limit(0), "load_no").count() == 0


def test_drift_of_equally_long_values(frame):
    rows = [(i, 1 + i % 2, f"ChineseEEG{1 + i % 2}", f"ChineseEEG{1 + i // 2 % 2}", f"id{i:05d}") for i in range(1200)]
    df = frame(rows, "row_id long, load_no int, dataset_version string, still string, unique string")
    d = {r.column_name: r for r in P.drift(df, "load_no", "row_id", ["dataset_version", "still", "unique"]).collect()}
    assert d[None].auc > 0.99 and d["dataset_version"].loss > 0.4 and abs(d["still"].loss) < 0.05 and abs(d["unique"].loss) < 0.05


def test_drift_of_spread_and_against_refits(frame):
    """Normal(0, 1) against normal(0, 4) has no change of the mean; the ablations equal separate fits without the column."""
    rng = np.random.default_rng(3)
    rows = [(i, 1 + i % 2, float(rng.normal(0, 1 + 3 * (i % 2))), float(rng.normal()), float(rng.normal(0.5 * (i % 2)))) for i in range(6000)]
    df = frame(rows, "row_id long, load_no int, spread double, still double, moved double")
    d = {r.column_name: r for r in P.drift(df, "load_no", "row_id", ["spread", "still", "moved"]).collect()}
    assert d[None].auc > 0.8 and d["spread"].loss > 0.15 and abs(d["still"].loss) < 0.01
    for c in ("spread", "still", "moved"):
        alone = P.drift(df, "load_no", "row_id", [x for x in ("spread", "still", "moved") if x != c]).where("column_name IS NULL").first().auc
        assert abs(d[c].auc_without - alone) < 0.005, c


def test_drift_takes_many_loads_in_blocks(frame, monkeypatch):
    rows = [(i, i % 7, float(i % 7 == 4) * 3 + (i * 37 % 11) / 11) for i in range(2100)]
    df = frame(rows, "row_id long, load_no int, x double")
    one = {(r.load_before, r.column_name): round(r.auc, 6) for r in P.drift(df, "load_no", "row_id", ["x"]).collect()}
    monkeypatch.setattr(P, "PAIRS", 2)
    two = {(r.load_before, r.column_name): round(r.auc, 2) for r in P.drift(df, "load_no", "row_id", ["x"]).collect()}
    assert set(one) == set(two) and len(two) == 12 and two[3, None] > 0.95 and two[4, None] > 0.95 and two[0, None] < 0.7


def test_profile_has_every_column(spark, frame, tmp_path):
    from cohortloom.plans.quality import p5_profile

    at = "timestamp '2031-01-21 09:00:00'"
    rows = [(i, load, "x", 1.0, 2.0, 0, 250, 250.0, 1.0, "ok", "恩洛在码头修好旧钟。") for i, load in ((1, 1), (1, 1), (2, 1), (3, 2))]
    m = frame(rows, MANIFEST).selectExpr("*", f"if(row_id = 2, null, {at}) recorded_at", f"{at} loaded_at")
    m.write.parquet(f"{tmp_path}/trial_manifest.parquet")
    frame([("x", 10, 100)], "audio_file string, sample_rate_hz int, frame_count long").write.parquet(f"{tmp_path}/audio_files.parquet")
    p = {(r.load, r.column_name): r for r in p5_profile(spark, str(tmp_path)).collect()}
    assert set(p) == {(load, c) for load in (1, 2) for c in m.columns}
    assert (p[1, "row_id"].n_rows, p[1, "row_id"].distinct_count, p[1, "row_id"].max_number) == (3, 2, 2)
    assert p[1, "recorded_at"].n_null == 1 and p[2, "recorded_at"].min_number == 1926752400 and p[1, "loaded_at"].distinct_count == 1 and p[2, "load_no"].max_number == 2


def test_common_subsequences():
    rng = np.random.default_rng(7)
    word = lambda n: "".join(chr(0x4E00 + x) for x in rng.integers(0, 5, n))
    sizes = [(0, 0), (0, 5), (5, 0), (1, 1), (63, 64), (64, 65), (128, 30), (130, 200), (1025, 40), (7, 1030)]
    a, b = [word(x) for x, _ in sizes], [word(y) for _, y in sizes]

    def plain(x, y):
        p = [0] * (len(y) + 1)
        for c in x:
            q = [0]
            for j, e in enumerate(y, 1):
                q.append(p[j - 1] + 1 if c == e else max(p[j], q[-1]))
            p = q
        return p[-1]

    assert A.lcs_lengths(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)] and A.lcs_lengths([], []).tolist() == []


def test_ordered_index(frame):
    from cohortloom.operators.joins import ordered_index

    rows = [(f"v{i * 37 % 500:03d}",) for i in range(1200)] + [(None,)]
    df = frame(rows, "v string")
    got = {r.v: r.i for r in ordered_index(df.repartition(7), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({r[0] for r in rows if r[0]}))} and ordered_index(df.limit(0), "v").count() == 0


def test_small_cohorts(frame):
    from cohortloom.operators import splits

    rows = frame([("a", f"a{i}") for i in range(5)] + [("b", "b0"), ("b", "b1")], "cohort string, entity string")
    got = {r.entity: r.partition for r in splits.entity_partition(rows).collect()}
    assert got["b0"] == got["b1"] == "train" and len(set(got.values())) == 3
    with pytest.raises(ValueError):
        splits.entity_partition(rows, strict=True)
    assert splits.entity_partition(rows.where("cohort = 'a'"), strict=True).count() == 5
