"""Pooling, standardization, envelopes, metadata baselines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import series as V


def test_overlap_mean(frame):
    frames = frame([("a", 0.0, 1.0, [1.0, 10.0]), ("a", 0.5, 1.5, [3.0, 20.0]), ("a", 9.0, 10.0, [5.0, 30.0]), ("b", 0.0, 9.5, [7.0, 40.0]), (None, 0.0, 9.0, [0.0, 0.0])], "k string, start double, stop double, vector array<double>")
    spans = frame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 9.0), ("b", 0, 1.0, 8.0), ("a", 2, 20.0, 21.0), (None, 0, 0.0, 9.0)], "k string, span int, a double, z double")
    for cell in (0.3, 2.0, 50.0):
        got = {(r.k, r.span): (r.n, r.vector) for r in V.overlap_mean(spans, frames, "k", cell).collect()}
        assert got == {("a", 0): (2, [2.0, 15.0]), ("a", 1): (1, [3.0, 20.0]), ("b", 0): (1, [7.0, 40.0])}
    with pytest.raises(ValueError):
        V.overlap_mean(spans, frames, "k", 2.0, strict=True)
    assert V.overlap_mean(spans.where("span < 2 AND k IS NOT NULL"), frames, "k", 2.0, strict=True).count() == 3
    assert V.overlap_mean(spans.limit(0), frames, "k", 2.0).count() == 0


def test_standardize_and_envelope(frame):
    rng = np.random.default_rng(2)
    rows = [(0, rng.normal(size=30).tolist()), (1, [2.0] * 5), (2, [1.0]), (3, None), (4, [])]
    df = frame(rows, "k int, a array<double>")
    got = {r.k: (r.s, r.e) for r in df.select("k", V.standardize(F.col("a")).alias("s"), V.envelope(F.col("a"), 7).alias("e")).collect()}
    for k, a in rows[:3]:
        a = np.array(a)
        c = a - a.mean()
        assert np.allclose(got[k][0], c / c.std() if c.std() > 1e-8 else c)
        wide = np.convolve(np.pad(a * a, 7), np.ones(7) / 7, "same")[7 : 7 + len(a)]
        assert np.allclose(got[k][1], np.sqrt(wide))
    assert got[3] == (None, None) and got[4] == ([], None)


def test_metadata_baselines_against_all_pairs(spark, tmp_path, frame):
    from cohortloom.plans import retrieval as P

    rows = [(f"w{i:02d}", f"t{i % 4}", i % 3, float(i % 2), 0, None if i % 5 == 0 else i % 4, "f1", "test" if i else " Test ") for i in range(16)]
    frame(rows, "window_id string, audio_target_id string, stimulus_position int, window_sec double, padded_eeg_samples long, char_count int, speaker_id string, split string").write.parquet(f"{tmp_path}/pl_windows.parquet")
    got = {r.baseline: r for r in P.shortcut_report(spark, str(tmp_path)).collect()}
    firsts = {t: min(r for r in rows if r[1] == t) for t in {r[1] for r in rows}}
    for name, at in (("duration_only", 3), ("padding_mask_only", 4), ("character_count_only", 5), ("subject_id_only", 6)):
        ranks = [sum((c[at] == r[at]) >= (firsts[r[1]][at] == r[at]) for c in firsts.values()) for r in rows]
        assert got[name].n == 16 and abs(got[name].mrr - np.mean(1 / np.array(ranks))) < 1e-6 and got[name].median_rank == np.median(ranks), name
    sets = {t: {r[2] for r in rows if r[1] == t} for t in firsts}
    ranks = [sum(r[2] in v for v in sets.values()) for r in rows]
    assert abs(got["sentence_position_only"].mrr - np.mean(1 / np.array(ranks))) < 1e-6
