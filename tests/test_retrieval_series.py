import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import retrieval as R
from cohortloom.operators import series as V


def test_similarity_golden(frame):
    df = frame([([3.0, 4.0], [6.0, 8.0]), ([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.s, 9) for r in df.select(R.similarity(F.col("a"), F.col("b"), "y").alias("s")).collect()] == [5.0, 4.0]


@pytest.mark.parametrize("block", [3, 100])
def test_ranks_against_plain(frame, block):
    rng = np.random.default_rng(2)
    c = np.round(rng.normal(size=(17, 4)))  # with ties
    q = np.round(rng.normal(size=(9, 4)))
    queries = frame([(i, q[i].tolist(), i) for i in range(9)] + [(99, q[0].tolist(), 1000)], "query_id long, vector array<double>, positive long")
    cand = frame([(i, c[i].tolist()) for i in range(17)], "candidate_id long, vector array<double>")
    got = {r.query_id: (r.pessimistic, r.optimistic) for r in R.ranks(R.rank_parts(queries, cand, "y", block)).collect()}
    y = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-8)
    s = np.round(q @ y.T, 9)
    assert got == {i: (int((s[i] >= s[i, i]).sum()), 1 + int((s[i] > s[i, i]).sum())) for i in range(9)}


@pytest.mark.parametrize("block", [7, 4096])
def test_contrastive_loss_over_all_candidates(spark, frame, tmp_path, block):
    from cohortloom.plans.retrieval import contrastive_loss

    e = np.random.default_rng(5).normal(size=(120, 4)) * 20  # scores beyond exp's range
    frame([(i, v.tolist(), "l") for i, v in enumerate(e)] + [(120, e[0].tolist(), "l"), (122, None, "l")], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, y = e[::2], e[1::2]
    s = x @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T / 0.07
    m = s.max(1)
    want = (m + np.log(np.exp(s - m[:, None]).sum(1)) - np.diag(s)).mean()
    got = contrastive_loss(spark, str(tmp_path), block).first()
    assert got.n == 61 and abs(got.loss - want) < 1e-5


def test_position_pool_is_full_across_gaps(spark, frame, tmp_path):
    from cohortloom.plans.retrieval import retrieval_position_local

    rng = np.random.default_rng(6)
    ids = [i + (0, 300, 9000, 500_000)[i // 20] for i in range(80)]  # gaps wider than any band
    e = {i: rng.normal(size=4) for i in ids}
    none = {44 + 9000, 3}  # one query and one positive without a vector
    frame([(i, None if i in none else e[i].tolist(), "l") for i in ids], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q in (i for i in ids if i % 2 == 0 and i not in none):
        near = sorted((i for i in ids if i % 2 and i not in none), key=lambda c: (c != q + 1, abs(c - q), c))[:20]
        s = {c: round(float(e[q] @ e[c] / np.linalg.norm(e[c])), 9) for c in near}
        want[q] = (20, sum(x >= s[q + 1] for x in s.values()) if q + 1 in s else 0)
    assert {r.query_id: (r.pool, r.rank) for r in retrieval_position_local(spark, str(tmp_path)).collect()} == want


def test_pool_of_targets_without_a_duration(spark, frame, tmp_path):
    from cohortloom.plans.retrieval import length_matched_pool

    rows = [("a", 10, 1.0), ("b", 11, 1.5), ("c", 10, 2.0), ("d", 11, None), ("e", 12, None), ("f", 13, 9.0), ("a", 10, None), ("g", None, 1.0)]
    frame(rows, "split_group_id string, char_count int, source_trial_eeg_duration_sec double").write.parquet(f"{tmp_path}/pl_windows.parquet")
    got = {r.split_group_id: r.pool for r in length_matched_pool(spark, str(tmp_path)).collect()}
    assert got == {"a": 3, "b": 5, "c": 3, "d": 5, "e": 4, "f": 2}


def test_metrics_goldens(frame, spark):
    m = R.metrics(frame([(1,), (2,), (10,), (20,)], "r int"), "r").first()
    assert (m.r_at_1, m.r_at_5, m.r_at_10) == (0.25, 0.5, 0.75)
    g = {r.g: (r.r_at_1, r.r_at_10) for r in R.metrics(frame([("b", 1), ("b", 10), ("a", 2), ("a", 20)], "g string, r int"), "r", ["g"]).collect()}
    assert g == {"a": (0.0, 0.5), "b": (0.5, 1.0)}
    x = R.macro(frame([(0.5,), (1.0,), (0.0,)], "r double"), ["r"]).first()
    assert (x.r_mean, x.r_std) == (0.5, 0.5) and R.macro(frame([(0.5,)], "r double"), ["r"]).first().r_std == 0
    c = spark.range(1).select(*R.chance(F.lit(20))).first()
    assert (c.r_at_1, c.r_at_5, c.r_at_10, c.median_rank) == (0.05, 0.25, 0.5, 10.5) and abs(c.mrr - sum(1 / i for i in range(1, 21)) / 20) < 1e-12


def test_scalers_use_train_only(frame):
    train = frame([("r", 0.0), ("r", 10.0)], "k string, v double")
    f = V.robust_fit(train, ["k"], "v").first()
    assert f.center == 10.0 and f.scale == 10.0
    scaled = V.robust_scale(frame([("r", 1e9), ("r", -1e9), ("q", 1.0)], "k string, v double"), V.robust_fit(train, ["k"], "v"), ["k"], "v").collect()
    assert sorted(str(r.scaled) for r in scaled) == ["-20.0", "20.0", "None"]
    s = V.standard_fit(frame([(0.0, 1), (2.0, 1)], "v double, w int"), "v", "w").first()
    assert s.center == 1.0 and abs(s.scale - 2**0.5) < 1e-12


def test_series(frame):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 12):
        v = rng.normal(size=n)
        r = frame([(v.tolist(),)], "a array<double>").select(
            V.interpolate(F.col("a"), 5, True).alias("i"), V.envelope(F.col("a"), 4).alias("e"), V.zscore(F.col("a")).alias("z"), V.crop_query(F.col("a"), 1).alias("q"), V.crop_target(F.col("a"), 1).alias("t"),
        ).first()
        assert np.allclose(r.i, np.interp(np.linspace(0, 1, 5), np.linspace(0, 1, n), v))
        if n >= 4:
            assert np.allclose(r.e, np.sqrt(np.convolve(v * v, np.ones(4) / 4, "same")))
        assert np.allclose(r.z, (v - v.mean()) / max(v.std(), 1e-8)) and r.q == v[1:].tolist() and r.t == v[:-1].tolist()


def test_geometry_and_frames(spark):
    g = spark.range(1).select(*V.geometry([10, 3, 3, 3, 3, 2, 2], [5, 2, 2, 2, 2, 2, 2])).first()
    assert (g.stride, g.field) == (320, 400)
    f = spark.range(1).select(V.frame_offsets(F.lit(10.0), F.lit(11.0), F.lit(4), F.lit(16000.0), 320, 400).alias("f")).first().f
    assert np.allclose([x.start_sec for x in f], [10, 10.02, 10.04, 10.06]) and np.allclose([x.stop_sec - x.start_sec for x in f], 0.025)


def test_band_join(frame):
    a, b = frame([(1, 1.0), (2, 5.5)], "id int, v double"), frame([(7, 1.9), (8, 4.4), (9, 6.5)], "c int, c_v double")
    assert sorted((r.id, r.c) for r in R.interval_pairs(a, b, "v", 0.4, 1.0).collect()) == [(1, 7), (2, 9)]


def test_summary_over_seeds(frame):
    rows = [(seed, k, float(seed + i)) for seed in (1, 2, 3) for i, k in enumerate(("all", "one"))]
    schema = "seed int, pool string, mrr double"
    got = {r.pool: (r.seeds, r.mrr_mean, r.mrr_std) for r in R.seed_summary(frame(rows, schema), "seed", ["pool"], ["mrr"]).collect()}
    assert got == {"all": (3, 2.0, 1.0), "one": (3, 3.0, 1.0)}
    for bad in (rows[:-1], [*rows, rows[0]]):
        with pytest.raises(ValueError):
            R.seed_summary(frame(bad, schema), "seed", ["pool"], ["mrr"])
    assert R.seed_summary(frame([], schema), "seed", ["pool"], ["mrr"]).count() == 0
