import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import guards as G
from cohortloom.operators import series as V


def test_configs_and_artifacts(tmp_path, spark):
    a, b = {"x": {"y": 1, "z": 2}, "s": 1}, {"x": {"y": 1, "z": 3}, "s": 2, "n": None}
    assert G.differences(a, b) == ["n", "s", "x.z"] and G.differences(a, b, ["s", "n", "x.z"]) == []
    (tmp_path / "f").write_bytes(b"abc")
    G.require_frozen(str(tmp_path / "f"), hashlib.sha256(b"abc").hexdigest())
    for call in (lambda: G.require_frozen(str(tmp_path / "f"), "00"), lambda: G.require_untouched({"filter": True}), lambda: G.require_claim(True, "speech_timing"), lambda: G.findings(spark, [("a", "fatal", "b", "c")])):
        with pytest.raises(ValueError):
            call()
    G.require_untouched({"filter": False})
    assert G.findings(spark, []).count() == 0


def test_small_shapes(frame):
    r = frame([([[1.0, 2.0], [3.0, 4.0], [5.0, 8.0]], 200.0, 12.5)], "m array<array<double>>, d double, e double").select(
        V.layer_mean(F.col("m"), [0, -1]).alias("l"), V.time_pool(F.col("m")).alias("p"), V.centred(F.element_at("m", 2)).alias("c"), G.delay_label(F.col("d")).alias("d"), G.delay_label(F.col("e")).alias("e"),
    ).first()
    assert (r.l, r.p, r.c, r.d, r.e) == ([3.0, 5.0], [1.5, 3.5, 6.5], [-0.5, 0.5], "200ms", "12_5ms")


def test_loss_and_schedule(frame):
    s = np.array([[1.0, 2.0], [0.5, 3.0]])
    df = frame([(i, j, float(s[i, j])) for i in range(2) for j in range(2)], "q int, c int, s double")
    lse = lambda m: np.log(np.exp(m).sum(1))
    want = ((lse(s) - np.diag(s)).mean() + (lse(s.T) - np.diag(s)).mean()) / 2
    assert abs(G.symmetric_loss(df, "q", "c", "s", F.col("q") == F.col("c")).first().loss - want) < 1e-12
    b = frame([(0, 0, "a"), (0, 0, "b"), (0, 1, "c")], "r int, k int, i string")
    assert G.schedule_digest(b, ["r", "k"], "i").first() == G.schedule_digest(b.orderBy(F.desc("i")), ["r", "k"], "i").first()


def test_protocol_inputs_partitions_and_datasets(frame):
    schema = "record_id string, split_group_id string, manifest_schema_version string"
    good = frame([("a", "g", "1"), ("b", "g", "1")], schema)
    G.require_protocol_input(good, ["record_id"])
    for rows in ([], [("a", "g", "1"), ("a", "g", "1")], [("", "g", "1")], [("a", None, "1")], [("a", "g", "1"), ("b", "g", "2")]):
        with pytest.raises(ValueError):
            G.require_protocol_input(frame(rows, schema), ["record_id"])
    with pytest.raises(ValueError):
        G.require_protocol_input(good, ["record_id", "other"])
    parts = frame([("a", "train"), ("b", "test"), ("c", None)], "record_id string, partition string")
    G.require_partitions("A_text", parts, good)
    for setting, rows in (("B_x", [("a", "train"), ("b", "test")]), ("A_x", [("a", "train"), ("a", "test"), ("b", "test")]), ("A_x", [("a", "train")]), ("A_x", [("a", "train"), ("b", "test"), ("z", "test")])):
        with pytest.raises(ValueError):
            G.require_partitions(setting, frame(rows, "record_id string, partition string"), good)
    windows = frame([("e1", "t1", "train", 250, 750), ("e2", "t2", "train", 250, 750), ("e2", "t3", "test", 250, 750)], "entity string, target_id string, split string, rate int, n_samples int")
    entities = frame([("e1", 0), ("e2", 1)], "entity string, index int")
    feats = frame([("t1", "train", [1.0, 2.0]), ("t2", "train", [1.0, 2.0])], "target_id string, split string, values array<double>")
    scaler = frame([(1.0,)], "center double")
    check = lambda w=windows, p="train", e=entities, f=feats, c=10, s=scaler, n=2: G.require_dataset(w, p, e, f, c, s, n)
    check()
    for bad in ({"p": "dev"}, {"p": "validation"}, {"c": 750}, {"s": None}, {"n": 3}, {"f": feats.limit(1)}, {"e": entities.limit(1)}, {"e": frame([("e1", 0), ("e2", 2)], "entity string, index int")}, {"w": windows.withColumn("rate", F.monotonically_increasing_id())}):
        with pytest.raises(ValueError):
            check(**bad)
