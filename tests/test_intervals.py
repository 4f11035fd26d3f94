import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import intervals as I

SCHEMA = "s string, sample long, kind string, value string"


def _loop(rows):
    """Plain loop over a sorted stream."""
    pairs, context, pending = [], None, None
    for sample, kind in rows:
        if kind.startswith("CH"):
            context = kind
        elif kind == "ROWS":
            pending = sample
        elif kind == "ROWE":
            if pending is not None and sample > pending:
                pairs.append((pending, sample, len(pairs), context))
            pending = None
    return pairs


@pytest.mark.parametrize("rows,pairs,starts,ends", [
    ([(5, "ROWE"), (10, "ROWS"), (12, "ROWS"), (20, "ROWE"), (30, "ROWS")], [(12, 20)], 2, 1), ([(1, "ROWE"), (10, "ROWS"), (20, "ROWE")], [(10, 20)], 0, 1),
    ([(10, "ROWS"), (12, "ROWS"), (20, "ROWE")], [(12, 20)], 1, 0), ([(10, "ROWE"), (10, "ROWS")], [], 1, 1), ([], [], None, None),
])
def test_pair_goldens(frame, rows, pairs, starts, ends):
    df = frame([("a", s, k, None) for s, k in rows], SCHEMA)
    assert [(r.start_sample, r.end_sample) for r in I.pair_markers(df, "s", "sample", "kind", ["value"]).collect()] == pairs
    o = I.orphans(df, "s", "sample", "kind", ["value"]).collect()
    assert [(r.orphan_starts, r.orphan_ends) for r in o] == ([] if starts is None else [(starts, ends)])


def test_pair_random_streams_across_cells(frame, monkeypatch):
    monkeypatch.setattr(I, "CELL", 7)
    rng = random.Random(5)
    streams = {f"s{i}": sorted((rng.randrange(60), rng.choice(["ROWS", "ROWE", "CH01", "CH02", "bad"])) for _ in range(rng.randrange(40))) for i in range(30)}
    df = frame([(s, a, k, None) for s, rows in streams.items() for a, k in rows] + [(None, 3, "ROWS", None), ("s0", None, "ROWS", None)], SCHEMA)
    got = {}
    for r in I.pair_markers(df, "s", "sample", "kind", ["kind"]).collect():
        got.setdefault(r.s, []).append((r.start_sample, r.end_sample, r.pair_index, r.context))
    want = {s: p for s, rows in streams.items() if (p := _loop(rows))}
    assert {s: sorted(p) for s, p in got.items()} == {s: sorted(p) for s, p in want.items()}


def test_asof(frame):
    left = frame([("a", 5.0, 1), ("a", 10.0, 2), ("b", 1.0, 3), (None, 1.0, 4)], "k string, t double, id int")
    right = frame([("a", 6.0, 60), ("a", 10.0, 100), ("a", 10.0, 90), ("b", 2.0, 7)], "k string, t double, v int")
    got = {r.id: r.v for r in I.asof_backward(left, right, "k", "t", "t", "v", cell=3).collect()}
    assert got == {1: None, 2: 100, 3: None, 4: None}


def test_block_windows(frame):
    b = frame([(1, 100, 350), (2, 0, 60), (3, 5, 5)], "id int, start long, stop long")
    drop = [(r.window_start, r.window_stop) for r in I.block_windows(b.where("id = 1"), 100, 50).orderBy("window_start").collect()]
    assert drop == [(100, 200), (150, 250), (200, 300), (250, 350)]
    pad = I.block_windows(b.where("id > 1"), 100, 50, "pad").collect()
    assert [(r.window_start, r.window_stop, r.valid, r.padded) for r in pad] == [(0, 60, 60, 40)]
    with pytest.raises(ValueError):
        I.block_windows(b, 0, 1)


def _trial(frame, **more):
    row = {"row_id": 1, "eeg_start_sample": 1000, "eeg_end_sample": 2500, "eeg_sampling_rate": 250.0, "audio_file": "x", "audio_start_sec": 1.0, "audio_end_sec": 7.0} | more
    return frame([tuple(row.values())], "row_id int, eeg_start_sample long, eeg_end_sample long, eeg_sampling_rate double, audio_file string, audio_start_sec double, audio_end_sec double")


def test_sync_windows(frame):
    audio = frame([("x", 12000, 120000)], "audio_file string, sample_rate_hz int, frame_count long")
    run = lambda t, *spec: I.sync_windows(I.sync_plan(t, audio, *spec), spec[1], ["row_id"]).orderBy("k").collect()
    w = run(_trial(frame), 3.0, 3.0, 0.0)
    assert [(r.eeg_start, r.eeg_stop, r.audio_start / r.audio_rate, r.audio_stop / r.audio_rate) for r in w] == [(1000, 1750, 1, 4), (1750, 2500, 4, 7)]
    assert [r.offset_sec for r in run(_trial(frame), 3.0, 0.5, 0.0)] == [0, 0.5, 1, 1.5, 2, 2.5, 3]
    assert [(r.eeg_start, r.audio_start) for r in run(_trial(frame), 3.0, 3.0, 200.0)] == [(1050, 12000)]
    assert run(_trial(frame), 3.0, 3.0, -100.0) == []
    reason = lambda t: I.sync_plan(t, audio, 3.0, 3.0, 0.0).first().reason
    assert reason(_trial(frame, audio_start_sec=None)) == I.REASONS[0] and reason(_trial(frame, audio_file="y")) == I.REASONS[1]
    assert reason(_trial(frame, audio_end_sec=11.0)) == I.REASONS[2] and reason(_trial(frame, eeg_end_sample=1500, audio_end_sec=3.0)) == I.REASONS[3]


def test_streaming_pairs(spark, frame, tmp_path):
    from cohortloom.streaming.pairing import pair_stream

    rows = [("a", s, k, "2031-01-01 00:00:00") for s, k in [(5, "ROWE"), (10, "ROWS"), (12, "ROWS"), (20, "ROWE")]]
    frame(rows, "s string, sample long, kind string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("s string, sample long, kind string, at timestamp").parquet(str(tmp_path / "in"))
    q = pair_stream(src, "s", "sample", "kind", "at").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.kind, r.start_sample, r.end_sample) for r in spark.table("pairs").collect())
    assert [x for x in got if x[0] == "pair"] == [("pair", 12, 20)] and sum(x[0] == "orphan_start" for x in got) == 1 and sum(x[0] == "orphan_end" for x in got) == 1
