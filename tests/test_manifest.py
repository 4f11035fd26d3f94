"""Building trial records: findings, flags, units, spans, groups, segmented audio."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import audit as A
from cohortloom.operators import manifest as M


def test_reasons_and_their_flags(frame):
    names = [f"E{i}" for i in range(1, 129)]
    schema = "eeg_file string, sampling_rate_hz double, channel_count int, channel_names array<string>, data_size_remainder int, header_data_reference_exists boolean, header_marker_reference_exists boolean, events_tsv_exists boolean, orphan_row_starts int, orphan_row_ends int, event_count int, annotation_count_vmrk int"
    df = frame([("good", 250.0, 128, names, 0, True, True, True, 0, 0, 9, 9), ("bad", 256.0, 64, names[:64], 3, False, False, False, 0, 1, 9, 8), ("null", *[None] * 11)], schema)
    r = df.withColumn("reasons", M.recording_reasons(250.0, set(df.columns)))
    got = {x.eeg_file: (x.reasons, x.flags) for x in r.select("eeg_file", "reasons", M.flags_of(F.col("reasons")).alias("flags")).collect()}
    assert got["good"] == ([], []) and got["null"] == ([], [])
    assert got["bad"][0] == ["unexpected_sampling_rate", "unexpected_channel_count", "unexpected_channel_names", "invalid_binary_shape", "broken_header_data_reference", "broken_header_marker_reference", "missing_events_tsv", "unpaired_row_marker", "events_vmrk_count_mismatch"]
    assert got["bad"][1] == ["broken_brainvision_reference", "events_vmrk_count_mismatch", "invalid_brainvision_binary", "missing_events_tsv", "orphan_row_event_in_recording"]


def test_record_flags(frame):
    schema = "k string, base array<string>, dataset string, book string, paradigm string, duration double, prefix boolean, text boolean, alignment string, global_alignment string, audio boolean"
    rows = [
        ("ok", None, "ChineseEEG2", "b", "silent_reading", 1.0, None, True, "exact", "exact", False),
        ("short", ["missing_events_tsv"], "ChineseEEG1", "b", "silent_reading", 0.05, True, True, "fuzzy", "unresolved", False),
        ("none", None, "ChineseEEG2", "garnettdream", "passive_listening", 1.0, False, False, None, None, False),
        ("aloud", None, "ChineseEEG2", "b", "reading_aloud", None, None, True, "exact", None, True),
    ]
    df = frame(rows, schema)
    facts = {c: F.col(c) for c in df.columns[2:]}
    got = {r.k: r.f for r in df.select("k", M.record_flags(F.col("base"), facts).alias("f")).collect()}
    assert got == {
        "ok": "ok", "short": "event_text_count_mismatch|implausible_eeg_trial_duration|missing_events_tsv|prechapter_trial_unresolved|unresolved_text_alignment",
        "none": "material_variant_uncertain|missing_text|pl_audio_mapping_unverified|unresolved_text_alignment", "aloud": "ra_audio_boundary_unavailable",
    }


def test_speakers_and_books(frame):
    df = frame([("passive_listening", "03", "GranettDream"), ("passive_listening", "11", "LittlePrince"), ("reading_aloud", "07", None), ("silent_reading", "01", "x")], "p string, s string, b string")
    got = [tuple(r) for r in df.select(M.speaker_of(F.col("p"), F.col("s")), M.book_of(F.col("b"))).collect()]
    assert got == [("f1", "garnettdream"), ("m1", "littleprince"), ("07", None), (None, "x")]


def test_units_by_position_by_duration_or_not_at_all(frame):
    letters = [4, 12, 7, 20, 9, 15]
    pair = lambda f, i, n: (f, i * 10_000, i * 10_000 + n * 25, i, None)  # at 100 Hz and 0.25 s a letter
    pairs = frame([pair("whole", i, n) for i, n in enumerate(letters)] + [pair("gap", k, letters[i]) for k, i in enumerate((0, 1, 3, 4, 5))] + [pair("bare", 0, 4)], "eeg_file string, start_sample long, end_sample long, pair_index long, context string")
    units = frame([(f, 10 + i, "字" * n, i) for f in ("whole", "gap") for i, n in enumerate(letters)], "eeg_file string, source_excel_row int, raw_text string, position int")
    rates = frame([(f, 100.0) for f in ("whole", "gap", "bare")], "eeg_file string, rate double")
    got = {(r.eeg_file, r.pair_index): (r.status, r.source_excel_row) for r in M.matched_units(pairs, units, rates, 0.25).collect()}
    assert len(got) == 12 and all(got["whole", i] == ("exact", 10 + i) for i in range(6))
    assert got["gap", 2] == ("fuzzy", 13) and got["gap", 3] == ("fuzzy", 14) and got["bare", 0] == ("unresolved", None)
    assert M.matched_units(pairs.limit(0), units, rates, 0.25).count() == 0


def test_units_of_a_range(frame):
    units = frame([("b", i, f"t{i}") for i in (*range(60, 70), 80)], "book_id string, source_excel_row int, raw_text string")
    ranges = frame([("f", "b", 62, 66), ("g", "b", 64, 69)], "eeg_file string, book_id string, lo int, hi int")
    got = {(r.eeg_file, r.position): r.source_excel_row for r in M.run_units(ranges, units, strict=True).collect()}
    assert got == {**{("f", i): 62 + i for i in range(5)}, **{("g", i): 64 + i for i in range(6)}}
    with pytest.raises(ValueError):
        M.run_units(frame([("h", "b", 68, 72)], "eeg_file string, book_id string, lo int, hi int"), units, strict=True)


def test_audio_of_the_run_before_that_of_the_speaker(frame):
    spans = frame([("f1", "11", "a", "x.wav", 1.0, 2.0), ("f1", None, "a", "y.wav", 3.0, 4.0), ("f1", None, "b", "z.wav", 5.0, 6.0)], "speaker_id string, run_id string, global_text_id string, audio_file string, start_sec double, end_sec double")
    rows = frame([(1, "f1", "11", "a"), (2, "f1", "12", "a"), (3, "f1", "11", "b"), (4, "m1", "11", "a"), (5, None, None, None)], "k int, speaker_id string, run_id string, global_text_id string")
    got = {r.k: (r.audio_file, r.audio_match) for r in M.with_audio(rows, spans).collect()}
    assert got == {1: ("x.wav", "exact"), 2: ("y.wav", "fallback"), 3: ("z.wav", "fallback"), 4: (None, None), 5: (None, None)}


def test_groups_of_records(frame):
    df = frame([("b", "v", "text"), ("b", "w", "text"), ("b", "v", None), ("b", "v", ""), ("b", "w", None)], "b string, v string, t string")
    a, b, c, d, e = (r[0] for r in df.select(M.split_group(F.col("b"), F.col("v"), F.col("t"))).collect())
    assert a == b and c == d and len({a, c, e}) == 3


def test_segmented_audio(frame):
    files = frame([("s", 0, 0.0, 10.0), ("s", 1, 10.0, 10.0), ("t", 0, 0.0, 10.0)], "timeline string, audio_index int, start_sec double, duration_sec double")
    events = frame([("s", 1.0, 3.0, "a"), ("s", 4.0, 9.0, "b"), ("s", 12.0, 20.3, "c"), ("t", 1.0, 11.0, "d"), ("t", 2.0, 3.0, "e"), ("u", 0.0, 1.0, "f")], "timeline string, start_sec double, end_sec double, event_id string")
    expected = frame([("s", 0, 2), ("s", 1, 1), ("t", 0, 2)], "timeline string, audio_index int, n_units int")
    spans, report = M.segmented_spans(files, events, expected)
    assert {r.event_id: (r.audio_index, round(r.start_sec, 6), r.end_sec, r.clamped) for r in spans.collect()} == {"a": (0, 1.0, 3.0, False), "b": (0, 4.0, 9.0, False), "c": (1, 2.0, 10.0, True)}
    assert {(r.timeline, r.audio_index): (r.n_events, r.n_invalid, r.n_clamped, r.file_valid, r.timeline_valid) for r in report.collect()} == {("s", 0): (2, 0, 0, True, True), ("s", 1): (1, 0, 1, True, True), ("t", 0): (2, 1, 0, False, False)}


def test_twins_and_stream_digest(frame):
    import hashlib

    rows = [(2, "b", None), (1, "a", 5), (3, "c", 7)]
    df = frame(rows, "k int, t string, n int")
    assert A.stream_digest(df.repartition(3), "k", ["t", "n"]) == hashlib.sha256(b"a\x1f5\nb\x1f\nc\x1f7\n").hexdigest()
    assert tuple(A.twins(df, df.repartition(2), "k", ["t", "n"]).first()) == (True, True, True)
    assert tuple(A.twins(df, df.withColumn("n", F.lit(5)), "k", ["t", "n"]).first()) == (True, True, False)
    assert tuple(A.twins(df, df.where("k < 3"), "k", ["t", "n"]).first()) == (False, False, False)
