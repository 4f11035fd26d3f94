"""Queries that build trial records from markers, text units and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import text as X
from cohortloom.operators import intervals as I
from cohortloom.operators import manifest as M
from cohortloom.plans.intervals import _R
from cohortloom.store import table

_RATE = 250.0
_PACE = M.PACES["ChineseEEG2"]


def _listening(s, d):
    return table(s, d, "trial_manifest").where("paradigm = 'passive_listening'")


def _recordings(s, d):
    return _listening(s, d).groupBy("eeg_file").agg(F.max("eeg_sampling_rate").alias("sampling_rate_hz"))


def _base(s, d):
    f = M.recording_facts(table(s, d, "marker_stream"), _recordings(s, d))
    return f.withColumn("reasons", M.recording_reasons(_RATE, set(f.columns)))


def anomaly_flags(s, d):
    """What is wrong with each listening recording, and the flags that its records get from it."""
    return _base(s, d).select("eeg_file", F.array_join("reasons", "|").alias("reasons"), F.array_join(M.flags_of(F.col("reasons")), "|").alias("flags"))


def _first_chapter(s, d):
    m = table(s, d, "marker_stream").where(F.trim("trial_type").rlike(I.CONTEXT))
    return m.groupBy("eeg_file").agg(F.min("sample").alias("first_context"))


def derive_flags(s, d):
    """The flags of every delivered row, from the flags of its recording and its own fields."""
    t = table(s, d, "trial_manifest").select("row_id", "eeg_file", "dataset_version", "session_id", "paradigm", "eeg_start_sample", "eeg_end_sample", "eeg_sampling_rate", "raw_text", "text_alignment_status", "global_text_alignment_status", "audio_start_sec")
    base = _base(s, d).select("eeg_file", M.flags_of(F.col("reasons")).alias("base"))
    x = t.join(base, "eeg_file", "left").join(_first_chapter(s, d), "eeg_file", "left")
    facts = {
        "dataset": F.col("dataset_version"), "book": M.book_of(F.col("session_id")), "paradigm": F.col("paradigm"), "duration": F.try_divide((F.col("eeg_end_sample") - F.col("eeg_start_sample")).cast("double"), "eeg_sampling_rate"),
        "prefix": F.col("eeg_start_sample") < F.col("first_context"), "text": F.col("raw_text").isNotNull(), "alignment": F.col("text_alignment_status"), "global_alignment": F.col("global_text_alignment_status"),
        "audio": F.col("audio_start_sec").isNotNull(),
    }
    return x.select("row_id", M.record_flags(F.col("base"), facts).alias("flags"))


def speaker_variant(s, d):
    """Speaker and book of every recording, from its paradigm, subject and session."""
    t = table(s, d, "trial_manifest").select("eeg_file", "paradigm", "subject_id", "session_id").distinct()
    subject = F.regexp_extract("subject_id", r"([0-9]{2})$", 1)
    return t.select("eeg_file", M.book_of(F.col("session_id")).alias("book"), M.speaker_of(F.col("paradigm"), subject).alias("speaker"))


def _ranges(s, d):
    """The reviewed rows of each listening recording: those that its delivered trials span."""
    return _listening(s, d).where("source_excel_row IS NOT NULL").groupBy("eeg_file").agg(F.min("book_id").alias("book_id"), F.min("run_id").alias("run_id"), F.min("speaker_id").alias("speaker_id"), F.min("material_variant").alias("variant"), F.min("source_excel_row").alias("lo"), F.max("source_excel_row").alias("hi"))


def _units(s, d):
    u = table(s, d, "material_units").where("NOT is_chapter_marker AND source_excel_row IS NOT NULL")
    fields = ("sentence_id", "global_text_id", "raw_text", "split_identity_normalized_text", "global_alignment_status")
    return u.groupBy("book_id", "source_excel_row").agg(F.min_by(F.struct(*fields), "unit_id").alias("u")).select("book_id", "source_excel_row", "u.*")


def build_manifest(s, d):
    """A record for every legal pair of a listening recording: text unit by position, audio span, split group and flags."""
    order = ("onset", "trial_type", "value")
    pairs = I.pair_markers(table(s, d, "marker_stream"), "eeg_file", "sample", "trial_type", order)
    ranges = _ranges(s, d)
    units = M.run_units(ranges.select("eeg_file", "book_id", "lo", "hi"), _units(s, d)).drop("book_id")
    rates = _recordings(s, d).select("eeg_file", F.lit(_RATE).alias("rate"))
    x = M.matched_units(pairs, units, rates, _PACE).join(ranges.drop("lo", "hi"), "eeg_file")
    ok = _listening(s, d).where("audio_file IS NOT NULL AND quality_flag = 'ok' AND global_text_id IS NOT NULL AND speaker_id IS NOT NULL")
    span = lambda run: ok.select("speaker_id", run.alias("run_id"), "global_text_id", "audio_file", F.col("audio_start_sec").alias("start_sec"), F.col("audio_end_sec").alias("end_sec"))
    x = M.with_audio(x, span(F.col("run_id")).unionByName(span(F.lit(None).cast("string"))))
    base = _base(s, d).select("eeg_file", M.flags_of(F.col("reasons")).alias("base"))
    x = x.join(base, "eeg_file", "left").join(_first_chapter(s, d), "eeg_file", "left")
    has = F.col("raw_text").isNotNull()
    facts = {
        "dataset": F.lit("ChineseEEG2"), "book": F.col("book_id"), "paradigm": F.lit("passive_listening"), "duration": (F.col("end_sample") - F.col("start_sample")) / _RATE, "prefix": F.lit(False), "text": has,
        "alignment": F.col("status"), "global_alignment": F.col("global_alignment_status"), "audio": F.col("audio_file").isNotNull(),
    }
    return x.select(
        "eeg_file", F.col("pair_index").alias("event_pair_index"), "start_sample", "end_sample", "source_excel_row", "sentence_id", "status", F.round("score", 6).alias("score"), X.lit_count(F.col("raw_text")).cast("int").alias("highlight_char_count"),
        M.split_group(F.col("book_id"), F.col("variant"), F.col("split_identity_normalized_text")).alias("split_group_id"), "audio_match", M.record_flags(F.col("base"), facts).alias("flags"),
    )


def _segmented(s, d):
    from pyspark.sql.window import Window

    line = F.concat_ws("/", "book_id", "speaker_id").alias("timeline")
    f = table(s, d, "audio_files").select("audio_file", line, "audio_index", F.try_divide(F.col("frame_count").cast("double"), "sample_rate_hz").alias("duration_sec"))
    before = F.sum("duration_sec").over(Window.partitionBy("timeline").orderBy("audio_index").rowsBetween(Window.unboundedPreceding, -1))
    files = f.withColumn("start_sec", F.coalesce(before, F.lit(0.0)))
    t = _listening(s, d).where("audio_file IS NOT NULL AND source_excel_row IS NOT NULL")
    rows = t.groupBy("audio_file", "source_excel_row").agg(F.min(F.when(F.abs("audio_start_sec") < 1e300, F.col("audio_start_sec"))).alias("a"), F.min(F.when(F.abs("audio_end_sec") < 1e300, F.col("audio_end_sec"))).alias("z"))
    x = rows.join(files, "audio_file")
    events = x.where("a IS NOT NULL AND z IS NOT NULL").select("timeline", (F.col("start_sec") + F.col("a")).alias("start_sec"), (F.col("start_sec") + F.col("z")).alias("end_sec"), F.concat_ws("#", "audio_file", "source_excel_row").alias("event_id"))
    expected = x.groupBy("timeline", "audio_index").agg(F.count(F.lit(1)).alias("n_units"))
    return M.segmented_spans(files.drop("audio_file"), events, expected)


def segmented_audio(s, d):
    """Per audio file: events that fall into it, units it should hold, clamped and invalid ones, and whether the file and its speaker's whole recording hold."""
    return _segmented(s, d)[1]


def segmented_spans(s, d):
    """The spans within the files of the recordings that hold."""
    return _segmented(s, d)[0].select("timeline", "audio_index", "event_id", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "clamped")


_REASON_CASES = " ".join(f"WHEN '{r}' THEN '{f}'" for r, f in M.FLAG_OF_REASON.items())
_BASE = f"""{_R},
rec AS (SELECT eeg_file, max(eeg_sampling_rate) AS rate FROM trial_manifest WHERE paradigm = 'passive_listening' GROUP BY 1),
oc AS (SELECT eeg_file, count(*) FILTER (k = 'ROWS') AS ns, count(*) FILTER (k = 'ROWE') AS ne FROM e GROUP BY 1),
onp AS (SELECT eeg_file, count(*) AS np FROM p GROUP BY 1),
facts AS (SELECT rec.eeg_file, rate, ns IS NOT NULL AS there, coalesce(ns - coalesce(np, 0), 0) AS os, coalesce(ne - coalesce(np, 0), 0) AS oe FROM rec LEFT JOIN oc USING (eeg_file) LEFT JOIN onp USING (eeg_file)),
why AS (SELECT eeg_file, list_filter([CASE WHEN abs(rate - 250) > 1e-9 * greatest(abs(rate), 250) THEN 'unexpected_sampling_rate' END, CASE WHEN NOT there THEN 'missing_events_tsv' END, CASE WHEN os > 0 OR oe > 0 THEN 'unpaired_row_marker' END], lambda x : x IS NOT NULL) AS reasons FROM facts),
base AS (SELECT eeg_file, reasons, list_sort(list_distinct(list_filter(list_transform(reasons, lambda x : CASE x {_REASON_CASES} END), lambda x : x IS NOT NULL))) AS flags FROM why),
ctx AS (SELECT eeg_file, min(sample) AS first_context FROM e WHERE regexp_matches(k, '^(?i)CH\\s*0*[0-9]+$') GROUP BY 1)"""


def _flags_sql(dataset, book, paradigm, duration, prefix, text, alignment, glob, audio):
    rules = {
        "implausible_eeg_trial_duration": f"{duration} < 0.1", "prechapter_trial_unresolved": prefix, "missing_text": f"NOT {text}", "unresolved_text_alignment": f"NOT {text} OR ({glob} = 'unresolved' AND {dataset} = 'ChineseEEG1')",
        "material_variant_uncertain": f"NOT {text} AND {dataset} = 'ChineseEEG2' AND {book} = 'garnettdream'", "event_text_count_mismatch": f"{alignment} = 'fuzzy'", "ra_audio_boundary_unavailable": f"{paradigm} = 'reading_aloud'",
        "pl_audio_mapping_unverified": f"{paradigm} = 'passive_listening' AND NOT {audio}",
    }
    own = "[" + ", ".join(f"CASE WHEN coalesce({v}, false) THEN '{k}' END" for k, v in rules.items()) + "]"
    return f"coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(base.flags, []), {own}), lambda x : x IS NOT NULL))), '|'), ''), 'ok')"


_SEGMENTS = """f AS (SELECT audio_file, book_id || '/' || speaker_id AS timeline, audio_index, frame_count / sample_rate_hz AS dur FROM audio_files),
g AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY timeline ORDER BY audio_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s0 FROM f),
r AS (SELECT audio_file, source_excel_row, min(audio_start_sec) FILTER (abs(audio_start_sec) < 1e300) AS a, min(audio_end_sec) FILTER (abs(audio_end_sec) < 1e300) AS z FROM trial_manifest WHERE paradigm = 'passive_listening' AND audio_file IS NOT NULL AND source_excel_row IS NOT NULL GROUP BY 1, 2),
x AS (SELECT * FROM r JOIN g USING (audio_file)),
ev AS (SELECT timeline, s0 + a AS t0, s0 + z AS t1, audio_file || '#' || source_excel_row AS event_id FROM x WHERE a IS NOT NULL AND z IS NOT NULL),
j AS (SELECT ev.timeline, event_id, g.audio_index, t0 - g.s0 AS a, t1 - g.s0 AS z, g.dur FROM ev ASOF JOIN g ON ev.timeline = g.timeline AND ev.t0 >= g.s0),
b AS (SELECT *, a < 0 OR a >= dur OR z <= a OR z > dur + 0.5 AS bad FROM j),
p AS (SELECT timeline, audio_index, count(*) AS n_events, count(*) FILTER (bad) AS n_invalid, count(*) FILTER (NOT bad AND z > dur) AS n_clamped FROM b GROUP BY 1, 2),
w AS (SELECT timeline, audio_index, count(*) AS n_units FROM x GROUP BY 1, 2),
q AS (SELECT timeline, audio_index, n_units, coalesce(n_events, 0) AS n_events, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_clamped, 0) AS n_clamped FROM w LEFT JOIN p USING (timeline, audio_index))"""
_NAME = "lower(trim(session_id))"
SQL = {
    "anomaly_flags": f"WITH {_BASE} SELECT eeg_file, array_to_string(reasons, '|') AS reasons, array_to_string(flags, '|') AS flags FROM base",
    "derive_flags": f"WITH {_BASE} SELECT row_id, " + _flags_sql("dataset_version", "session_id", "paradigm", "((eeg_end_sample - eeg_start_sample) / nullif(eeg_sampling_rate, 0))", "eeg_start_sample < first_context", "(raw_text IS NOT NULL)", "text_alignment_status", "global_text_alignment_status", "(audio_start_sec IS NOT NULL)")
    + " AS flags FROM trial_manifest LEFT JOIN base USING (eeg_file) LEFT JOIN ctx USING (eeg_file)",
    "speaker_variant": f"WITH t AS (SELECT DISTINCT eeg_file, paradigm, {_NAME} AS name, regexp_extract(subject_id, '([0-9]{{2}})$', 1) AS subject FROM trial_manifest) SELECT DISTINCT eeg_file, CASE WHEN name = 'granettdream' THEN 'garnettdream' ELSE name END AS book, CASE WHEN paradigm = 'passive_listening' THEN CASE WHEN subject IN ('01', '02', '03', '04') THEN 'f1' ELSE 'm1' END WHEN paradigm = 'reading_aloud' THEN subject END AS speaker FROM t",
    "segmented_audio": f"WITH {_SEGMENTS} SELECT *, n_events = n_units AND n_invalid = 0 AS file_valid, bool_and(n_events = n_units AND n_invalid = 0) OVER (PARTITION BY timeline) AS timeline_valid FROM q",
    "segmented_spans": f"WITH {_SEGMENTS}, v AS (SELECT timeline FROM q GROUP BY 1 HAVING bool_and(n_events = n_units AND n_invalid = 0)) SELECT timeline, audio_index, event_id, round(a, 6) AS start_sec, round(least(z, dur), 6) AS end_sec, NOT bad AND z > dur AS clamped FROM b JOIN v USING (timeline) JOIN w USING (timeline, audio_index)",
}
QUERIES = {k: globals()[k] for k in SQL} | {"build_manifest": build_manifest}
