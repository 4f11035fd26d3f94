"""Building trial records: recordings with their flags, legal pairs with their text units, audio spans, record flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions import text as X
from cohortloom.functions.ids import stable_id
from cohortloom.operators import intervals as I
from cohortloom.operators.align import duration_matches
from cohortloom.operators.audit import pearson
from cohortloom.operators.quantiles import quantiles

# What the audit of a recording may find, and the flag that its records get from it; other findings give no flag.
FLAG_OF_REASON = {
    "unpaired_row_marker": "orphan_row_event_in_recording",
    "missing_events_tsv": "missing_events_tsv",
    "events_vmrk_count_mismatch": "events_vmrk_count_mismatch",
    "broken_header_data_reference": "broken_brainvision_reference",
    "broken_header_marker_reference": "broken_brainvision_reference",
    "invalid_binary_shape": "invalid_brainvision_binary",
}
CHANNELS = 128
PACES = {"ChineseEEG1": 0.35, "ChineseEEG2": 0.25}
ALIASES = {"granettdream": "garnettdream"}
FIRST_SPEAKER, FIRST_SUBJECTS, SECOND_SPEAKER = "f1", ("01", "02", "03", "04"), "m1"
SHORTEST = 0.1
VARIANT_DATASET, VARIANT_BOOK = "ChineseEEG2", "garnettdream"
LEAST_R, MOST_MEDIAN, FEW = 0.9, 0.75, 3
QUARANTINE, IDENTITY = "conservative-unresolved-quarantine", "book-plus-reviewed-identity-text"


def recording_reasons(rate: float, have: set[str]) -> Column:
    """Array of what is wrong with a recording, in a fixed order, as far as the columns in ``have`` tell; null facts say nothing.

    sampling_rate_hz, channel_count, channel_names, data_size_remainder, header_data_reference_exists,
    header_marker_reference_exists, events_tsv_exists, orphan_row_starts, orphan_row_ends, event_count, annotation_count_vmrk.
    """
    c = F.col
    rules: list[tuple[set[str], Column | None, str]] = [
        ({"sampling_rate_hz"}, F.abs(c("sampling_rate_hz") - rate) > 1e-9 * F.greatest(F.abs("sampling_rate_hz"), F.lit(abs(rate))), "unexpected_sampling_rate"),
        ({"channel_count"}, c("channel_count") != CHANNELS, "unexpected_channel_count"),
        ({"channel_names"}, c("channel_names") != F.array(*[F.lit(f"E{i}") for i in range(1, CHANNELS + 1)]), "unexpected_channel_names"),
        ({"data_size_remainder"}, c("data_size_remainder") != 0, "invalid_binary_shape"),
        ({"header_data_reference_exists"}, ~c("header_data_reference_exists"), "broken_header_data_reference"),
        ({"header_marker_reference_exists"}, ~c("header_marker_reference_exists"), "broken_header_marker_reference"),
        ({"events_tsv_exists"}, ~c("events_tsv_exists"), "missing_events_tsv"),
        ({"orphan_row_starts", "orphan_row_ends"}, (c("orphan_row_starts") > 0) | (c("orphan_row_ends") > 0), "unpaired_row_marker"),
        ({"event_count", "annotation_count_vmrk"}, c("event_count") != c("annotation_count_vmrk"), "events_vmrk_count_mismatch"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for need, bad, name in rules if need <= have] or [F.lit(None).cast("string")]))


def flags_of(reasons: Column) -> Column:
    """The sorted, distinct flags that reasons give."""
    flag = F.create_map(*[F.lit(x) for kv in FLAG_OF_REASON.items() for x in kv])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(reasons, lambda r: F.element_at(flag, r)))))


def recording_facts(markers: DataFrame, recordings: DataFrame) -> DataFrame:
    """(eeg_file, sampling_rate_hz, events_tsv_exists, orphan_row_starts, orphan_row_ends) of each recording; one without markers has no orphans."""
    o = I.orphans(markers, "eeg_file", "sample", "trial_type", ("onset", "trial_type", "value"))
    x = recordings.join(o, "eeg_file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select("eeg_file", "sampling_rate_hz", F.col("starts").isNotNull().alias("events_tsv_exists"), zero("orphan_starts").alias("orphan_row_starts"), zero("orphan_ends").alias("orphan_row_ends"))


def book_of(session: Column) -> Column:
    """The book of a session: its normalized identifier, with known slips of the pen put right."""
    name = X.normalize_identifier(session)
    for wrong, right in ALIASES.items():
        name = F.when(name == wrong, right).otherwise(name)
    return name


def speaker_of(paradigm: Column, subject: Column) -> Column:
    """Who is heard: of listening the speaker of the subject's cohort, of reading aloud the subject, else nobody."""
    return F.when(paradigm == "passive_listening", F.when(subject.isin(*FIRST_SUBJECTS), FIRST_SPEAKER).otherwise(SECOND_SPEAKER)).when(paradigm == "reading_aloud", subject)


def record_flags(base: Column, facts: Mapping[str, Column]) -> Column:
    """The sorted flags of a record joined by ``|``, ``ok`` where there are none.

    ``base``: flags of the recording (null: none). ``facts``: dataset, book, paradigm, duration (s), prefix (starts before the first
    chapter), text (has a text unit), alignment and global_alignment (statuses), audio (has a span). Null facts are not so.
    """
    f = dict(facts)
    dataset = f["dataset"]
    rules = {
        "implausible_eeg_trial_duration": f["duration"] < SHORTEST, "prechapter_trial_unresolved": f["prefix"], "missing_text": ~f["text"],
        "unresolved_text_alignment": ~f["text"] | ((f["global_alignment"] == "unresolved") & (dataset == "ChineseEEG1")),
        "material_variant_uncertain": ~f["text"] & (dataset == VARIANT_DATASET) & (f["book"] == VARIANT_BOOK), "event_text_count_mismatch": f["alignment"] == "fuzzy",
        "ra_audio_boundary_unavailable": f["paradigm"] == "reading_aloud", "pl_audio_mapping_unverified": (f["paradigm"] == "passive_listening") & ~f["audio"],
    }
    own = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))
    joined = F.array_join(F.array_sort(F.array_union(F.coalesce(base, F.array().cast("array<string>")), own)), "|")
    return F.when(joined == "", "ok").otherwise(joined)


def run_units(ranges: DataFrame, units: DataFrame, strict: bool = False) -> DataFrame:
    """Text units of the row range of each run: ranges (eeg_file, book_id, lo, hi) and units (book_id, source_excel_row, ...), a unit for each row once.

    Adds ``position`` from 0 within the run. ``strict`` raises where a row of a range has no unit.
    """
    cell = 64
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    x = r.join(units.withColumn("_cell", F.floor(F.col("source_excel_row") / cell)), ["book_id", "_cell"]).where(F.col("source_excel_row").between(F.col("lo"), F.col("hi"))).drop("_cell", "lo", "hi")
    if strict:
        missing = ranges.join(x.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("n")), "eeg_file", "left").where(F.coalesce("n", F.lit(0)) < F.col("hi") - F.col("lo") + 1)
        first = missing.select("eeg_file").orderBy("eeg_file").first()
        if first:
            raise ValueError(f"the range of {first.eeg_file} has rows without a text unit")
    return x.withColumn("position", F.row_number().over(Window.partitionBy("eeg_file").orderBy("source_excel_row")) - 1)


def matched_units(pairs: DataFrame, units: DataFrame, rates: DataFrame, pace: float) -> DataFrame:
    """(eeg_file, pair_index, start_sample, end_sample, context, status, score and the unit's columns) of every legal pair.

    A recording's pairs and units are matched by position where there are as many of both and durations agree with the
    letters at ``pace``: a median residual of at most 0.75 s for fewer than three, else a correlation of at least 0.9,
    which is the score in per cent (100 where it is not defined): status ``exact``. Elsewhere they are aligned by their
    durations (``align.duration_matches``): a pair that gets a unit is ``fuzzy``, the rest ``unresolved``, without a unit.
    ``units`` have eeg_file, position and raw_text; ``rates`` eeg_file and rate. Recordings without units are unresolved.
    """
    p = pairs.join(rates, "eeg_file").withColumn("position", F.col("pair_index").cast("int"))
    both = p.join(units.select("eeg_file", "position", X.lit_count(F.col("raw_text")).alias("_letters")), ["eeg_file", "position"])
    both = both.select("eeg_file", ((F.col("end_sample") - F.col("start_sample")) / F.col("rate")).alias("_actual"), (F.col("_letters") * pace).alias("_expected")).withColumn("_res", F.abs(F.col("_actual") - F.col("_expected")))
    r = both.groupBy("eeg_file").agg(pearson("_actual", "_expected").alias("_r"))
    median = quantiles(both, ["eeg_file"], "_res", {"_median": 0.5}).select("eeg_file", "_median")
    count = p.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("_np")).join(units.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("_nu")), "eeg_file")
    g = count.join(r, "eeg_file").join(median, "eeg_file")
    valid = F.when(F.col("_np") < FEW, F.col("_median") <= MOST_MEDIAN).otherwise(F.coalesce(F.col("_r") >= LEAST_R, F.lit(False)))
    good = g.where((F.col("_np") == F.col("_nu")) & valid).select("eeg_file", F.coalesce(F.greatest(F.lit(0.0), F.col("_r") * 100), F.lit(100.0)).alias("score"))
    by_position = units.join(good, "eeg_file").select("eeg_file", F.col("position").cast("long").alias("pair_index"), "position", "score", F.lit("exact").alias("status"))
    rest = p.join(good, "eeg_file", "left_anti").select("eeg_file", F.col("pair_index").alias("pos"), ((F.col("end_sample") - F.col("start_sample")) / F.col("rate")).alias("actual"))
    expected = units.join(good, "eeg_file", "left_anti").select("eeg_file", F.col("position").alias("pos"), (F.coalesce(X.lit_count(F.col("raw_text")), F.lit(0)) * pace).alias("expected"))
    by_duration = duration_matches(rest, expected, "eeg_file", pace).where(F.col("unit_pos").isNotNull())
    by_duration = by_duration.select("eeg_file", F.col("event_pos").alias("pair_index"), F.col("unit_pos").cast("int").alias("position"), "score", F.lit("fuzzy").alias("status"))
    found = by_position.unionByName(by_duration).join(units, ["eeg_file", "position"]).drop("position")
    return pairs.join(found, ["eeg_file", "pair_index"], "left").withColumn("status", F.coalesce("status", F.lit("unresolved")))


def with_audio(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds audio_file, start_sec and end_sec: of (speaker, run, global_text_id) if there is a span, else of the speaker's spans without a run.

    ``spans``: speaker_id, run_id (null: of any run), global_text_id, audio_file, start_sec, end_sec; one row per key, the least span of a repeated key counts.
    """
    value = F.min(F.struct("audio_file", "start_sec", "end_sec"))
    exact = spans.where(F.col("run_id").isNotNull()).groupBy("speaker_id", "run_id", "global_text_id").agg(value.alias("_exact"))
    other = spans.where(F.col("run_id").isNull()).groupBy("speaker_id", "global_text_id").agg(value.alias("_other"))
    x = records.join(exact, ["speaker_id", "run_id", "global_text_id"], "left").join(other, ["speaker_id", "global_text_id"], "left")
    chosen = F.coalesce("_exact", "_other")
    names = ("audio_file", "start_sec", "end_sec")
    return x.select(*records.columns, *[chosen[n].alias(n) for n in names], F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_other").isNotNull(), "fallback").alias("audio_match"))


def split_group(book: Column, variant: Column, identity: Column, version: str = "split-group-v1", rules: str = "text-normalization-v2") -> Column:
    """The split group of a record: of its book and reviewed text; all records of a book and variant without text share one, kept apart from the rest."""
    unknown = stable_id(version, F.lit(QUARANTINE), book, variant)
    return F.when(F.coalesce(identity, F.lit("")) == "", unknown).otherwise(stable_id(version, F.lit(IDENTITY), book, F.lit(rules), identity))


def segmented_spans(files: DataFrame, events: DataFrame, expected: DataFrame, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(spans, report) of a speaker's recording that is cut into files.

    ``files``: timeline, audio_index, start_sec on the timeline, duration_sec. ``events``: timeline, start_sec, end_sec,
    event_id. ``expected``: timeline, audio_index, n_units. An event belongs to the last file that starts at or before it.
    In a file it must start at 0 or later and before the end, end after its start and at most ``tolerance`` after the file,
    to whose end it is clamped. A file holds if it has as many events as units and all are in order; a timeline holds if
    all its files do, and only then are its spans given. ``report``: one row per file.
    """
    marks = files.select("timeline", "start_sec", "audio_index")
    found = I.asof_backward(events, marks, "timeline", "start_sec", "start_sec", "audio_index", 3600.0).withColumnRenamed("matched_at", "_begin")
    x = found.join(files.select("timeline", "audio_index", "duration_sec"), ["timeline", "audio_index"], "left")
    x = x.withColumn("_a", F.col("start_sec") - F.col("_begin")).withColumn("_z", F.col("end_sec") - F.col("_begin"))
    bad = (F.col("_a") < 0) | (F.col("_a") >= F.col("duration_sec")) | (F.col("_z") <= F.col("_a")) | (F.col("_z") > F.col("duration_sec") + tolerance)
    x = x.withColumn("_bad", F.coalesce(bad, F.lit(True))).withColumn("_over", ~F.col("_bad") & (F.col("_z") > F.col("duration_sec")))
    per = x.where(F.col("audio_index").isNotNull()).groupBy("timeline", "audio_index").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("_bad").alias("n_invalid"), F.count_if("_over").alias("n_clamped"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    r = expected.join(per, ["timeline", "audio_index"], "left").select("timeline", "audio_index", "n_units", *[zero(c) for c in ("n_events", "n_invalid", "n_clamped")])
    r = r.withColumn("file_valid", (F.col("n_events") == F.col("n_units")) & (F.col("n_invalid") == 0))
    whole = r.groupBy("timeline").agg(F.every("file_valid").alias("timeline_valid"))
    report = r.join(whole, "timeline")
    spans = x.join(whole.where("timeline_valid"), "timeline", "left_semi").join(expected.select("timeline", "audio_index"), ["timeline", "audio_index"], "left_semi")
    return spans.select("timeline", "audio_index", "event_id", F.col("_a").alias("start_sec"), F.least("_z", "duration_sec").alias("end_sec"), F.col("_over").alias("clamped")), report
