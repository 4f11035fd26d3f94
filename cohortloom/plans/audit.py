"""Audit queries over trial_manifest, material_units and marker_stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import text as X
from cohortloom.operators import audit as A
from cohortloom.operators import intervals as I
from cohortloom.operators import quantiles as Q
from cohortloom.store import table


def _t(s, d):
    return table(s, d, "trial_manifest")


def _u(s, d):
    return table(s, d, "material_units")




def scan_filter(s, d):
    return _t(s, d).where("paradigm = 'passive_listening' AND load_no >= 3").select("row_id", "record_id", "eeg_duration_sec")


def group_counts(s, d):
    return A.group_counts(_t(s, d), ["dataset_version", "paradigm", "book_id", "chapter_id", "material_variant"])


def group_counts_sets(s, d):
    """Both grains in one pass, by grouping sets."""
    t = _t(s, d)
    g = t.groupingSets([["dataset_version", "paradigm"], ["dataset_version", "paradigm", "subject_id", "book_id", "chapter_id"]], "dataset_version", "paradigm", "subject_id", "book_id", "chapter_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping("subject_id").cast("int").alias("coarse"))


def flag_counts(s, d):
    return _t(s, d).select(F.explode(F.split("quality_flag", r"\|")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def trace_explode(s, d):
    t = _u(s, d).select(F.explode(F.from_json("normalization_trace", "array<struct<rule:string,count:int>>")).alias("t"))
    return t.groupBy(F.col("t.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("t.count").alias("n_changes"))


def distribution(s, d):
    return A.distribution(_t(s, d), "eeg_duration_sec", ["dataset_version", "paradigm"])


def missingness(s, d):
    cols = ("chapter_id", "global_text_id", "raw_text", "normalized_text_hash", "word_count", "audio_file", "audio_start_sec", "speaker_id", "text_alignment_score", "matching_alias")
    return _t(s, d).groupBy("paradigm").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def group_conflicts(s, d):
    """Conflicting global ids (several hashes among sure alignments), accepted variants, and groups with several texts and no fuzzy row."""
    t = _t(s, d).where("normalized_text_hash IS NOT NULL")
    sure = F.col("global_text_alignment_status").isin("exact", "normalized", "manual")
    g = t.where("global_text_id IS NOT NULL").groupBy(F.col("global_text_id").alias("id")).agg(F.countDistinct("normalized_text_hash").alias("n_hashes"), F.countDistinct(F.when(sure, F.col("normalized_text_hash"))).alias("n_sure"))
    a = g.where("n_hashes > 1").select(F.when(F.col("n_sure") > 1, "global_conflict").otherwise("accepted_variant").alias("kind"), "id", F.when(F.col("n_sure") > 1, F.col("n_sure")).otherwise(F.col("n_hashes")).alias("n"))
    c = t.groupBy(F.lower(F.trim("split_group_id")).alias("id")).agg(F.countDistinct("normalized_text_hash").alias("n"), F.bool_or(F.coalesce(F.col("global_text_alignment_status") == "fuzzy", F.lit(False))).alias("fuzzy"))
    return a.unionByName(c.where("n > 1 AND NOT fuzzy").select(F.lit("group_text_conflict").alias("kind"), "id", "n"))


def domain_coverage(s, d):
    g = _t(s, d).groupBy(F.lower(F.trim("split_group_id")).alias("g")).agg(F.array_join(F.array_sort(F.collect_set("paradigm")), "+").alias("domains"))
    return g.groupBy("domains").agg(F.count(F.lit(1)).alias("n_groups"))


def exact_duplicates(s, d):
    """Hashes that stand for several sentences, the hundred largest: a report of fixed length."""
    t = _t(s, d).where("normalized_text_hash IS NOT NULL").select("normalized_text_hash", "sentence_id").distinct()
    g = t.groupBy("normalized_text_hash").agg(F.count(F.lit(1)).alias("n_sentences"), F.min("sentence_id").alias("first_sentence"))
    return g.where("n_sentences > 1").orderBy(F.desc("n_sentences"), "normalized_text_hash").limit(100)


def near_duplicates(s, d):
    return A.near_duplicates(_u(s, d).where("NOT is_chapter_marker"), "book_id", "normalized_text").select("text_a", "text_b", F.round("score", 6).alias("score"))


def exact_correspondence(s, d):
    """Trial texts that the workbook holds and workbook texts that trials hold, with both match rates."""
    a = _t(s, d).select(F.col("normalized_text").alias("t")).where("t IS NOT NULL").distinct()
    b = _u(s, d).select(F.col("normalized_text").alias("t")).where("t IS NOT NULL").distinct()
    x = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "t", "full").agg(F.count("a").alias("n_trial"), F.count("b").alias("n_unit"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    return x.select("*", F.round(F.coalesce(F.try_divide("n_both", "n_trial"), F.lit(0.0)), 9).alias("trial_rate"), F.round(F.coalesce(F.try_divide("n_both", "n_unit"), F.lit(0.0)), 9).alias("unit_rate"))


def marker_totals(s, d):
    m = table(s, d, "marker_stream")
    kind = F.when(F.col("trial_type").rlike("^CH"), "CH").otherwise(F.col("trial_type"))
    return m.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("eeg_file").alias("n_recordings"), F.min("sample").alias("first"), F.max("sample").alias("last"))


def count_status(s, d):
    """Per recording: row starts, row ends and trials; equal counts validate it."""
    m = table(s, d, "marker_stream").groupBy("eeg_file").agg(F.count_if(F.col("trial_type") == "ROWS").alias("n_starts"), F.count_if(F.col("trial_type") == "ROWE").alias("n_ends"))
    t = _t(s, d).groupBy("eeg_file").agg(F.countDistinct("event_pair_index").alias("n_trials"))
    x = m.join(t, "eeg_file", "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))
    return x.withColumn("status", F.when((F.col("n_starts") == F.col("n_ends")) & (F.col("n_starts") == F.col("n_trials")), "validated_by_count").when(F.col("n_starts") == F.col("n_ends"), "row_count_mismatch").otherwise("start_end_mismatch"))


def anomaly_reasons(s, d):
    """Reasons for which a recording is anomalous, from its markers and trials."""
    m = table(s, d, "marker_stream").groupBy("eeg_file").agg(F.count_if(F.col("trial_type") == "ROWS").alias("a"), F.count_if(F.col("trial_type") == "ROWE").alias("b"), F.count_if(F.col("trial_type") == "bad").alias("bad"))
    t = _t(s, d).groupBy("eeg_file").agg(F.min("eeg_sampling_rate").alias("r0"), F.max("eeg_sampling_rate").alias("r1"), F.count(F.lit(1)).alias("n"))
    x = t.join(m, "eeg_file", "left")
    why = F.array_compact(F.array(F.when(~((F.col("r0") == 250) & (F.col("r1") == 250)), "unexpected_sampling_rate"), F.when(F.col("a").isNull(), "missing_events_tsv"), F.when(F.col("a") != F.col("b"), "unpaired_row_marker"), F.when(F.col("bad") > 0, "bad_segment")))
    return x.select("eeg_file", F.array_join(why, "|").alias("reasons")).where("reasons <> ''")


def ordered_digest(s, d):
    return A.ordered_digest(_t(s, d), "row_id", ["record_id", "sentence_id", "global_text_id", "normalized_text_hash", "split_group_id", "split", "eeg_start_sample", "eeg_end_sample"])


def record_violations(s, d):
    return _t(s, d).select("row_id", F.explode(A.violations(None)).alias("violation"))


def dup_key_check(s, d):
    return _t(s, d).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("load_no").alias("n_loads")).where("n > 1")


def union_disjoint(s, d):
    """Audio span keys of two speaker groups together; keys that both have are marked."""
    t = _t(s, d).where("audio_file IS NOT NULL AND speaker_id IS NOT NULL").select("speaker_id", "global_text_id", "audio_file").distinct()
    a, b = t.where("speaker_id LIKE 'f%'"), t.where("speaker_id NOT LIKE 'f%'")
    return a.unionByName(b).groupBy("global_text_id", "audio_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("speaker_id").startswith("f")).alias("n_f")).withColumn("clash", (F.col("n_f") > 0) & (F.col("n") > F.col("n_f"))).drop("n_f")


def invariant_check(s, d):
    """Values that should be one per dataset and domain, and how many there are."""
    cols = ("eeg_end_sample_semantics", "manifest_schema_version", "normalization_version", "char_count_method", "word_count_method", "split_seed", "eeg_sampling_rate")
    x = _t(s, d).groupBy("dataset_version", "paradigm").agg(*[F.countDistinct(c).alias(c) for c in cols])
    return x.select("dataset_version", "paradigm", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in cols])).alias("x")).select("dataset_version", "paradigm", "x.name", "x.n", (F.col("x.n") == 1).alias("holds"))


def dataset_checks(s, d):
    """Checks of the window index against its trials, with the number of rows that fail each."""
    w = table(s, d, "pl_windows")
    t = _t(s, d).select("record_id").distinct().withColumn("known", F.lit(1))
    x = w.join(t, "record_id", "left")
    span = F.col("eeg_stop_sample") - F.col("eeg_start_sample")
    checks = {
        "unknown_record": F.col("known").isNull(), "unknown_split": ~F.lower(F.trim("split")).isin("train", "valid", "validation", "test"), "sampling_rate": F.col("eeg_sampling_rate_hz") != 250,
        "stale_sample_count": F.col("eeg_sample_count") != span, "wrong_length": span != F.rint(F.col("window_sec") * I.window_scale(w.columns) * F.col("eeg_sampling_rate_hz")).cast("long"),
        "audio_interval": F.col("audio_stop_sample") <= F.col("audio_start_sample"), "null_char_count": F.col("char_count").isNull(),
    }
    one = x.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in checks])).alias("x")).select("x.*")


def incremental_index(s, d):
    """Records of the last load that no earlier load has: what a second run still has to extract."""
    t = _t(s, d).where("audio_file IS NOT NULL")
    last = t.agg(F.max("load_no").alias("k"))
    x = t.join(F.broadcast(last))
    return x.where("load_no = k").select("record_id").distinct().join(x.where("load_no < k").select("record_id").distinct(), "record_id", "left_anti")


def fallback_join(s, d):
    """Audio of a sentence: that of its speaker in the same run if there is any, else of its speaker in any run."""
    from cohortloom.operators.manifest import with_audio

    t = _t(s, d)
    spans = t.where("audio_file IS NOT NULL AND global_text_id IS NOT NULL AND speaker_id IS NOT NULL AND run_id IS NOT NULL")
    nothing = F.lit(None).cast("double")
    span = lambda run: spans.select("speaker_id", run.alias("run_id"), "global_text_id", "audio_file", nothing.alias("start_sec"), nothing.alias("end_sec")).distinct()
    x = with_audio(t.select("row_id", "speaker_id", "run_id", "global_text_id"), span(F.col("run_id")).unionByName(span(F.lit(None).cast("string"))))
    return x.select("row_id", F.col("audio_file").alias("audio"), F.col("audio_match").alias("method"))


def partition_lookup(s, d):
    """Windows with the split of their record, and those whose record is unknown or has another split."""
    clean = lambda c: F.when(F.lower(F.trim(c)) == "validation", "valid").otherwise(F.lower(F.trim(c)))
    t = _t(s, d).groupBy("record_id").agg(F.min(clean("split")).alias("trial_split"), F.countDistinct(clean("split")).alias("n"))
    w = table(s, d, "pl_windows").select("window_id", "record_id", clean("split").alias("window_split")).distinct()
    return w.join(t, "record_id", "left").select("window_id", "window_split", "trial_split", F.when(F.col("trial_split").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("trial_split") == F.col("window_split"), "ok").otherwise("differs").alias("status"))


def global_id_resolve(s, d):
    """The workbook's global id of each trial's sentence, else the trial's own, else one made from the sentence id."""
    u = _u(s, d).groupBy("sentence_id").agg(F.min("global_text_id").alias("unit_id_"))
    x = _t(s, d).select("row_id", "sentence_id", "global_text_id").join(u, "sentence_id", "left")
    made = F.concat(F.lit("global-text-v1-"), F.substring(F.sha2(F.col("sentence_id").cast("binary"), 256), 1, 24))
    return x.select("row_id", F.coalesce("unit_id_", "global_text_id", made).alias("global_id"), F.when(F.col("unit_id_").isNotNull(), "unit").when(F.col("global_text_id").isNotNull(), "trial").otherwise("generated").alias("origin"))


def alignment_override(s, d):
    """Reviewed links override the automatic group: an accepted link's smaller id wins, rejected links change nothing."""
    c = lambda x: F.lower(F.trim(x))
    links = table(s, d, "group_links").where("review_status = 'accepted'")
    both = links.select(c("left_group_id").alias("a"), c("right_group_id").alias("b"))
    over = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    g = _t(s, d).select(c("split_group_id").alias("a")).distinct()
    return g.join(over, "a", "left").select(F.col("a").alias("group_id"), F.least("a", "b").alias("resolved"), F.col("b").isNotNull().alias("overridden"))


def dangling_overrides(s, d):
    """Accepted links that name a group which no trial has: overrides that would change nothing."""
    c = lambda x: F.lower(F.trim(x))
    links = table(s, d, "group_links").where("review_status = 'accepted'").select("link_id", F.explode(F.array(c("left_group_id"), c("right_group_id"))).alias("group_id")).distinct()
    return links.join(_t(s, d).select(c("split_group_id").alias("group_id")).distinct(), "group_id", "left_anti").select("link_id", "group_id")


def range_lookup(s, d):
    """Workbook rows of each run: runs span the rows their trials have, rows in several runs are told."""
    t = _t(s, d).where("source_excel_row IS NOT NULL").groupBy("book_id", "run_id").agg(F.min("source_excel_row").alias("lo"), F.max("source_excel_row").alias("hi"))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    u = _u(s, d).select("book_id", "source_excel_row").distinct().withColumn("cell", F.floor(F.col("source_excel_row") / 64))
    return u.join(cells, ["book_id", "cell"]).where("source_excel_row BETWEEN lo AND hi").groupBy("book_id", "source_excel_row").agg(F.count(F.lit(1)).alias("n_runs"), F.min("run_id").alias("first_run"))


def _joined(s, d):
    t = _t(s, d).where("chapter_id IS NOT NULL AND raw_text IS NOT NULL").select("row_id", "eeg_file", "book_id", "chapter_id", "event_pair_index", "eeg_start_sample", "eeg_end_sample", "eeg_sampling_rate", X.lit_count(F.col("raw_text")).alias("chars"), "paradigm")
    return t.withColumn("actual", F.try_divide((F.col("eeg_end_sample") - F.col("eeg_start_sample")).cast("double"), "eeg_sampling_rate")).withColumn("expected", F.col("chars") * 0.25)


def pearson_guarded(s, d):
    return _joined(s, d).groupBy("eeg_file").agg(F.count(F.lit(1)).alias("n"), F.round(A.pearson("actual", "expected"), 6).alias("r"))


def duration_validation(s, d):
    """Per recording: correlation and median absolute residual of actual against expected durations, and the verdict."""
    x = _joined(s, d).withColumn("res", F.abs(F.col("actual") - F.col("expected")))
    g = x.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("n"), F.round(A.pearson("actual", "expected"), 6).alias("r"))
    m = Q.quantiles(x, ["eeg_file"], "res", {"m": 0.5}).select("eeg_file", F.round("m", 6).alias("median_residual"))
    g = g.join(m, "eeg_file", "left")
    return g.withColumn("valid", F.when(F.col("n") < 3, F.col("median_residual") <= 0.75).otherwise(F.coalesce(F.col("r") >= 0.9, F.lit(False))))


def p95_exclusive(s, d):
    x = _joined(s, d).withColumn("res", F.abs(F.col("actual") - F.col("expected")))
    return Q.p95_exclusive(x, ["eeg_file"], "res").select("eeg_file", F.round("p95", 6).alias("p95"))


def span_validation(s, d):
    """Per audio file: trials, correlation of audio and EEG durations, exclusive p95 of their difference, and the verdict."""
    num = lambda c: F.when(F.abs(c) <= 1e300, F.col(c))
    x = _t(s, d).where("audio_file IS NOT NULL").select("audio_file", F.col("eeg_duration_sec").alias("a"), (num("audio_end_sec") - num("audio_start_sec")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("res", F.abs(F.col("a") - F.col("b")))
    g = x.groupBy("audio_file").agg(F.count(F.lit(1)).alias("n"), F.round(A.pearson("a", "b"), 6).alias("r"))
    p = Q.p95_exclusive(x, ["audio_file"], "res").select("audio_file", F.round("p95", 6).alias("p95"))
    g = g.join(p, "audio_file", "left")
    return g.withColumn("valid", F.coalesce((F.col("r") >= 0.99) & (F.col("p95") <= 0.08), F.lit(False)))


def positional_join(s, d):
    """Trials and row markers of a recording in order, joined by position where the counts agree."""
    from pyspark.sql.window import Window

    w = lambda o: F.row_number().over(Window.partitionBy("eeg_file").orderBy(*o))
    m = table(s, d, "marker_stream").where("trial_type = 'ROWS'").select("eeg_file", "sample").distinct().withColumn("k", w(["sample"]))
    t = _t(s, d).select("eeg_file", "eeg_start_sample", "record_id").distinct().withColumn("k", w(["eeg_start_sample", "record_id"]))
    n = t.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("nt")).join(m.groupBy("eeg_file").agg(F.count(F.lit(1)).alias("nm")), "eeg_file").where("nt = nm").select("eeg_file")
    return t.join(n, "eeg_file").join(m, ["eeg_file", "k"]).select("record_id", "eeg_file", F.col("k").cast("int").alias("position"), "eeg_start_sample", F.col("sample").alias("marker_sample"))


_LIT = r"length(regexp_replace(raw_text, '[\p{P}\p{Z}\p{C}]', '', 'g'))"
_J = f"j AS (SELECT row_id, eeg_file, (eeg_end_sample - eeg_start_sample) / eeg_sampling_rate AS a, {_LIT} * 0.25::DOUBLE AS b FROM trial_manifest WHERE chapter_id IS NOT NULL AND raw_text IS NOT NULL)"
_P95 = "CASE WHEN n >= 2 THEN round((x[j] * (20 - (19 * (n + 1) - 20 * j)) + x[j + 1] * (19 * (n + 1) - 20 * j)) / 20, 6) END"
_R = "round(CASE WHEN count(a + b) >= 3 AND min(a) FILTER (b IS NOT NULL) < max(a) FILTER (b IS NOT NULL) AND min(b) FILTER (a IS NOT NULL) < max(b) FILTER (a IS NOT NULL) THEN corr(a, b) END, 6)"
_CLEAN = "CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END"
_CHECKS = [
    ("unknown_record", "record_id NOT IN (SELECT record_id FROM trial_manifest)"), ("unknown_split", "lower(trim(split)) NOT IN ('train', 'valid', 'validation', 'test')"), ("sampling_rate", "eeg_sampling_rate_hz <> 250"),
    ("stale_sample_count", "eeg_sample_count <> eeg_stop_sample - eeg_start_sample"), ("wrong_length", f"eeg_stop_sample - eeg_start_sample <> round_even(window_sec * {I.WINDOW_SCALE_SQL} * eeg_sampling_rate_hz, 0)"),
    ("audio_interval", "audio_stop_sample <= audio_start_sample"), ("null_char_count", "char_count IS NULL"),
]
_VIOL = [*[(f"empty_{r}", f"coalesce({r}, '') = ''") for r in A.REQUIRED], ("unknown_paradigm", f"paradigm NOT IN {A.PARADIGMS}"), ("unknown_split", f"split NOT IN {A.SPLITS}"), ("unknown_alignment", f"text_alignment_status NOT IN {A.ALIGNMENTS}"),
    ("eeg_interval", "eeg_start_sample < 0 OR eeg_end_sample <= eeg_start_sample"), ("eeg_rate", "eeg_sampling_rate <= 0"), ("eeg_duration", "NOT coalesce(abs((eeg_end_sample - eeg_start_sample) / nullif(eeg_sampling_rate, 0) - eeg_duration_sec) <= 1e-9, false)"),
    ("eeg_semantics", f"eeg_end_sample_semantics <> '{A.SEMANTICS}'"), ("audio_bounds_half_null", "(audio_start_sec IS NULL) <> (audio_end_sec IS NULL)"), ("audio_without_bounds", "audio_start_sec IS NULL AND audio_end_sec IS NULL AND (audio_duration_sec IS NOT NULL OR audio_file IS NOT NULL)"),
    ("audio_interval", "audio_start_sec IS NOT NULL AND audio_end_sec IS NOT NULL AND (audio_start_sec < 0 OR audio_end_sec <= audio_start_sec)"), ("audio_duration_missing", "audio_start_sec IS NOT NULL AND audio_end_sec IS NOT NULL AND audio_duration_sec IS NULL"),
    ("derived_without_text", "raw_text IS NULL AND coalesce(" + ", ".join(f"{x}::VARCHAR" for x in A.DERIVED) + ") IS NOT NULL"), ("schema_version", f"manifest_schema_version <> '{A.VERSION}'")]
_MISS = ("chapter_id", "global_text_id", "raw_text", "normalized_text_hash", "word_count", "audio_file", "audio_start_sec", "speaker_id", "text_alignment_score", "matching_alias")
_INV = ("eeg_end_sample_semantics", "manifest_schema_version", "normalization_version", "char_count_method", "word_count_method", "split_seed", "eeg_sampling_rate")
SQL = {
    "scan_filter": "SELECT row_id, record_id, eeg_duration_sec FROM trial_manifest WHERE paradigm = 'passive_listening' AND load_no >= 3",
    "group_counts": "SELECT coalesce(dataset_version, '') AS dataset_version, coalesce(paradigm, '') AS paradigm, coalesce(book_id, '') AS book_id, coalesce(chapter_id::VARCHAR, '') AS chapter_id, coalesce(material_variant, '') AS material_variant, count(*) AS n FROM trial_manifest GROUP BY ALL",
    "group_counts_sets": "SELECT dataset_version, paradigm, subject_id, book_id, chapter_id, count(*) AS n, grouping(subject_id)::INTEGER AS coarse FROM trial_manifest GROUP BY GROUPING SETS ((dataset_version, paradigm), (dataset_version, paradigm, subject_id, book_id, chapter_id))",
    "flag_counts": "SELECT unnest(string_split(quality_flag, '|')) AS flag, count(*) AS n FROM trial_manifest GROUP BY 1",
    "trace_explode": "WITH t AS (SELECT unnest(from_json(normalization_trace, '[{\"rule\":\"VARCHAR\",\"count\":\"INTEGER\"}]')) AS t FROM material_units) SELECT t.rule AS rule, count(*) AS n_rows, sum(t.count)::BIGINT AS n_changes FROM t GROUP BY 1",
    "distribution": "WITH v AS (SELECT dataset_version, paradigm, CASE WHEN isfinite(eeg_duration_sec) THEN eeg_duration_sec END AS v FROM trial_manifest) SELECT dataset_version, paradigm, count(v) AS n, min(v) AS min, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.95), 9) AS p95, max(v) AS max, round(avg(v), 9) AS mean FROM v GROUP BY 1, 2",
    "missingness": "SELECT paradigm, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in _MISS) + " FROM trial_manifest GROUP BY 1",
    "group_conflicts": """WITH t AS (SELECT * FROM trial_manifest WHERE normalized_text_hash IS NOT NULL), g AS (SELECT global_text_id AS id, count(DISTINCT normalized_text_hash) AS h, count(DISTINCT CASE WHEN global_text_alignment_status IN ('exact', 'normalized', 'manual') THEN normalized_text_hash END) AS s FROM t WHERE global_text_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN s > 1 THEN 'global_conflict' ELSE 'accepted_variant' END AS kind, id, CASE WHEN s > 1 THEN s ELSE h END AS n FROM g WHERE h > 1 UNION ALL
SELECT 'group_text_conflict', lower(trim(split_group_id)) AS id, count(DISTINCT normalized_text_hash) AS n FROM t GROUP BY 2 HAVING n > 1 AND NOT bool_or(global_text_alignment_status = 'fuzzy')""",
    "domain_coverage": "WITH g AS (SELECT lower(trim(split_group_id)) AS g, string_agg(DISTINCT paradigm, '+' ORDER BY paradigm) AS domains FROM trial_manifest GROUP BY 1) SELECT domains, count(*) AS n_groups FROM g GROUP BY 1",
    "exact_duplicates": "SELECT normalized_text_hash, count(DISTINCT sentence_id) AS n_sentences, min(sentence_id) AS first_sentence FROM trial_manifest WHERE normalized_text_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sentence_id) > 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "exact_correspondence": "WITH a AS (SELECT DISTINCT normalized_text t FROM trial_manifest WHERE normalized_text IS NOT NULL), b AS (SELECT DISTINCT normalized_text t FROM material_units WHERE normalized_text IS NOT NULL), n AS (SELECT (SELECT count(*) FROM a) AS n_trial, (SELECT count(*) FROM b) AS n_unit, (SELECT count(*) FROM a JOIN b USING (t)) AS n_both) SELECT *, round(coalesce(n_both / nullif(n_trial, 0), 0), 9) AS trial_rate, round(coalesce(n_both / nullif(n_unit, 0), 0), 9) AS unit_rate FROM n",
    "marker_totals": "SELECT CASE WHEN trial_type LIKE 'CH%' THEN 'CH' ELSE trial_type END AS kind, count(*) AS n, count(DISTINCT eeg_file) AS n_recordings, min(sample) AS first, max(sample) AS last FROM marker_stream GROUP BY 1",
    "count_status": "WITH m AS (SELECT eeg_file, count(*) FILTER (trial_type = 'ROWS') AS n_starts, count(*) FILTER (trial_type = 'ROWE') AS n_ends FROM marker_stream GROUP BY 1), t AS (SELECT eeg_file, count(DISTINCT event_pair_index) AS n_trials FROM trial_manifest GROUP BY 1), x AS (SELECT eeg_file, n_starts, n_ends, coalesce(n_trials, 0) AS n_trials FROM m LEFT JOIN t USING (eeg_file)) SELECT *, CASE WHEN n_starts = n_ends AND n_starts = n_trials THEN 'validated_by_count' WHEN n_starts = n_ends THEN 'row_count_mismatch' ELSE 'start_end_mismatch' END AS status FROM x",
    "anomaly_reasons": "WITH m AS (SELECT eeg_file, count(*) FILTER (trial_type = 'ROWS') AS a, count(*) FILTER (trial_type = 'ROWE') AS b, count(*) FILTER (trial_type = 'bad') AS bad FROM marker_stream GROUP BY 1), t AS (SELECT eeg_file, min(eeg_sampling_rate) AS r0, max(eeg_sampling_rate) AS r1 FROM trial_manifest GROUP BY 1), x AS (SELECT eeg_file, concat_ws('|', CASE WHEN NOT (r0 = 250 AND r1 = 250) THEN 'unexpected_sampling_rate' END, CASE WHEN a IS NULL THEN 'missing_events_tsv' END, CASE WHEN a <> b THEN 'unpaired_row_marker' END, CASE WHEN bad > 0 THEN 'bad_segment' END) AS reasons FROM t LEFT JOIN m USING (eeg_file)) SELECT * FROM x WHERE reasons <> ''",
    "ordered_digest": "WITH r AS (SELECT substr(sha256(row_id::VARCHAR), 1, 2) AS b, row_id::VARCHAR AS k, sha256(concat_ws(chr(31), coalesce(record_id, ''), coalesce(sentence_id, ''), coalesce(global_text_id, ''), coalesce(normalized_text_hash, ''), coalesce(split_group_id, ''), coalesce(split, ''), coalesce(eeg_start_sample::VARCHAR, ''), coalesce(eeg_end_sample::VARCHAR, ''))) AS h FROM trial_manifest), g AS (SELECT b, sha256(string_agg(h, chr(10) ORDER BY k, h)) AS d, count(*) AS n FROM r GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM g",
    "record_violations": "WITH v AS (SELECT row_id, unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _VIOL) + "]) AS violation FROM trial_manifest) SELECT * FROM v WHERE violation IS NOT NULL",
    "dup_key_check": "SELECT record_id, count(*) AS n, count(DISTINCT load_no) AS n_loads FROM trial_manifest GROUP BY 1 HAVING count(*) > 1",
    "union_disjoint": "WITH t AS (SELECT DISTINCT speaker_id, global_text_id, audio_file FROM trial_manifest WHERE audio_file IS NOT NULL AND speaker_id IS NOT NULL) SELECT global_text_id, audio_file, count(*) AS n, bool_or(speaker_id LIKE 'f%') AND bool_or(speaker_id NOT LIKE 'f%') AS clash FROM t GROUP BY 1, 2",
    "invariant_check": "WITH x AS (SELECT dataset_version, paradigm, unnest([" + ", ".join(f"{{'name': '{c}', 'n': count(DISTINCT {c})}}" for c in _INV) + "]) AS x FROM trial_manifest GROUP BY 1, 2) SELECT dataset_version, paradigm, x.name AS name, x.n AS n, x.n = 1 AS holds FROM x",
    "dataset_checks": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n FROM pl_windows" for n, c in _CHECKS),
    "incremental_index": "WITH t AS (SELECT record_id, load_no FROM trial_manifest WHERE audio_file IS NOT NULL), k AS (SELECT max(load_no) AS k FROM t) SELECT DISTINCT record_id FROM t, k WHERE load_no = k AND record_id NOT IN (SELECT record_id FROM t, k WHERE load_no < k)",
    "fallback_join": "WITH s AS (SELECT * FROM trial_manifest WHERE audio_file IS NOT NULL AND global_text_id IS NOT NULL AND speaker_id IS NOT NULL AND run_id IS NOT NULL), e AS (SELECT speaker_id, run_id, global_text_id, min(audio_file) AS exact_file FROM s GROUP BY 1, 2, 3), o AS (SELECT speaker_id, global_text_id, min(audio_file) AS any_file FROM s GROUP BY 1, 2) SELECT row_id, coalesce(exact_file, any_file) AS audio, CASE WHEN exact_file IS NOT NULL THEN 'exact' WHEN any_file IS NOT NULL THEN 'fallback' END AS method FROM trial_manifest LEFT JOIN e USING (speaker_id, run_id, global_text_id) LEFT JOIN o USING (speaker_id, global_text_id)",
    "partition_lookup": f"WITH t AS (SELECT record_id, min({_CLEAN}) AS trial_split, count(DISTINCT {_CLEAN}) AS n FROM trial_manifest GROUP BY 1), w AS (SELECT DISTINCT window_id, record_id, {_CLEAN} AS window_split FROM pl_windows) SELECT window_id, window_split, trial_split, CASE WHEN trial_split IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN trial_split = window_split THEN 'ok' ELSE 'differs' END AS status FROM w LEFT JOIN t USING (record_id)",
    "global_id_resolve": "WITH u AS (SELECT sentence_id, min(global_text_id) AS g FROM material_units GROUP BY 1) SELECT row_id, coalesce(g, global_text_id, 'global-text-v1-' || substr(sha256(sentence_id), 1, 24)) AS global_id, CASE WHEN g IS NOT NULL THEN 'unit' WHEN global_text_id IS NOT NULL THEN 'trial' ELSE 'generated' END AS origin FROM trial_manifest LEFT JOIN u USING (sentence_id)",
    "alignment_override": "WITH l AS (SELECT lower(trim(left_group_id)) a, lower(trim(right_group_id)) b FROM group_links WHERE review_status = 'accepted'), o AS (SELECT a, min(b) AS b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) GROUP BY 1), g AS (SELECT DISTINCT lower(trim(split_group_id)) AS a FROM trial_manifest) SELECT a AS group_id, least(a, b) AS resolved, b IS NOT NULL AS overridden FROM g LEFT JOIN o USING (a)",
    "dangling_overrides": "WITH l AS (SELECT DISTINCT link_id, unnest([lower(trim(left_group_id)), lower(trim(right_group_id))]) AS group_id FROM group_links WHERE review_status = 'accepted') SELECT link_id, group_id FROM l WHERE NOT EXISTS (SELECT 1 FROM trial_manifest WHERE lower(trim(split_group_id)) = group_id)",
    "range_lookup": "WITH t AS (SELECT book_id, run_id, min(source_excel_row) AS lo, max(source_excel_row) AS hi FROM trial_manifest WHERE source_excel_row IS NOT NULL GROUP BY 1, 2), u AS (SELECT DISTINCT book_id, source_excel_row FROM material_units) SELECT u.book_id, source_excel_row, count(*) AS n_runs, min(run_id) AS first_run FROM u JOIN t ON u.book_id = t.book_id AND source_excel_row BETWEEN lo AND hi GROUP BY 1, 2",
    "pearson_guarded": f"WITH {_J} SELECT eeg_file, count(*) AS n, {_R} AS r FROM j GROUP BY 1",
    "duration_validation": f"WITH {_J}, g AS (SELECT eeg_file, count(*) AS n, {_R} AS r, round(quantile_cont(abs(a - b), 0.5), 6) AS median_residual FROM j GROUP BY 1) SELECT *, CASE WHEN n < 3 THEN median_residual <= 0.75 ELSE coalesce(r >= 0.9, false) END AS valid FROM g",
    "p95_exclusive": f"WITH {_J}, g AS (SELECT eeg_file, list_sort(list(abs(a - b))) AS x, count(*) AS n FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1), k AS (SELECT *, greatest(1, least(n - 1, 19 * (n + 1) // 20)) AS j FROM g) SELECT eeg_file, {_P95} AS p95 FROM k",
    "span_validation": f"WITH x AS (SELECT audio_file, eeg_duration_sec AS a, CASE WHEN isfinite(audio_end_sec) THEN audio_end_sec END - CASE WHEN isfinite(audio_start_sec) THEN audio_start_sec END AS b FROM trial_manifest WHERE audio_file IS NOT NULL), g AS (SELECT audio_file, count(*) AS n, {_R} AS r, list_sort(list(abs(a - b))) AS x FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1), k AS (SELECT *, greatest(1, least(n - 1, 19 * (n + 1) // 20)) AS j FROM g), p AS (SELECT audio_file, n, r, {_P95} AS p95 FROM k) SELECT *, coalesce(r >= 0.99 AND p95 <= 0.08, false) AS valid FROM p",
    "positional_join": "WITH m AS (SELECT *, row_number() OVER (PARTITION BY eeg_file ORDER BY sample) AS k FROM (SELECT DISTINCT eeg_file, sample FROM marker_stream WHERE trial_type = 'ROWS')), t AS (SELECT *, row_number() OVER (PARTITION BY eeg_file ORDER BY eeg_start_sample, record_id) AS k FROM (SELECT DISTINCT eeg_file, eeg_start_sample, record_id FROM trial_manifest)), n AS (SELECT eeg_file FROM (SELECT eeg_file, count(*) AS c FROM t GROUP BY 1) JOIN (SELECT eeg_file, count(*) AS c2 FROM m GROUP BY 1) USING (eeg_file) WHERE c = c2) SELECT record_id, eeg_file, k::INTEGER AS position, eeg_start_sample, sample AS marker_sample FROM t JOIN n USING (eeg_file) JOIN m USING (eeg_file, k)",
}
QUERIES = {k: globals()[k] for k in SQL} | {"near_duplicates": near_duplicates}
