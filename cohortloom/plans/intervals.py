"""Queries over marker streams, intervals and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions import ids
from cohortloom.operators import intervals as I
from cohortloom.operators.audit import bucket_digits
from cohortloom.store import table

_ORDER = ("onset", "trial_type", "value")
DELAYS = (0.0, 100.0, 200.0, 300.0, 400.0, 500.0)


def _markers(s, d):
    return table(s, d, "marker_stream")


def _pairs(s, d):
    return I.pair_markers(_markers(s, d), "eeg_file", "sample", "trial_type", _ORDER)


def pair_events(s, d):
    return _pairs(s, d)


def orphan_events(s, d):
    return I.orphans(_markers(s, d), "eeg_file", "sample", "trial_type", _ORDER)


def prefix_unresolved(s, d):
    return I.prefix_unresolved(_pairs(s, d), _markers(s, d), "eeg_file", "sample", "trial_type")


def interval_duration(s, d):
    t = table(s, d, "trial_manifest")
    sec = F.try_divide((F.col("eeg_end_sample") - F.col("eeg_start_sample")).cast("double"), F.col("eeg_sampling_rate"))
    return t.select("row_id", F.round(sec, 9).alias("seconds"), (sec < 0.1).alias("implausible"))


def quantize(s, d):
    w = table(s, d, "pl_windows")
    return w.select("window_id", F.rint(F.col("audio_start_sec") * F.col("audio_source_sample_rate_hz")).cast("long").alias("audio_start"), F.rint(F.col("window_offset_sec") * F.col("eeg_sampling_rate_hz")).cast("long").alias("eeg_offset")).distinct()


def asof_join(s, d):
    """The last row start of the recording at or before each window's start."""
    w = table(s, d, "pl_windows").select("window_id", "eeg_file", "eeg_start_sample").distinct()
    m = _markers(s, d).where("trial_type = 'ROWS'")
    got = I.asof_backward(w, m, "eeg_file", "eeg_start_sample", "sample", "onset")
    return got.select("window_id", F.col("matched_at").cast("long").alias("row_start"), F.round("onset", 6).alias("row_onset"))


def block_windows_drop(s, d):
    return _blocks(s, d, "drop")


def block_windows_pad(s, d):
    return _blocks(s, d, "pad")


def _blocks(s, d, tail):
    b = table(s, d, "trial_manifest").select("row_id", F.col("eeg_start_sample").alias("start"), F.col("eeg_end_sample").alias("stop"))
    return I.block_windows(b, 500, 250, tail).select("row_id", "window_start", "window_stop", "valid", "padded")


def _plan(s, d, window=3.0, stride=3.0, delay=0.0):
    t = table(s, d, "trial_manifest").where("paradigm = 'passive_listening'")
    return I.sync_plan(t, table(s, d, "audio_files"), window, stride, delay)


_KEEP = ("row_id", "record_id", "split_group_id", "split", "subject_id", "audio_file")


def _sync(s, d, window, stride, delay):
    return I.sync_windows(_plan(s, d, window, stride, delay), stride, _KEEP).select("row_id", "record_id", "eeg_start", "eeg_stop", "audio_start", "audio_stop", F.round("offset_sec", 6).alias("offset_sec"))


def sync_windows(s, d):
    return _sync(s, d, 3.0, 3.0, 0.0)


def sync_windows_overlap(s, d):
    return _sync(s, d, 3.0, 0.5, 200.0)


def window_exclusions(s, d):
    return _plan(s, d).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_trials"))


def window_audit(s, d):
    """Counts of the windows per split, of their targets, groups and entities, and of broken invariants."""
    plan = _plan(s, d)
    w = I.sync_windows(plan, 3.0, (*_KEEP, "we", "wa", "eeg_start_sample", "eeg_end_sample", "a0", "a1"))
    clean = F.when(F.lower(F.trim("split")) == "validation", "valid").otherwise(F.lower(F.trim("split")))
    inside = (F.col("eeg_start") >= F.col("eeg_start_sample")) & (F.col("eeg_stop") <= F.col("eeg_end_sample")) & (F.col("audio_start") >= F.col("a0")) & (F.col("audio_stop") <= F.col("a1"))
    return w.groupBy(clean.alias("split")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.countDistinct("audio_file", "audio_start", "audio_stop").alias("n_targets"), F.countDistinct(F.lower(F.trim("split_group_id"))).alias("n_groups"),
        F.countDistinct("subject_id").alias("n_entities"), F.count_if(~inside).alias("n_outside"), F.count_if(F.col("eeg_stop") - F.col("eeg_start") != F.col("we")).alias("n_wrong_length"),
    )


def common_support(s, d):
    """Windows that exist at every delay of the sweep: an intersection on (record, audio bounds)."""
    t = table(s, d, "trial_manifest").where("paradigm = 'passive_listening'").withColumn("delay", F.explode(F.array(*map(F.lit, DELAYS))))
    w = I.sync_windows(I.sync_plan(t, table(s, d, "audio_files"), 3.0, 0.5, F.col("delay")), 0.5, ["record_id", "delay"])
    return w.groupBy("record_id", "audio_start", "audio_stop").agg(F.countDistinct("delay").alias("n")).where(F.col("n") == len(DELAYS)).drop("n")


def window_jsonl_digest(s, d):
    """Digest of the windows' sorted compact JSON lines: of each bucket, then of the bucket digests in order."""
    w = sync_windows(s, d)
    line = F.to_json(F.struct("audio_start", "audio_stop", "eeg_start", "eeg_stop", "record_id", "row_id"))
    rows = w.select("row_id", "eeg_start", line.alias("line"))
    bucket = F.substring(F.sha2(F.col("row_id").cast("string").cast("binary"), 256), 1, bucket_digits(w.count()))
    per = rows.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "eeg_start", "line"))), lambda x: x["line"]), "\n").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "\n").cast("binary"), 256).alias("digest"), F.sum("n").alias("n_windows"))


def window_ids(s, d):
    """Target and window ids of the synchronized windows."""
    w = I.sync_windows(_plan(s, d), 3.0, _KEEP)
    target = F.concat(F.lit("pl-audio-target-v1-"), ids.joined_id(F.lit("pl-audio-target-v1"), F.substring_index("audio_file", "/", -2), F.col("audio_start").cast("string"), F.col("audio_stop").cast("string")))
    w = w.withColumn("target_id", target)
    window = F.concat(F.lit("pl-window-v1-"), ids.joined_id(F.lit("pl-speech-window-v1"), F.col("record_id"), F.col("target_id"), F.col("eeg_start").cast("string"), F.col("eeg_stop").cast("string"), F.lit("0.000000000")))
    return w.select("row_id", "k", "target_id", window.alias("window_id"))


def unique_targets(s, d):
    """The first window of every target, and whether all its windows agree on speaker and file."""
    w = table(s, d, "pl_windows").where(F.col("audio_target_id").isNotNull())
    return w.groupBy("audio_target_id").agg(F.min("window_id").alias("first_window"), F.count(F.lit(1)).alias("n_rows"), (F.countDistinct("audio_file", "audio_start_sample", "audio_stop_sample") == 1).alias("consistent"))


def chapter_rows(s, d):
    """Workbook rows with the chapter marker before them and their row within the chapter."""
    u = table(s, d, "material_units")
    key = ["source_excel_file"]
    w = Window.partitionBy(*key).orderBy("source_excel_row", "unit_id")
    marker = F.col("is_chapter_marker")
    e = u.withColumn("episode", F.sum(marker.cast("int")).over(w)).withColumn("chapter", F.last(F.when(marker, F.expr("try_cast(normalized_text AS INT)")), ignorenulls=True).over(w))
    body = e.where(~marker)
    n = F.row_number().over(Window.partitionBy(*key, "episode").orderBy("source_excel_row", "unit_id"))
    return body.select("unit_id", "chapter", n.alias("row_in_chapter"))


_EV = "e AS (SELECT eeg_file, sample, trim(trial_type) AS k, onset, trial_type, value FROM marker_stream WHERE eeg_file IS NOT NULL AND sample IS NOT NULL AND trial_type IS NOT NULL)"
_OVER = "ORDER BY sample, coalesce(onset::VARCHAR, ''), coalesce(trial_type, ''), coalesce(value, '')"
_R = f"""{_EV}, o AS (SELECT *, last_value(CASE WHEN regexp_matches(k, '^(?i)CH\\s*0*[0-9]+$') THEN k END IGNORE NULLS) OVER (PARTITION BY eeg_file {_OVER} ROWS UNBOUNDED PRECEDING) AS context FROM e),
r AS (SELECT *, lag(k) OVER w AS pk, lag(sample) OVER w AS ps FROM o WHERE k IN ('ROWS', 'ROWE') WINDOW w AS (PARTITION BY eeg_file {_OVER})),
p AS (SELECT eeg_file, ps AS start_sample, sample AS end_sample, row_number() OVER (PARTITION BY eeg_file {_OVER}) - 1 AS pair_index, context FROM r WHERE k = 'ROWE' AND pk = 'ROWS' AND sample > ps)"""


def _sync_sql(window, stride, delay, name="s"):
    return f"""{name}i AS (SELECT audio_file, max(sample_rate_hz)::BIGINT AS audio_rate, max(frame_count) AS frames FROM audio_files GROUP BY 1),
{name}t AS (SELECT t.*, audio_rate, frames, (t.audio_file IS NOT NULL AND audio_start_sec IS NOT NULL AND audio_end_sec IS NOT NULL AND isfinite(audio_start_sec) AND isfinite(audio_end_sec)) AS has, round_even(eeg_sampling_rate, 0)::BIGINT AS rate FROM trial_manifest t LEFT JOIN {name}i i USING (audio_file) WHERE paradigm = 'passive_listening'),
{name}q AS (SELECT *, round_even({window}::DOUBLE * rate, 0)::BIGINT AS we, round_even({stride}::DOUBLE * rate, 0)::BIGINT AS se, round_even({delay / 1000.0}::DOUBLE * rate, 0)::BIGINT AS de, round_even({window}::DOUBLE * audio_rate, 0)::BIGINT AS wa, round_even({stride}::DOUBLE * audio_rate, 0)::BIGINT AS sa,
CASE WHEN has THEN round_even(audio_start_sec * audio_rate, 0)::BIGINT END AS a0, CASE WHEN has THEN round_even(audio_end_sec * audio_rate, 0)::BIGINT END AS a1 FROM {name}t),
{name}n AS (SELECT *, CASE WHEN a1 - a0 >= wa AND eeg_end_sample - eeg_start_sample - de >= we THEN least((a1 - a0 - wa) // sa, (eeg_end_sample - eeg_start_sample - de - we) // se) + 1 ELSE 0 END AS n FROM {name}q),
{name}p AS (SELECT *, CASE WHEN NOT has THEN '{I.REASONS[0]}' WHEN frames IS NULL THEN '{I.REASONS[1]}' WHEN a1 > frames OR a0 < 0 THEN '{I.REASONS[2]}' WHEN n <= 0 THEN '{I.REASONS[3]}' END AS reason FROM {name}n),
{name}w AS (SELECT *, unnest(range(n)) AS k FROM {name}p WHERE reason IS NULL),
{name} AS (SELECT *, eeg_start_sample + de + k * se AS eeg_start, eeg_start_sample + de + k * se + we AS eeg_stop, a0 + k * sa AS audio_start, a0 + k * sa + wa AS audio_stop, round(k * {stride}::DOUBLE, 6) AS offset_sec FROM {name}w)"""


_SELECT_SYNC = "SELECT row_id, record_id, eeg_start, eeg_stop, audio_start, audio_stop, offset_sec FROM s"
_CLEAN = "CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END"
_BLOCK = "WITH b AS (SELECT row_id, eeg_start_sample s, eeg_end_sample e, CASE WHEN eeg_end_sample - eeg_start_sample >= 500 THEN (eeg_end_sample - eeg_start_sample - 500) // 250 + 1 ELSE 0 END n FROM trial_manifest WHERE eeg_end_sample > eeg_start_sample)"
SQL = {
    "pair_events": f"WITH {_R} SELECT * FROM p",
    "orphan_events": f"WITH {_R}, c AS (SELECT eeg_file, count(*) FILTER (k = 'ROWS') AS starts, count(*) FILTER (k = 'ROWE') AS ends FROM e GROUP BY 1), n AS (SELECT eeg_file, count(*) AS pairs FROM p GROUP BY 1) SELECT eeg_file, starts, ends, coalesce(pairs, 0) AS pairs, starts - coalesce(pairs, 0) AS orphan_starts, ends - coalesce(pairs, 0) AS orphan_ends FROM c LEFT JOIN n USING (eeg_file)",
    "prefix_unresolved": f"WITH {_R}, f AS (SELECT eeg_file, min(sample) AS first_context FROM e WHERE regexp_matches(k, '^(?i)CH\\s*0*[0-9]+$') GROUP BY 1) SELECT p.*, first_context FROM p JOIN f USING (eeg_file) WHERE start_sample < first_context",
    "interval_duration": "SELECT row_id, round((eeg_end_sample - eeg_start_sample) / nullif(eeg_sampling_rate, 0), 9) AS seconds, (eeg_end_sample - eeg_start_sample) / nullif(eeg_sampling_rate, 0) < 0.1 AS implausible FROM trial_manifest",
    "quantize": "SELECT DISTINCT window_id, round_even(audio_start_sec * audio_source_sample_rate_hz, 0)::BIGINT AS audio_start, round_even(window_offset_sec * eeg_sampling_rate_hz, 0)::BIGINT AS eeg_offset FROM pl_windows",
    "asof_join": "WITH w AS (SELECT DISTINCT window_id, eeg_file, eeg_start_sample FROM pl_windows), m AS (SELECT eeg_file, sample, max(onset) AS onset FROM marker_stream WHERE trial_type = 'ROWS' GROUP BY 1, 2) SELECT window_id, m.sample AS row_start, round(m.onset, 6) AS row_onset FROM w ASOF LEFT JOIN m ON w.eeg_file = m.eeg_file AND w.eeg_start_sample >= m.sample",
    "block_windows_drop": f"{_BLOCK}, w AS (SELECT row_id, s + unnest(range(n)) * 250 AS ws FROM b) SELECT row_id, ws AS window_start, ws + 500 AS window_stop, 500::BIGINT AS valid, 0::BIGINT AS padded FROM w",
    "block_windows_pad": f"{_BLOCK}, w AS (SELECT row_id, e, s + unnest(range(n + CASE WHEN s + n * 250 < e THEN 1 ELSE 0 END)) * 250 AS ws FROM b) SELECT row_id, ws AS window_start, least(ws + 500, e) AS window_stop, least(ws + 500, e) - ws AS valid, 500 - (least(ws + 500, e) - ws) AS padded FROM w",
    "sync_windows": f"WITH {_sync_sql(3.0, 3.0, 0.0)} {_SELECT_SYNC}",
    "sync_windows_overlap": f"WITH {_sync_sql(3.0, 0.5, 200.0)} {_SELECT_SYNC}",
    "window_exclusions": f"WITH {_sync_sql(3.0, 3.0, 0.0)} SELECT reason, count(*) AS n_trials FROM sp WHERE reason IS NOT NULL GROUP BY 1",
    "window_audit": f"WITH {_sync_sql(3.0, 3.0, 0.0)} SELECT {_CLEAN} AS split, count(*) AS n_windows, count(DISTINCT (audio_file, audio_start, audio_stop)) AS n_targets, count(DISTINCT lower(trim(split_group_id))) AS n_groups, count(DISTINCT subject_id) AS n_entities, count(*) FILTER (eeg_start < eeg_start_sample OR eeg_stop > eeg_end_sample OR audio_start < a0 OR audio_stop > a1) AS n_outside, count(*) FILTER (eeg_stop - eeg_start <> we) AS n_wrong_length FROM s GROUP BY 1",
    "common_support": "WITH " + ", ".join(_sync_sql(3.0, 0.5, x, f"s{int(x)}_") for x in DELAYS) + " " + " INTERSECT ".join(f"SELECT record_id, audio_start, audio_stop FROM s{int(x)}_" for x in DELAYS),
    "window_jsonl_digest": f"""WITH {_sync_sql(3.0, 3.0, 0.0)}, l AS (SELECT row_id, eeg_start, '{{"audio_start":' || audio_start || ',"audio_stop":' || audio_stop || ',"eeg_start":' || eeg_start || ',"eeg_stop":' || eeg_stop || ',"record_id":"' || record_id || '","row_id":' || row_id || '}}' AS line FROM s),
g AS (SELECT substr(sha256(row_id::VARCHAR), 1, 2) AS bucket, sha256(string_agg(line, chr(10) ORDER BY row_id, eeg_start, line)) AS digest, count(*) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest, sum(n)::BIGINT AS n_windows FROM g""",
    "window_ids": f"""WITH {_sync_sql(3.0, 3.0, 0.0)}, i AS (SELECT row_id, k, record_id, eeg_start, eeg_stop, 'pl-audio-target-v1-' || substr(sha256('pl-audio-target-v1' || chr(0) || array_to_string(string_split(audio_file, '/')[-2:], '/') || chr(0) || audio_start || chr(0) || audio_stop), 1, 24) AS target_id FROM s)
SELECT row_id, k, target_id, 'pl-window-v1-' || substr(sha256('pl-speech-window-v1' || chr(0) || record_id || chr(0) || target_id || chr(0) || eeg_start || chr(0) || eeg_stop || chr(0) || '0.000000000'), 1, 24) AS window_id FROM i""",
    "unique_targets": "SELECT audio_target_id, min(window_id) AS first_window, count(*) AS n_rows, count(DISTINCT (audio_file, audio_start_sample, audio_stop_sample)) = 1 AS consistent FROM pl_windows WHERE audio_target_id IS NOT NULL GROUP BY 1",
    "chapter_rows": """WITH e AS (SELECT *, sum(is_chapter_marker::INT) OVER w AS episode, last_value(CASE WHEN is_chapter_marker THEN try_cast(normalized_text AS INT) END IGNORE NULLS) OVER w AS chapter FROM material_units WINDOW w AS (PARTITION BY source_excel_file ORDER BY source_excel_row, unit_id ROWS UNBOUNDED PRECEDING))
SELECT unit_id, chapter, row_number() OVER (PARTITION BY source_excel_file, episode ORDER BY source_excel_row, unit_id)::INTEGER AS row_in_chapter FROM e WHERE NOT is_chapter_marker""",
}
QUERIES = {k: globals()[k] for k in SQL}
