"""Queries of text functions over trial_manifest and material_units."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import ids, text as X
from cohortloom.store import table

_UNITS = lambda s, d: table(s, d, "material_units")
_TRIALS = lambda s, d: table(s, d, "trial_manifest")


def text_normalize(s, d):
    return _TRIALS(s, d).select("row_id", X.normalize(F.col("raw_text")).alias("normalized"))


def normalize_trace(s, d):
    t = _TRIALS(s, d).select("row_id", F.explode(X.normalize_trace(F.col("raw_text"))).alias("t"))
    return t.select("row_id", F.col("t.rule").alias("rule"), F.col("t.count").alias("n"))


def char_counts(s, d):
    c = F.col("raw_text")
    return _TRIALS(s, d).select("row_id", X.raw_count(c).alias("raw"), X.visible_count(c).alias("visible"), X.lit_count(c).alias("lit"))


def word_count(s, d):
    return table(s, d, "documents").select("doc_id", X.word_count(F.col("text"), r"[\p{L}\p{N}]+").alias("words"))


def normalize_identifier(s, d):
    return table(s, d, "documents").select(X.normalize_identifier(F.col("source")).alias("source_id"), X.normalize_identifier(F.col("origin_id")).alias("origin")).distinct()


def stable_ids(s, d):
    u = _UNITS(s, d)
    return u.select("unit_id", ids.stable_id("sentence-v1", F.col("book_id"), F.col("source_excel_file"), F.col("source_excel_row")).alias("sentence"), ids.text_hash(F.col("raw_text")).alias("raw_hash"), ids.text_hash(F.col("normalized_text")).alias("normalized_hash"))


def entity_ids(s, d):
    full = F.concat_ws("::", "dataset_version", "paradigm", "subject_id")
    t = _TRIALS(s, d).select("dataset_version", "paradigm", "subject_id", F.concat(F.lit("subject-group-v1-"), ids.joined_id(F.lit("subject-group-v1"), full)).alias("entity")).distinct()
    return t


def content_id(s, d):
    payload = F.to_json(F.struct("book_id", "chapter_id", "global_text_id", "normalized_text_hash", "sentence_id", "source_excel_row"), {"ignoreNullFields": "false"})
    return _UNITS(s, d).select("unit_id", F.concat(F.lit("content-v1-"), F.substring(F.sha2(payload.cast("binary"), 256), 1, 24)).alias("content_id"))


def safe_filename(s, d):
    return _TRIALS(s, d).select(X.safe_filename(F.col("eeg_file"), ".npz").alias("file_name"), "eeg_file").distinct()


def regex_extract(s, d):
    p = r"sub-([^_/]+)_ses-([^_]+)_task-([^_]+)_chap-([0-9]+)_run-([^_]+)_eeg\.vhdr$"
    f = F.col("eeg_file")
    return _TRIALS(s, d).select("eeg_file").distinct().select("eeg_file", *[F.regexp_extract(f, p, i + 1).alias(n) for i, n in enumerate(("subject", "session", "task", "chapter", "run"))])


def run_decode(s, d):
    r = F.trim("run_id")
    n = F.expr("try_cast(substring(trim(run_id), 2) AS INT)")
    two = r.rlike("^[12][0-9]$")
    return _TRIALS(s, d).select("run_id").distinct().select("run_id", F.when(two & r.startswith("1"), n).when(two & r.startswith("2"), n + 14).alias("chapter"))


def char_spans(s, d):
    u = _UNITS(s, d).select("unit_id", "normalized_text", F.lit(1.0).alias("onset"))
    return X.char_spans(u, "unit_id", "normalized_text", "onset", 0.35).withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


def quality_flags(s, d):
    """Flags split on any separator, cleaned, distinct and sorted again; `ok` when none is left."""
    flags = F.filter(F.transform(F.split(F.lower("quality_flag"), r"[|;,]"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "ok"))
    joined = F.array_join(F.array_sort(F.array_distinct(flags)), "|")
    return _TRIALS(s, d).select("row_id", F.when(joined == "", "ok").otherwise(joined).alias("flags"))


_INV, _WS = X.INVISIBLE, X.WHITE_SPACE
_PFROM, _PTO = "".join(X.PUNCTUATION).replace("'", "''"), "".join(X.PUNCTUATION.values()).replace("'", "''")


def _stages_sql(src: str) -> str:
    return f"""
a AS (SELECT *, regexp_replace(x, '\\r\\n?', chr(10), 'g') AS a FROM {src}),
b AS (SELECT *, regexp_replace(a, '{_INV}', '', 'g') AS b FROM a),
c AS (SELECT *, nfc_normalize(b) AS c FROM b),
w AS (SELECT *, translate(c, '{X._WIDE_FROM}', '{X._WIDE_TO.replace("'", "''")}') AS w FROM c),
p AS (SELECT *, translate(w, '{_PFROM}', '{_PTO}') AS p FROM w),
s AS (SELECT *, replace(p, chr(10), '') AS s FROM p),
z AS (SELECT *, regexp_replace(s, '{_WS}', '', 'g') AS z FROM s)"""


_FLAGS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(quality_flag), '[|;,]'), lambda f: trim(f)), lambda f: f <> '' AND f <> 'ok'))), '|')"
SQL = {
    "text_normalize": f"WITH t AS (SELECT row_id, raw_text AS x FROM trial_manifest), {_stages_sql('t')} SELECT row_id, z AS normalized FROM z",
    "normalize_trace": f"""WITH t AS (SELECT row_id, raw_text AS x FROM trial_manifest), {_stages_sql('t')},
k AS (SELECT row_id, unnest([
{{'rule': '{X.RULES[0]}', 'n': CASE WHEN a <> x THEN len(regexp_extract_all(x, '\\r\\n?|\\n')) ELSE 0 END}}, {{'rule': '{X.RULES[1]}', 'n': length(a) - length(b)}},
{{'rule': '{X.RULES[2]}', 'n': CASE WHEN c <> b THEN 1 ELSE 0 END}}, {{'rule': '{X.RULES[3]}', 'n': len(regexp_extract_all(c, '{X.WIDE}'))}},
{{'rule': '{X.RULES[4]}', 'n': len(regexp_extract_all(w, '[{_PFROM}]'))}}, {{'rule': '{X.RULES[5]}', 'n': length(p) - length(s)}}, {{'rule': '{X.RULES[6]}', 'n': length(s) - length(z)}}]) AS e FROM z WHERE x IS NOT NULL)
SELECT row_id, e.rule AS rule, e.n::INTEGER AS n FROM k WHERE e.n > 0""",
    "char_counts": f"SELECT row_id, length(raw_text)::INTEGER AS raw, length(regexp_replace(raw_text, '{_WS}', '', 'g'))::INTEGER AS visible, length(regexp_replace(raw_text, '[\\p{{P}}\\p{{Z}}\\p{{C}}]', '', 'g'))::INTEGER AS lit FROM trial_manifest",
    "word_count": "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))::INTEGER AS words FROM documents",
    "normalize_identifier": f"""WITH i AS (SELECT regexp_replace(lower(regexp_replace(nfc_normalize(source), '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', '-', 'g') a, regexp_replace(lower(regexp_replace(nfc_normalize(origin_id), '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', '-', 'g') b FROM documents)
SELECT DISTINCT nullif(a, '') AS source_id, nullif(b, '') AS origin FROM i""",
    "stable_ids": """SELECT unit_id, 'sentence-v1-' || substr(sha256('["sentence-v1",' || to_json(book_id)::VARCHAR || ',' || to_json(source_excel_file)::VARCHAR || ',' || coalesce(source_excel_row::VARCHAR, 'null') || ']'), 1, 24) AS sentence,
'sha256:' || sha256(raw_text) AS raw_hash, 'sha256:' || sha256(normalized_text) AS normalized_hash FROM material_units""",
    "entity_ids": "SELECT DISTINCT dataset_version, paradigm, subject_id, 'subject-group-v1-' || substr(sha256('subject-group-v1' || chr(0) || dataset_version || '::' || paradigm || '::' || subject_id), 1, 24) AS entity FROM trial_manifest",
    "content_id": """SELECT unit_id, 'content-v1-' || substr(sha256('{"book_id":' || coalesce(to_json(book_id)::VARCHAR, 'null') || ',"chapter_id":' || coalesce(chapter_id::VARCHAR, 'null') || ',"global_text_id":' || coalesce(to_json(global_text_id)::VARCHAR, 'null') || ',"normalized_text_hash":' || coalesce(to_json(normalized_text_hash)::VARCHAR, 'null') || ',"sentence_id":' || coalesce(to_json(sentence_id)::VARCHAR, 'null') || ',"source_excel_row":' || coalesce(source_excel_row::VARCHAR, 'null') || '}'), 1, 24) AS content_id FROM material_units""",
    "safe_filename": "WITH f AS (SELECT DISTINCT eeg_file, substr(regexp_replace(regexp_replace(eeg_file, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) s FROM trial_manifest) SELECT eeg_file, CASE WHEN s = '' THEN 'artifact' ELSE s END || '-' || substr(sha256(eeg_file), 1, 12) || '.npz' AS file_name FROM f",
    "regex_extract": "WITH f AS (SELECT DISTINCT eeg_file FROM trial_manifest) SELECT eeg_file, " + ", ".join(f"regexp_extract(eeg_file, 'sub-([^_/]+)_ses-([^_]+)_task-([^_]+)_chap-([0-9]+)_run-([^_]+)_eeg\\.vhdr$', {i + 1}) AS {n}" for i, n in enumerate(("subject", "session", "task", "chapter", "run"))) + " FROM f",
    "run_decode": "SELECT DISTINCT run_id, CASE WHEN regexp_matches(trim(run_id), '^1[0-9]$') THEN substr(trim(run_id), 2)::INTEGER WHEN regexp_matches(trim(run_id), '^2[0-9]$') THEN substr(trim(run_id), 2)::INTEGER + 14 END AS chapter FROM trial_manifest",
    "char_spans": """WITH c AS (SELECT unit_id, unnest(range(length(normalized_text))) AS position, normalized_text t FROM material_units WHERE normalized_text <> ''),
l AS (SELECT unit_id, position::INTEGER AS position, substr(t, position + 1, 1) AS char FROM c WHERE NOT regexp_matches(substr(t, position + 1, 1), '[\\p{P}\\p{Z}\\p{C}]')),
k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY position) - 1 AS k FROM l)
SELECT unit_id, position, char, k::INTEGER AS ordinal, round(1.0::DOUBLE + k * 0.35::DOUBLE, 6) AS start_sec, round(1.0::DOUBLE + (k + 1) * 0.35::DOUBLE, 6) AS end_sec FROM k""",
    "quality_flags": f"SELECT row_id, CASE WHEN {_FLAGS} = '' THEN 'ok' ELSE {_FLAGS} END AS flags FROM trial_manifest",
}
QUERIES = {f.__name__: f for f in (text_normalize, normalize_trace, char_counts, word_count, normalize_identifier, stable_ids, entity_ids, content_id, safe_filename, regex_extract, run_decode, char_spans, quality_flags)}
