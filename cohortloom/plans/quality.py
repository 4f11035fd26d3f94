"""Queries of the column-level quality profile (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators import profile as P
from cohortloom.store import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, column_name) of the cells of trial_manifest that break their column's contract."""
    return P.violations(table(spark, d, "trial_manifest"), table(spark, d, "audio_files"))


def p5_base(spark: SparkSession, d: str) -> DataFrame:
    """Exact base aggregates of every column and load; load_no's own row is of one value."""
    m = table(spark, d, "trial_manifest")
    return P.profile(m, "load_no", m.columns).drop("n_violations")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "trial_manifest")
    return P.drift(P.contracted(m, table(spark, d, "audio_files")), "load_no", "row_id", P.contract_columns(m.schema))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The base aggregates and violations with, for each load but the first, what the classifier two-sample test says of each column against the load before."""
    m = table(spark, d, "trial_manifest")
    return P.with_drift(P.profile(P.contracted(m, table(spark, d, "audio_files")), "load_no", m.columns), _drift(spark, d))


def p5_drift(spark: SparkSession, d: str) -> DataFrame:
    """What changed between successive loads, by the classifier two-sample test.

    row_id, load_no, recorded_at and loaded_at are no features: they name or date the delivery and would tell any two
    loads apart. Their aggregates are in p5_profile.
    """
    return _drift(spark, d)


QUERIES = {"p5_found": p5_found, "p5_base": p5_base, "p5_profile": p5_profile, "p5_drift": p5_drift}
_NUMBERS = (
    "row_id", "eeg_start_sample", "eeg_end_sample", "split_seed", "chapter_id", "char_count", "raw_char_count", "highlight_char_count", "word_count", "stimulus_position", "source_excel_row", "event_pair_index",
    "eeg_duration_sec", "eeg_sampling_rate", "audio_start_sec", "audio_end_sec", "audio_duration_sec", "text_alignment_score", "global_text_alignment_score",
)
_TIMES = ("recorded_at", "loaded_at")
SQL: dict[str, str] = {
    "p5_base": f"""
WITH a AS (SELECT load_no AS load, {', '.join(f'{c}::DOUBLE AS {c}' for c in _NUMBERS)}, {', '.join(f'epoch_us({c}) / 1e6::DOUBLE AS {c}' for c in _TIMES)}, load_no::DOUBLE AS load_no FROM trial_manifest),
b AS (SELECT * EXCLUDE ({', '.join((*_NUMBERS, *_TIMES, 'load_no'))}), load_no AS load FROM trial_manifest),
x AS (SELECT load, column_name, v, NULL::VARCHAR AS t FROM a UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(* EXCLUDE (load))))
UNION ALL SELECT load, column_name, NULL::DOUBLE, t FROM b UNPIVOT INCLUDE NULLS (t FOR column_name IN (COLUMNS(* EXCLUDE (load)))))
SELECT load, column_name, count(*) AS n_rows, count(*) - count(v) - count(t) AS n_null, min(v) FILTER (NOT isnan(v)) AS min_number, max(v) FILTER (NOT isnan(v)) AS max_number, min(t) AS min_text, max(t) AS max_text,
  count(DISTINCT v) + count(DISTINCT t) AS distinct_count, round((count(*) - count(v) - count(t)) / count(*), 9) AS null_rate FROM x GROUP BY 1, 2""",
}
