"""Alignment queries: workbook against its second delivery, recordings against their workbook rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.text import lit_count
from cohortloom.operators import align as L
from cohortloom.store import table


def _sequences(s, d):
    """Workbook texts in row order, and the trial texts of the same chapter in row order, per book and chapter."""
    g = F.concat_ws("/", "book_id", F.col("chapter_id").cast("string"))
    u = table(s, d, "material_units").where("NOT is_chapter_marker AND chapter_id IS NOT NULL").groupBy(g.alias("g"), F.col("source_excel_row").alias("pos")).agg(F.min("normalized_text").alias("text"))
    t = table(s, d, "trial_manifest").where("chapter_id IS NOT NULL AND source_excel_row IS NOT NULL").groupBy(g.alias("g"), F.col("source_excel_row").alias("pos")).agg(F.min("normalized_text").alias("text"))
    return t, u


def monotonic_align(s, d):
    t, u = _sequences(s, d)
    return L.anchors(t, u, "g")


def fuzzy_align(s, d):
    t, u = _sequences(s, d)
    return L.gap_matches(t, u, L.anchors(t, u, "g"), "g").withColumn("score", F.round("score", 6))


def duration_dp(s, d):
    """Trials of a recording aligned to the workbook rows of its book and chapter by their durations."""
    t = table(s, d, "trial_manifest").where("chapter_id IS NOT NULL AND eeg_sampling_rate > 0")
    sec = (F.col("eeg_end_sample") - F.col("eeg_start_sample")) / F.col("eeg_sampling_rate")
    e = t.select("eeg_file", "book_id", "chapter_id", "eeg_start_sample", "record_id", sec.alias("actual")).dropDuplicates(["record_id"])
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("eeg_file").orderBy("eeg_start_sample", "record_id")))
    u = table(s, d, "material_units").where("NOT is_chapter_marker AND chapter_id IS NOT NULL").groupBy("book_id", "chapter_id", F.col("source_excel_row").alias("pos")).agg(F.min("raw_text").alias("text"))
    files = e.select("eeg_file", "book_id", "chapter_id").distinct()
    u = u.join(files, ["book_id", "chapter_id"]).select("eeg_file", "pos", (lit_count(F.col("text")) * 0.15).alias("expected"))
    return L.duration_matches(e.select("eeg_file", "pos", "actual"), u, "eeg_file", 0.25).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (monotonic_align, fuzzy_align, duration_dp)}
SQL: dict[str, str] = {}
