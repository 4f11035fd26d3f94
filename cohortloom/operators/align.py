"""Sequence alignment inside a group: exact anchors, reciprocal fuzzy matches in the gaps, duration alignment.

The dynamic programs need a whole sequence at once, so a group (a book's workbook, a recording) is one task by
definition of the operator; groups are independent and run in parallel.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.audit import lcs_lengths, similarity

# Fixed values of the duration alignment.
GAP_COST, MATCH_CAP, LEAST_SCALE, LEAST_REJECT = 2.0, 5.0, 0.15, 0.8
FUZZY_SCORE = 96.0


def anchors(source: DataFrame, target: DataFrame, group: str) -> DataFrame:
    """(group, source_pos, target_pos): equal texts in the longest matching blocks of two ordered sequences of texts.

    ``source`` and ``target``: group, pos, text. Null texts match nothing. Order is by pos.
    """

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("pos"), b.sort_by("pos")
        x = [t if t is not None else ("a", i) for i, t in enumerate(a.column("text").to_pylist())]
        y = [t if t is not None else ("b", i) for i, t in enumerate(b.column("text").to_pylist())]
        blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        i = [m.a + k for m in blocks for k in range(m.size)]
        j = [m.b + k for m in blocks for k in range(m.size)]
        pos = lambda t, at: t.column("pos").take(pa.array(at, pa.int64())).cast(pa.int64()).combine_chunks()
        return pa.table({group: pa.array([key[0].as_py()] * len(i), pa.string()), "source_pos": pos(a, i), "target_pos": pos(b, j)})

    cols = lambda d: d.select(F.col(group).cast("string").alias(group), F.col("pos").cast("long").alias("pos"), "text")
    return cols(source).groupBy(group).cogroup(cols(target).groupBy(group)).applyInArrow(run, f"{group} string, source_pos long, target_pos long")


def _gap(df: DataFrame, marks: DataFrame, group: str, side: str) -> DataFrame:
    """Rows that no anchor uses, with the number of anchors before them."""
    m = marks.select(group, F.col(f"{side}_pos").alias("pos"), F.lit(1).alias("anchor"))
    x = df.select(F.col(group).cast("string").alias(group), F.col("pos").cast("long").alias("pos"), "text").join(m, [group, "pos"], "left")
    return x.withColumn("gap", F.coalesce(F.sum("anchor").over(Window.partitionBy(group).orderBy("pos")), F.lit(0))).where("anchor IS NULL AND text IS NOT NULL AND text <> ''").drop("anchor")


def gap_matches(source: DataFrame, target: DataFrame, marks: DataFrame, group: str, score: float = FUZZY_SCORE) -> DataFrame:
    """(group, source_pos, target_pos, score): reciprocal best matches between anchors, kept only where they go forward.

    Candidates share a gap and differ in length by at most max(2, 0.15 of the longer, rounded half to even). Best is
    by score, then by smaller position. A match is kept if its target lies beyond all targets of earlier matches.
    """
    a = _gap(source, marks, group, "source").select(group, "gap", F.col("pos").alias("source_pos"), F.col("text").alias("a"))
    b = _gap(target, marks, group, "target").select(group, "gap", F.col("pos").alias("target_pos"), F.col("text").alias("b"))
    la, lb = F.length("a"), F.length("b")
    c = a.join(b, [group, "gap"]).where(F.abs(la - lb) <= F.greatest(F.lit(2), F.rint(F.greatest(la, lb) * 0.15)))
    c = c.where(200.0 * F.least(la, lb) >= score * (la + lb))  # the score cannot be higher than this
    c = similarity(c, "a", "b").where(F.col("score") >= score)
    best = lambda mine, other: F.row_number().over(Window.partitionBy(group, mine).orderBy(F.desc("score"), other))
    c = c.withColumn("_a", best("source_pos", "target_pos")).withColumn("_b", best("target_pos", "source_pos")).where("_a = 1 AND _b = 1")
    before = F.max("target_pos").over(Window.partitionBy(group, "gap").orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("_m", before).where(F.col("_m").isNull() | (F.col("target_pos") > F.col("_m"))).select(group, "source_pos", "target_pos", "score")


def align_durations(actual: np.ndarray, expected: np.ndarray, pace: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit index of each event, -1 for none, and the residual, by a monotone dynamic program with gap costs.

    Row by row over arrays; the running unit gap is a prefix minimum. Among equal costs a match goes before a skipped
    event before a skipped unit.
    """
    n, m = len(actual), len(expected)
    unit, residual = np.full(n, -1), np.full(n, np.nan)
    if not n or not m:
        return unit, residual
    scale = max(LEAST_SCALE, pace)
    r = np.abs(actual[:, None] - (expected + (np.median(actual) - np.median(expected)))[None, :])
    cost = np.minimum(r / scale, MATCH_CAP)
    at = np.arange(m + 1) * GAP_COST
    table = np.zeros((n + 1, m + 1))
    table[0] = at
    for i in range(1, n + 1):
        row = np.empty(m + 1)
        row[0] = i * GAP_COST
        row[1:] = np.minimum(table[i - 1, :-1] + cost[i - 1], table[i - 1, 1:] + GAP_COST)
        table[i] = np.minimum.accumulate(row - at) + at
    i, j = n, m
    while i and j:
        if np.isclose(table[i, j], table[i - 1, j - 1] + cost[i - 1, j - 1], rtol=0, atol=1e-9):
            i, j = i - 1, j - 1
            unit[i], residual[i] = j, r[i, j]
        elif np.isclose(table[i, j], table[i - 1, j] + GAP_COST, rtol=0, atol=1e-9):
            i -= 1
        else:
            j -= 1
    far = residual > max(LEAST_REJECT, 2 * pace)
    unit[far] = -1
    return unit, residual


def duration_matches(events: DataFrame, units: DataFrame, group: str, pace: float) -> DataFrame:
    """(group, event_pos, unit_pos, score): ``events``: group, pos, actual; ``units``: group, pos, expected. Events without a unit keep null."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("pos"), b.sort_by("pos")
        unit, residual = align_durations(np.asarray(a.column("actual"), float), np.asarray(b.column("expected"), float), pace)
        pos = np.asarray(b.column("pos"), dtype=np.int64)
        hit = unit >= 0
        score = np.maximum(0.0, 100.0 * (1 - residual / max(LEAST_REJECT, 2 * pace)))
        at = pa.array(np.where(hit, pos[np.maximum(unit, 0)] if len(pos) else 0, 0), mask=~hit)
        return pa.table({group: pa.array([key[0].as_py()] * len(unit), pa.string()), "event_pos": a.column("pos").combine_chunks(), "unit_pos": at, "score": pa.array(np.where(hit, score, 0.0), mask=~hit)})

    e = events.where("actual IS NOT NULL").select(F.col(group).cast("string").alias(group), F.col("pos").cast("long").alias("pos"), F.col("actual").cast("double").alias("actual"))
    u = units.where("expected IS NOT NULL").select(F.col(group).cast("string").alias(group), F.col("pos").cast("long").alias("pos"), F.col("expected").cast("double").alias("expected"))
    return e.groupBy(group).cogroup(u.groupBy(group)).applyInArrow(run, f"{group} string, event_pos long, unit_pos long, score double")


__all__ = ["anchors", "gap_matches", "align_durations", "duration_matches", "lcs_lengths"]
