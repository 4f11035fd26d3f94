"""Cutting oversized windows at the markers of their recording (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.intervals import window_scale

#: Samples in one cell of the range join between windows and markers.
CELL = 4096
#: Separators from coarse to fine: the first row start of a chapter, a row start, a row end; below them a piece is cut at any sample.
LEVELS = ("chapter", "ROWS", "ROWE")
CHAPTER = r"^CH\s*[0-9]+$"

PIECES = "window_id string, variant int, piece int, start_sample long, stop_sample long, cut string"


def oversized(windows: DataFrame) -> DataFrame:
    """Windows with more samples than ``window_sec`` allows, with ``limit`` and ``overlap`` in samples.

    Equal rows are one window. Rows of one window_id that differ are all kept, numbered by ``variant`` in the order of
    (start, stop, limit, overlap, file). Whether ``window_sec`` and ``stride_sec`` of a row are in milliseconds is
    judged by the row's own span, sample counts and trial duration. Windows with a null or non-positive bound, rate or
    window_sec are left out; a null stride means no overlap; an overlap is at least 0 and leaves room for one new sample.
    """
    rate, scale = F.col("eeg_sampling_rate_hz"), window_scale(windows.columns)
    limit = F.rint(F.col("window_sec") * scale * rate).cast("long")
    over = F.rint((F.col("window_sec") - F.col("stride_sec")) * scale * rate).cast("long")
    w = windows.select("window_id", "eeg_file", F.col("eeg_start_sample").alias("start"), F.col("eeg_stop_sample").alias("stop"), limit.alias("limit"), over.alias("over"))
    w = w.where((F.col("limit") > 0) & (F.col("stop") - F.col("start") > F.col("limit")) & F.col("window_id").isNotNull())
    w = w.withColumn("overlap", F.greatest(F.lit(0), F.least(F.coalesce("over", F.lit(0)), F.col("limit") - 1))).drop("over").distinct()
    order = Window.partitionBy("window_id").orderBy("start", "stop", "limit", "overlap", "eeg_file")
    return w.withColumn("variant", F.row_number().over(order) - 1)


def _greedy(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of a batch at once, piece by piece: the last coarsest boundary within the limit, else a finer one, else the limit."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        start, stop, limit, overlap = (np.asarray(b.column(c), dtype=np.int64) for c in ("start", "stop", "limit", "overlap"))
        marks = []
        for level in LEVELS:
            col = b.column(level)
            size = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
            who = np.repeat(np.arange(n), size)
            at = np.asarray(col.flatten(), dtype=np.int64) - start[who]
            marks.append((who, at))
        span = int((stop - start).max()) + 2
        (cw, ca), (rw, ra) = marks[:2]  # a chapter begins with its first row, where it has one
        i = np.searchsorted(rw * span + ra, cw * span + ca)
        fits = np.append(rw, -1)[i] == cw
        marks[0] = rw[np.unique(i[fits])], ra[np.unique(i[fits])]
        marks = [(np.append(-1, w), np.append(0, a)) for w, a in marks]
        keys = [w * span + a for w, a in marks]
        live, s, k = np.arange(n), np.zeros(n, np.int64), 0
        length = stop - start
        out = []
        while len(live):
            e = s[live] + limit[live]
            last = e >= length[live]
            cut, level = np.where(last, length[live], e), np.where(last, len(LEVELS) + 1, len(LEVELS))
            low = s[live] + overlap[live]
            for j in range(len(LEVELS) - 1, -1, -1):
                i = np.searchsorted(keys[j], live * span + np.minimum(e, length[live] - 1), "right") - 1
                at = marks[j][1][i]
                fits = ~last & (marks[j][0][i] == live) & (at > low)
                cut, level = np.where(fits, at, cut), np.where(fits, j, level)
            out.append((live, np.full(len(live), k), s[live] + start[live], cut + start[live], level))
            s[live] = cut - overlap[live]
            live, k = live[~last], k + 1
        who, k, a, z, level = (np.concatenate(x) for x in zip(*out))
        names = np.array([*LEVELS, "sample", "end"], dtype=object)
        yield pa.RecordBatch.from_pydict({"window_id": b.column("window_id").take(pa.array(who)), "variant": b.column("variant").take(pa.array(who)), "piece": pa.array(k.astype(np.int32)), "start_sample": pa.array(a), "stop_sample": pa.array(z), "cut": pa.array(names[level].tolist(), pa.string())})


def pieces(windows: DataFrame, markers: DataFrame) -> DataFrame:
    """(window_id, variant, piece, start_sample, stop_sample, cut) of every oversized window.

    Pieces follow one another, none longer than ``limit``; each but the first starts ``overlap`` samples before the
    end of the one before. A piece ends at the last coarsest boundary that leaves it within the limit: where a chapter's
    first row starts, else a row start, else a row end, else at the limit itself (``cut`` says which; ``end`` is the end
    of the window). Repeated markers are one; markers without a sample are ignored; a recording without row markers gives
    cuts by samples. Windows and markers meet in cells of CELL samples of a recording, so that neither a busy recording
    nor a long one gathers in one task.
    """
    w = oversized(windows)
    key = ["window_id", "variant"]
    cells = w.select(*key, "eeg_file", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("stop") / CELL))).alias("cell"))
    kind = F.when(F.col("trial_type").isin(*LEVELS[1:]), F.col("trial_type")).when(F.upper(F.trim("trial_type")).rlike(CHAPTER), LEVELS[0])
    m = markers.select("eeg_file", kind.alias("kind"), "sample", F.floor(F.col("sample") / CELL).alias("cell")).where(F.col("kind").isNotNull() & F.col("sample").isNotNull()).distinct()
    inside = cells.join(m, ["eeg_file", "cell"]).where((F.col("sample") > F.col("start")) & (F.col("sample") < F.col("stop")))
    arrays = inside.groupBy(*key).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == x, F.col("sample")))).alias(x) for x in LEVELS])
    return w.join(arrays, key, "left").select(*key, "start", "stop", "limit", "overlap", *LEVELS).mapInArrow(_greedy, PIECES)
