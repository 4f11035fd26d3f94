"""Marker streams to intervals, as-of matching, and windows over intervals.

Ordered operators never sort a whole stream in one task: a stream is cut into cells of its order, each cell is sorted
by itself, and what a cell needs from those before it (its last marker, a running count) is carried over from one
aggregated row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples of one cell of a stream.
CELL = 1 << 15
#: How many times longer than the evidence a length may read before its unit is milliseconds: the square root of a thousand.
MILLI_RATIO = 31.622776601683793
CONTEXT = r"^(?i)CH\s*0*[0-9]+$"


def _cells(df: DataFrame, stream: str, at: str, cell: float) -> DataFrame:
    return df.withColumn("_cell", F.floor(F.col(at) / F.lit(cell)))


def _with_carry(df: DataFrame, stream: str, order: Sequence[str], values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each name, the last value with its condition strictly before the row, over all cells of the stream."""
    inside = Window.partitionBy(stream, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*order)
    per_cell = df.groupBy(stream, "_cell").agg(*[F.max_by(F.when(c, v), F.when(c, key)).alias(f"_l_{n}") for n, (v, c) in values.items()])
    earlier = Window.partitionBy(stream).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_cell.select(stream, "_cell", *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    own = df.withColumns({f"_o_{n}": F.last(F.when(c, v), ignorenulls=True).over(inside) for n, (v, c) in values.items()})
    out = own.join(carry, [stream, "_cell"], "left")  # a null stream has no carry, but its rows stay
    return out.withColumns({n: F.coalesce(f"_o_{n}", f"_c_{n}") for n in values}).drop(*[f"_o_{n}" for n in values], *[f"_c_{n}" for n in values])


def _running(df: DataFrame, stream: str, order: Sequence[str], flag: Column) -> Column | DataFrame:
    """Adds ``_before``: how many earlier rows of the stream have the flag."""
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    sums = df.groupBy(stream, "_cell").agg(F.sum("_flag").alias("_sum"))
    earlier = Window.partitionBy(stream).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(stream, "_cell", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(stream, "_cell").orderBy(*order)
    return df.withColumn("_in", F.sum("_flag").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_flag")).join(base, [stream, "_cell"]).withColumn("_before", F.col("_base") + F.col("_in")).drop("_flag", "_in", "_base")


def mark_events(markers: DataFrame, stream: str, sample: str, kind: str, order: Sequence[str], start: str = "ROWS", end: str = "ROWE", context: str = CONTEXT) -> DataFrame:
    """Marker rows with what precedes them: ``prev_kind`` and ``prev_sample`` of the last start or end marker, ``context`` at the row.

    ``order`` follows the sample as a tie-break; equal rows are interchangeable. Rows without stream, sample or kind
    are dropped, other markers are kept for context only.
    """
    k = F.trim(kind)
    df = markers.where(F.col(stream).isNotNull() & F.col(sample).isNotNull() & F.col(kind).isNotNull())
    df = df.select(stream, F.col(sample).alias("sample"), k.alias("kind"), *[F.coalesce(F.col(o).cast("string"), F.lit("")).alias(f"_t{i}") for i, o in enumerate(order)])
    df = _cells(df, stream, "sample", CELL)
    keys = ["sample", *[f"_t{i}" for i in range(len(order))]]
    row = F.col("kind").isin(start, end)
    out = _with_carry(df, stream, keys, {"_prev": (F.struct("kind", "sample"), row), "_ctx": (F.col("kind"), F.col("kind").rlike(context))})
    return out.withColumn("context", F.when(F.col("kind").rlike(context), F.col("kind")).otherwise(F.col("_ctx"))).withColumn("prev_kind", F.col("_prev.kind")).withColumn("prev_sample", F.col("_prev.sample")).drop("_prev", "_ctx")


def pair_markers(markers: DataFrame, stream: str, sample: str, kind: str, order: Sequence[str], start: str = "ROWS", end: str = "ROWE", context: str = CONTEXT) -> DataFrame:
    """(stream, start_sample, end_sample, pair_index, context): an end pairs with the start immediately before it among starts and ends, at a smaller sample."""
    e = mark_events(markers, stream, sample, kind, order, start, end, context)
    pair = (F.col("kind") == end) & (F.col("prev_kind") == start) & (F.col("sample") > F.col("prev_sample"))
    keys = ["sample", *[c for c in e.columns if c.startswith("_t")]]
    e = _running(e, stream, keys, pair)
    return e.where(pair).select(stream, F.col("prev_sample").alias("start_sample"), F.col("sample").alias("end_sample"), F.col("_before").cast("long").alias("pair_index"), "context")


def orphans(markers: DataFrame, stream: str, sample: str, kind: str, order: Sequence[str], start: str = "ROWS", end: str = "ROWE") -> DataFrame:
    """(stream, starts, ends, pairs, orphan_starts, orphan_ends): every start and end that no pair uses is an orphan."""
    e = mark_events(markers, stream, sample, kind, order, start, end)
    pair = (F.col("kind") == end) & (F.col("prev_kind") == start) & (F.col("sample") > F.col("prev_sample"))
    c = e.groupBy(stream).agg(F.count_if(F.col("kind") == start).alias("starts"), F.count_if(F.col("kind") == end).alias("ends"), F.count_if(pair).alias("pairs"))
    return c.select("*", (F.col("starts") - F.col("pairs")).alias("orphan_starts"), (F.col("ends") - F.col("pairs")).alias("orphan_ends"))


def prefix_unresolved(pairs: DataFrame, markers: DataFrame, stream: str, sample: str, kind: str, context: str = CONTEXT) -> DataFrame:
    """Pairs that start before the first context marker of their stream, or in a stream that has one nowhere before."""
    first = markers.where(F.trim(kind).rlike(context)).groupBy(stream).agg(F.min(sample).alias("first_context"))
    return pairs.join(first, stream).where(F.col("start_sample") < F.col("first_context"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, cell: float = CELL) -> DataFrame:
    """Left rows with ``value`` and ``matched_at`` of the last right row of the key at or before them; null where there is none.

    Of several right rows at one point the largest value counts; null keys match nothing. Both sides are cut into cells of the order; one union
    and one window per cell, with the last right row of each cell carried forward.
    """
    names = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(left_at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.where(F.col(right_at).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(right_at).cast("double").alias("_at")).agg(F.max(value).alias("_v"))
    b = b.select("_k", "_at", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_v")
    u = _cells(a.unionByName(b), "_k", "_at", cell)
    got = _with_carry(u, "_k", ["_at", "_side"], {"_m": (F.struct("_at", "_v"), F.col("_side") == 0)})
    return got.where("_side = 1").select("_row.*", F.col("_m._v").alias(value), F.col("_m._at").alias("matched_at"))


def block_windows(blocks: DataFrame, size: int, stride: int, tail: str = "drop", start: str = "start", stop: str = "stop") -> DataFrame:
    """Blocks times their windows: ``window_start, window_stop, valid, padded``. ``pad`` adds at most one short window, after the full ones."""
    if size <= 0 or stride <= 0 or tail not in ("drop", "pad"):
        raise ValueError("size and stride must be positive and tail drop or pad")
    length = F.col(stop) - F.col(start)
    n = F.when(length >= size, F.expr(f"(`{stop}` - `{start}` - {size}) div {stride}") + 1).otherwise(F.lit(0))
    rest = F.when(F.col(start) + F.col("_n") * stride < F.col(stop), 1).otherwise(0) if tail == "pad" else F.lit(0)
    b = blocks.where(length > 0).withColumn("_n", n).withColumn("_all", F.col("_n") + rest).where("_all > 0")
    w = b.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all").cast("long") - 1)))
    w = w.withColumn("window_start", F.col(start) + F.col("_k") * stride).withColumn("window_stop", F.least(F.col("window_start") + size, F.col(stop)))
    w = w.withColumn("valid", F.col("window_stop") - F.col("window_start")).withColumn("padded", F.lit(size) - F.col("valid"))
    return w.drop("_n", "_all", "_k")


REASONS = ("unverified_or_missing_audio_alignment", "audio_unreadable", "audio_bounds_exceed_file", "shorter_than_window_after_delay")


def sync_plan(trials: DataFrame, audio: DataFrame, window_sec: float, stride_sec: float, delay_ms: float | Column) -> DataFrame:
    """Trials with both clocks quantized (half to even), the number of windows and the one reason where there are none.

    A negative delay gives no windows. Reasons in order: no audio or bounds that are no numbers; unknown file; bounds
    beyond the file; shorter than the window.
    """
    delay = delay_ms / 1000.0 if isinstance(delay_ms, Column) else F.lit(delay_ms / 1000.0)
    number = lambda c: F.coalesce(F.abs(c) <= 1e300, F.lit(False))
    info = audio.where(F.col("audio_file").isNotNull()).groupBy("audio_file").agg(F.max("sample_rate_hz").cast("long").alias("audio_rate"), F.max("frame_count").alias("frames"))
    t = trials.join(info, "audio_file", "left")
    has = F.col("audio_file").isNotNull() & number("audio_start_sec") & number("audio_end_sec")
    q = lambda c: F.rint(c).cast("long")
    rate = q(F.col("eeg_sampling_rate"))
    t = t.withColumns({
        "we": q(F.lit(window_sec) * rate), "se": q(F.lit(stride_sec) * rate), "de": q(delay * rate), "wa": q(F.lit(window_sec) * F.col("audio_rate")), "sa": q(F.lit(stride_sec) * F.col("audio_rate")),
        "a0": F.when(has, q(F.col("audio_start_sec") * F.col("audio_rate"))), "a1": F.when(has, q(F.col("audio_end_sec") * F.col("audio_rate"))),
    })
    la, le = F.col("a1") - F.col("a0"), F.col("eeg_end_sample") - F.col("eeg_start_sample") - F.col("de")
    fits = (F.col("de") >= 0) & (la >= F.col("wa")) & (le >= F.col("we"))
    n = F.when(fits, F.least(F.expr("(a1 - a0 - wa) div sa"), F.expr("(eeg_end_sample - eeg_start_sample - de - we) div se")) + 1).otherwise(0)
    reason = F.when(~has, REASONS[0]).when(F.col("frames").isNull(), REASONS[1]).when((F.col("a1") > F.col("frames")) | (F.col("a0") < 0), REASONS[2]).when(n <= 0, REASONS[3])
    return t.withColumn("reason", reason).withColumn("n_windows", F.when(reason.isNull(), n).otherwise(0))


def sync_windows(plan: DataFrame, stride_sec: float, keep: Sequence[str]) -> DataFrame:
    """One row per window of a plan: EEG and audio bounds and the offset in seconds."""
    w = plan.where("n_windows > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows").cast("long") - 1)))
    e, a = F.col("eeg_start_sample") + F.col("de") + F.col("k") * F.col("se"), F.col("a0") + F.col("k") * F.col("sa")
    return w.select(*keep, "k", e.alias("eeg_start"), (e + F.col("we")).alias("eeg_stop"), a.alias("audio_start"), (a + F.col("wa")).alias("audio_stop"), (F.col("k") * stride_sec).alias("offset_sec"), "audio_rate")


def in_milliseconds(value: Column, evidence: Sequence[Column]) -> Column:
    """Is a length that should be in seconds in milliseconds? Judged by other lengths of the same row, in seconds.

    The unit is the one in which ``value`` is nearer, by ratio, to the least of the positive lengths of ``evidence``;
    null or non-positive evidence says nothing, and without any the value is in seconds. A null value gives false.
    """
    known = [F.when(e > 0, e) for e in evidence]
    least = F.least(*known) if len(known) > 1 else known[0]
    return F.coalesce(value > F.lit(MILLI_RATIO) * least, F.lit(False))


def window_scale(columns: Sequence[str]) -> Column:
    """1 or 0.001, the seconds in one unit of a window row's ``window_sec`` and ``stride_sec``, by its EEG span, sample counts and trial duration, as far as there are any."""
    rate = F.col("eeg_sampling_rate_hz")
    found = [F.try_divide((F.col("eeg_stop_sample") - F.col("eeg_start_sample")).cast("double"), rate)]
    found += [F.try_divide(F.col(c).cast("double"), rate) for c in ("eeg_sample_count", "valid_eeg_samples") if c in columns]
    found += [F.col("source_trial_eeg_duration_sec")] if "source_trial_eeg_duration_sec" in columns else []
    return F.when(in_milliseconds(F.col("window_sec"), found), F.lit(0.001)).otherwise(F.lit(1.0))


#: The same in SQL, for a row of the window table.
WINDOW_SCALE_SQL = (
    "CASE WHEN window_sec > sqrt(1000.0::DOUBLE) * list_min(list_filter([(eeg_stop_sample - eeg_start_sample) / eeg_sampling_rate_hz, eeg_sample_count / eeg_sampling_rate_hz,"
    " valid_eeg_samples / eeg_sampling_rate_hz, source_trial_eeg_duration_sec], lambda x : x > 0)) THEN 0.001 ELSE 1.0 END"
)
