"""Marker pairing over an unbounded stream: keyed state, event-time watermark, timeout flush of open starts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream string, start_sample long, end_sample long, pair_index long, context string, kind string"
STATE = "pending long, context string, pairs long"
CONTEXT = re.compile(r"^CH\s*0*[0-9]+$", re.IGNORECASE)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, start: str, end: str) -> Iterator[pd.DataFrame]:
    pending, context, pairs = state.get if state.exists else (-1, None, 0)
    out = []
    if state.hasTimedOut:
        if pending >= 0:
            out.append((key[0], pending, None, None, context, "orphan_start"))
        state.remove()
    else:
        rows = pd.concat(list(batches))
        for sample, kind in rows.sort_values(["sample", "kind"], kind="stable")[["sample", "kind"]].itertuples(index=False):
            if CONTEXT.match(kind):
                context = kind
            elif kind == start:
                if pending >= 0:
                    out.append((key[0], pending, None, None, context, "orphan_start"))
                pending = int(sample)
            elif kind == end:
                if pending >= 0 and sample > pending:
                    out.append((key[0], pending, int(sample), pairs, context, "pair"))
                    pairs += 1
                else:
                    if pending >= 0:
                        out.append((key[0], pending, None, None, context, "orphan_start"))
                    out.append((key[0], None, int(sample), None, context, "orphan_end"))
                pending = -1
        state.update((pending, context, pairs))
        if state._timeout_conf == GroupStateTimeout.EventTimeTimeout and not state.hasTimedOut:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["at"].max().timestamp() * 1000) + 60_000))
    if out:
        yield pd.DataFrame(out, columns=["stream", "start_sample", "end_sample", "pair_index", "context", "kind"]).astype({"start_sample": "Int64", "end_sample": "Int64", "pair_index": "Int64"})


def pair_stream(markers: DataFrame, stream: str, sample: str, kind: str, at: str, delay: str = "1 minute", start: str = "ROWS", end: str = "ROWE") -> DataFrame:
    """Pairs and orphans of a streaming DataFrame of markers, in order of arrival per micro-batch and sample within it.

    State per stream is one open start, the last context and a count. A stream that is silent past the watermark is
    flushed: its open start comes out as an orphan.
    """
    rows = markers.where(F.col(stream).isNotNull() & F.col(sample).isNotNull() & F.col(kind).isNotNull())
    rows = rows.select(F.col(stream).alias("stream"), F.col(sample).cast("long").alias("sample"), F.trim(kind).alias("kind"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", delay)

    def run(key, batches, state):
        yield from _step(key, batches, state, start, end)

    return rows.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(events: DataFrame, at: str, kind: str, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts per kind with a watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, delay).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"))
