"""Column-level quality profile: exact base aggregates, contract violations and changes between loads.

Changes between loads come from a classifier two-sample test: a logistic regression is trained, distributed, to tell
two successive loads apart. Its cross-fitted discrimination (area under the ROC curve on rows it was not fitted on)
says how much the loads differ, and the loss of discrimination without a column says which column differs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.readable import readable
from cohortloom.store import materialize

# Fixed values of the flag contract, beside `ok`.
FLAGS = (
    "unresolved_text_alignment", "missing_text", "event_text_count_mismatch", "orphan_row_event_in_recording", "missing_events_tsv",
    "events_vmrk_count_mismatch", "broken_brainvision_reference", "invalid_brainvision_binary", "implausible_eeg_trial_duration",
    "prechapter_trial_unresolved", "low_text_alignment_score", "material_variant_uncertain", "ra_audio_boundary_unavailable",
    "pl_audio_mapping_unverified", "audio_events_missing", "audio_file_count_mismatch", "audio_boundary_out_of_range",
)
OK = "ok"
DURATION_TOLERANCE = 1e-6


def _number(c: Column) -> Column:
    """Not null, not NaN, finite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def contract_checks_names() -> tuple[str, ...]:
    """The columns under contract, in order."""
    return ("audio_start_sec", "eeg_duration_sec", "quality_flag", "raw_text")


def contract_checks() -> dict[str, Column]:
    """For each column under contract, when its value breaks it. Needs ``_audio_sec``, the length of the audio file.

    A null or unknown operand never satisfies a contract; the audio start may be null exactly where the end is.
    """
    start, end, length = F.col("audio_start_sec"), F.col("audio_end_sec"), F.col("_audio_sec")
    placed = _number(start) & (start >= 0) & (F.isnan(end) | (start < end)) & F.coalesce(start < length, F.lit(False))
    expected = F.try_divide((F.col("eeg_end_sample") - F.col("eeg_start_sample")).cast("double"), F.col("eeg_sampling_rate"))
    flags = F.split("quality_flag", r"\|", -1)
    known = F.forall(flags, lambda x: x.isin(*FLAGS))
    ordered = F.array_join(F.array_sort(F.array_distinct(flags)), "|") == F.col("quality_flag")
    return {
        "audio_start_sec": (start.isNull() != end.isNull()) | (start.isNotNull() & ~F.coalesce(placed, F.lit(False))),
        "eeg_duration_sec": ~F.coalesce(_number(F.col("eeg_duration_sec")) & (F.abs(F.col("eeg_duration_sec") - expected) <= DURATION_TOLERANCE), F.lit(False)),
        "quality_flag": ~F.coalesce((F.col("quality_flag") == OK) | (known & ordered), F.lit(False)),
        "raw_text": F.col("raw_text").isNotNull() & ~readable(F.col("raw_text")),
    }


def with_audio_length(manifest: DataFrame, audio_files: DataFrame) -> DataFrame:
    """Adds ``_audio_sec``. Rows without an audio file, the bulk, get spread keys, so that a shuffled join has no hot null."""
    length = audio_files.where(F.col("audio_file").isNotNull()).groupBy(F.col("audio_file").alias("_audio_key")).agg(
        F.max(F.try_divide(F.col("frame_count").cast("double"), F.col("sample_rate_hz"))).alias("_audio_sec")
    )
    key = F.coalesce("audio_file", F.concat(F.lit("\0"), F.pmod(F.xxhash64("row_id"), F.lit(997)).cast("string")))
    return manifest.withColumn("_audio_key", key).join(length, "_audio_key", "left").drop("_audio_key")


BROKEN = "_broken"


def contracted(manifest: DataFrame, audio_files: DataFrame) -> DataFrame:
    """The table with ``_broken``, the names of the columns whose contract the row breaks; nothing is joined back by row later."""
    df = with_audio_length(manifest, audio_files)
    return df.withColumn(BROKEN, F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in contract_checks().items()]))).drop("_audio_sec")


def violations(manifest: DataFrame, audio_files: DataFrame) -> DataFrame:
    """(row_id, column_name) for each cell that breaks its column's contract; distinct.

    Repeated rows give one pair; an empty table gives none; other columns of the inputs are not read.
    """
    need = ["row_id", "audio_file", "audio_start_sec", "audio_end_sec", "eeg_start_sample", "eeg_end_sample", "eeg_sampling_rate", "eeg_duration_sec", "quality_flag", "raw_text"]
    cells = contracted(manifest.select(*need), audio_files).where(F.size(BROKEN) > 0)
    return cells.select("row_id", F.explode(BROKEN).alias("column_name")).distinct()


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "timestamp", "timestamp_ntz", "date") or kind.startswith("decimal")


def _as_number(c: str, kind: str) -> Column:
    """A double: of times the seconds since 1970, of booleans 0 or 1; NaN is null."""
    if kind in ("float", "double"):
        return F.when(~F.isnan(c), F.col(c).cast("double"))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return F.col(c).cast("double")


def profile(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """One row per column and load: rows, nulls, null_rate, distinct_count, range, violations.

    Counts are exact. The range is in ``min_number`` and ``max_number`` for numbers, booleans and times, in ``min_text``
    and ``max_text`` for all else; NaN is outside the range but a distinct value. ``load`` may hold nulls, which form a
    load of their own. Where ``df`` has the marks of ``contracted``, they are counted in the same pass. Two passes: one
    wide aggregate with map-side combine, and one over (load, column, value) triples for the distinct counts, where equal
    values meet before the shuffle.
    """
    columns = columns or [c for c in df.columns if c not in (load, BROKEN)]
    kinds = dict(df.dtypes)
    none = F.lit(None)
    marked = contract_checks_names() if BROKEN in df.columns else ()
    bad = lambda c: F.count_if(F.array_contains(BROKEN, c)) if c in marked else F.sum(F.lit(0).cast("long"))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        v = _as_number(c, kinds[c]) if _is_number(kinds[c]) else _text(c)
        aggs += [F.count(c).alias(f"_c{i}"), F.min(v).alias(f"_a{i}"), F.max(v).alias(f"_z{i}"), bad(c).alias(f"_b{i}")]
    wide = df.groupBy(F.col(load).alias("load")).agg(*aggs)

    def entry(i, c):
        number = _is_number(kinds[c])
        a, z = F.col(f"_a{i}"), F.col(f"_z{i}")
        ranges = [(a if number else none).cast("double").alias("min_number"), (z if number else none).cast("double").alias("max_number"), (none if number else a).cast("string").alias("min_text"), (none if number else z).cast("string").alias("max_text")]
        return F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("n"), *ranges, F.col(f"_b{i}").alias("n_violations"))

    base = wide.select("load", F.col("_n").alias("n_rows"), F.explode(F.array(*[entry(i, c) for i, c in enumerate(columns)])).alias("x"))
    base = base.select("load", "x.column_name", "n_rows", (F.col("n_rows") - F.col("x.n")).alias("n_null"), "x.min_number", "x.max_number", "x.min_text", "x.max_text", "x.n_violations")
    cells = df.select(F.col(load).alias("load"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _text(c).alias("v")) for c in columns])).alias("x")).select("load", "x.*")
    distinct = cells.where(F.col("v").isNotNull()).groupBy("load", "column_name", "v").agg(F.lit(1).alias("one")).groupBy("load", "column_name").agg(F.count("one").alias("distinct_count"))
    same = base["load"].eqNullSafe(distinct["load"]) & (base["column_name"] == distinct["column_name"])
    out = base.join(distinct, same, "left").select(base["*"], F.coalesce(distinct["distinct_count"], F.lit(0)).alias("distinct_count"))
    return out.withColumn("null_rate", F.round(F.col("n_null") / F.col("n_rows"), 9))


def with_drift(profiled: DataFrame, changes: DataFrame) -> DataFrame:
    """The profile with what the classifier two-sample test says of each load against the one before.

    ``load_auc``: how well the loads are told apart by all columns; ``drift_loss``: how much of that goes without the
    column. Null for the first load, a null load and columns that are no features.
    """
    c = changes.where(F.col("column_name").isNotNull()).select(F.col("load_after").alias("_load"), F.col("column_name").alias("_column"), F.col("auc").alias("load_auc"), F.col("loss").alias("drift_loss"))
    on = (profiled["load"].cast("long") == c["_load"]) & (profiled["column_name"] == c["_column"])
    return profiled.join(F.broadcast(c), on, "left").drop("_load", "_column")  # loads times columns


# ---------------------------------------------------------------- classifier two-sample test

#: Features of a column: null mark, signed magnitude, magnitude, its square, broken contract, and nearness by the hash of the value.
PLAIN, PER_COLUMN = 5, 6
BITS = 64
BINS = 4096
ROWS = 2048  # worked on at once
#: Pairs of loads that one fit holds in memory, whatever the number of loads.
PAIRS = 8
#: Passes of the refit without a column, and gain in log likelihood over all rows below which a step is the last.
REFITS, STILL = 2, 0.05


def _kinds(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Columns of whole numbers and times, of fractions, and of all else."""
    kinds = dict(df.dtypes)
    whole = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "boolean", "timestamp", "timestamp_ntz", "date")]
    parts = [c for c in columns if kinds[c] in ("float", "double")]
    return whole, parts, [c for c in columns if c not in whole and c not in parts]


def _featured(df: DataFrame, load: str, key: str, columns: list[str]) -> DataFrame:
    """(load order value, fold, w, p, t, l, broken): whole numbers, fractions, hashes and lengths of texts, as arrays with nulls; bits of the broken contracts.

    One short expression for all texts and plain arrays of numbers, so that the generated code stays small; hashes of numbers are made in the tasks.
    """
    kinds = dict(df.dtypes)
    whole, parts, texts = _kinds(df, columns)
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("long")
    array = lambda cols, kind: F.array(*cols).cast(f"array<{kind}>")
    words = array([_text(c) for c in texts], "string")
    bits = F.lit(0).cast("long")
    if BROKEN in df.columns:
        for i, c in enumerate(c for c in contract_checks_names() if c in columns):
            bits = bits.bitwiseOR(F.when(F.array_contains(BROKEN, c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.select(
        F.col(load).cast("long").alias("load"), F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(2)).cast("int").alias("fold"),
        array([number(c) for c in whole], "long").alias("w"), array([F.col(c).cast("double") for c in parts], "double").alias("p"),
        F.transform(words, lambda x, i: F.when(x.isNotNull(), F.xxhash64(i, x))).alias("t"), F.transform(words, lambda x: F.length(x)).alias("l"), bits.alias("broken"),
    )


def _mixed(bits: np.ndarray, column: np.ndarray) -> np.ndarray:
    """64-bit hashes of numbers, another one in each column."""
    with np.errstate(over="ignore"):
        x = bits.view(np.uint64) + (column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _batches(it: Iterator[pa.RecordBatch], layout: tuple[list[int], list[int], list[int], list[int]]):
    """(loads, folds, plain features [row, column, PLAIN], bytes of the hashes [row, column, 8]); ``layout``: places of whole numbers, fractions, texts and contract columns. A null has hash 0."""
    whole, parts, texts, under = layout
    n = len(whole) + len(parts) + len(texts)

    def grid(column: pa.Array, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        there = ~np.asarray(flat.is_null()).reshape(-1, width)
        return np.asarray(flat.fill_null(0), kind).reshape(-1, width), there

    for all_rows in it:
        for i in range(0, all_rows.num_rows, ROWS):
            b = all_rows.slice(i, ROWS)
            v, h, there = np.zeros((b.num_rows, n)), np.zeros((b.num_rows, n), np.int64), np.zeros((b.num_rows, n), bool)
            if whole:
                x, there[:, whole] = grid(b.column("w"), len(whole), "<i8")
                v[:, whole], h[:, whole] = x, _mixed(np.ascontiguousarray(x), np.array(whole)[None, :])
            if parts:
                x, there[:, parts] = grid(b.column("p"), len(parts), "<f8")
                v[:, parts], h[:, parts] = x, _mixed(np.ascontiguousarray(x + 0.0), np.array(parts)[None, :])
            if texts:
                h[:, texts], there[:, texts] = grid(b.column("t"), len(texts), "<i8")
                v[:, texts] = grid(b.column("l"), len(texts), "<i8")[0]
            h *= there
            v = np.where(there & np.isfinite(v), v, 0)
            f = np.zeros((b.num_rows, n, PLAIN))
            size = np.log1p(np.abs(v))
            f[:, :, 0], f[:, :, 1], f[:, :, 2], f[:, :, 3] = ~there, np.sign(v) * size, size, size * size
            for bit, j in enumerate(under):
                f[:, j, 4] = np.asarray(b.column("broken")) >> bit & 1
            yield np.asarray(b.column("load")), np.asarray(b.column("fold")), f, h.view(np.uint8).reshape(b.num_rows, n, 8)


def _tables(means: np.ndarray) -> np.ndarray:
    """[.., column, byte, value]: what each byte of a hash adds to the inner product of its signs with ``means`` [.., column, bit]."""
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1
    return (means.reshape(*means.shape[:-1], 8, 8) @ signs.T).astype(np.float32)


VECTOR = "pair int, fold int, part int, v binary"


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), float) for v in rows.column("v"))
    first = rows.slice(0, 1)
    return pa.table({"pair": first.column("pair"), "fold": first.column("fold"), "part": pa.array([0], pa.int32()), "v": pa.array([total.tobytes()])})


def _summed(df: DataFrame, partial) -> dict[tuple[int, int], np.ndarray]:
    """Sums of per-partition vectors keyed (pair, fold), added in two levels; as long as loads and features make them, whatever the rows."""
    parts = df.mapInArrow(partial, VECTOR)
    some = parts.groupBy("pair", "fold", "part").applyInArrow(_add, VECTOR)
    rows = some.groupBy("pair", "fold").applyInArrow(_add, VECTOR).collect()
    return {(r.pair, r.fold): np.frombuffer(r.v, float) for r in rows}


def _emit(acc: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 32
    for (p, k), v in acc.items():
        yield pa.RecordBatch.from_pydict({"pair": pa.array([p], pa.int32()), "fold": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "v": pa.array([np.ravel(v).tobytes()])})


DRIFT = "load_before long, load_after long, column_name string, auc double, auc_without double, loss double"


def drift(df: DataFrame, load: str, key: str, columns: list[str], steps: int = 6, ridge: float = 1.0) -> DataFrame:
    """Changes between successive values of ``load``: (load_before, load_after, column_name, auc, auc_without, loss).

    ``column_name`` null is the whole model. Two folds by a hash of ``key``: each half is scored by the model fitted on
    the other half. 0.5 means that the loads cannot be told apart. ``auc_without`` is that of the model refitted without
    the column's features: begun at the minimum of the fitted model's quadratic expansion under that constraint, then
    moved by the exact gradient over all rows.
    A column has six features: null mark, squashed magnitude (of text its length) with its sign, without, and squared,
    broken contract (where ``df`` has the marks of ``contracted``), and how much nearer the value is to the later load's
    values than to the earlier's: the inner product of the 64 signs of its hash with the change of their means between the
    loads. The means are of the fitting half, each of its rows left out of its own mean. Values that differ share no
    feature unless all 64 bits agree, so a swap of two values of one length shows.
    Fitting is Newton's method; one pass over the rows per step sums gradient and Hessian of PAIRS pairs of loads at
    most, so that memory doesn't grow with the number of loads. Rows with a null load are left out; with fewer than two
    loads the result is empty. Ties in score count half.
    """
    spark = df.sparkSession
    loads = [r[0] for r in df.where(F.col(load).isNotNull()).select(F.col(load).cast("long")).distinct().orderBy(load).collect()]
    if len(loads) < 2:
        return spark.createDataFrame([], DRIFT)
    feats = materialize(_featured(df.where(F.col(load).isNotNull()), load, key, columns))  # each pass reads it again
    layout = tuple([columns.index(c) for c in kind] for kind in (*_kinds(df, columns), [c for c in contract_checks_names() if c in columns]))
    out = []
    for i in range(0, len(loads) - 1, PAIRS):
        some = loads[i : i + PAIRS + 1]
        out += _drift(feats.where(F.col("load").between(some[0], some[-1])) if len(some) < len(loads) else feats, some, columns, layout, steps, ridge)
    return spark.createDataFrame(out, DRIFT)


def _drift(feats: DataFrame, loads: list[int], columns: list[str], layout: tuple, steps: int, ridge: float) -> list[tuple]:
    """Rows of ``drift`` for the successive pairs of ``loads``."""
    pairs = list(zip(loads, loads[1:]))
    n_columns = len(columns)
    width = PLAIN * n_columns
    d = 1 + PER_COLUMN * n_columns

    def moments(it):
        acc: dict = {}
        for y, fold, x, h in _batches(it, layout):
            for i, a in enumerate(loads):
                for k in (0, 1):
                    at = (y == a) & (fold == k)
                    if at.any():
                        z = x[at].reshape(-1, width)
                        bits = np.unpackbits(h[at].reshape(len(z), -1), axis=1, bitorder="little").sum(0, dtype=float).reshape(n_columns, BITS)
                        signs = 2 * bits - (1 - x[at][:, :, 0]).sum(0)[:, None]  # a null has no bit set and counts 0
                        acc[i, k] = acc.get((i, k), 0) + np.concatenate([[len(z)], z.sum(0), (z * z).sum(0), signs.ravel()])
        yield from _emit(acc)

    sums = _summed(feats, moments)
    m = sum(sums.values())
    mean = m[1 : 1 + width] / m[0]
    sd = np.sqrt(np.maximum(m[1 + width : 1 + 2 * width] / m[0] - mean**2, 0))
    scale = np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0)
    mean, scale = mean.reshape(n_columns, PLAIN), scale.reshape(n_columns, PLAIN)
    rows = np.array([[sums[i, k][0] if (i, k) in sums else 0 for k in (0, 1)] for i in range(len(loads))])
    signs = np.array([[sums[i, k][1 + 2 * width :].reshape(n_columns, BITS) / rows[i, k] if (i, k) in sums else np.zeros((n_columns, BITS)) for k in (0, 1)] for i in range(len(loads))])
    change = signs[1:] - signs[:-1]  # [pair, fold, column, bit]
    middle = (change * (signs[1:] + signs[:-1]) / 2).sum(-1)
    size = np.sqrt((change**2).sum(-1))
    unit = np.where(size > 1e-9, 1 / np.maximum(size, 1e-9), 0)
    w = {(p, k): np.zeros(d) for p in range(len(pairs)) for k in (0, 1)}
    hess = {}

    def design(x, h, after, p, fitted, tables):
        """Features of rows of pair ``p`` by the sign means of fold ``fitted[0]``; if ``fitted[1]``, each row is left out of its own mean."""
        f, own = fitted
        there = 1 - x[:, :, 0]
        at = (np.arange(n_columns)[None, :, None], np.arange(8)[None, None, :], h)
        g = [tables[p + i, f][at].sum(2) * there for i in (0, 1)]
        if own:
            for i in (0, 1):
                n = rows[p + i, f]
                g[i] = np.where((after == i)[:, None], (n * g[i] - BITS * there) / (n - 1) if n > 1 else 0, g[i])
        z = np.empty((len(x), n_columns, PER_COLUMN))
        z[:, :, :PLAIN] = (x - mean) * scale
        z[:, :, PLAIN] = (g[1] - g[0] - middle[p, f]) * unit[p, f]
        return np.hstack([np.ones((len(x), 1)), np.clip(z, -5, 5).reshape(len(x), -1)]).astype(np.float32)  # summed in double precision over batches

    for _ in range(steps):

        def newton(it, w=w):
            acc: dict = {}
            tables = _tables(signs)
            for y, fold, x, h in _batches(it, layout):
                for p, (a, b) in enumerate(pairs):
                    for k in (0, 1):
                        at = ((y == a) | (y == b)) & (fold != k)  # fitted on the other fold
                        if at.any():
                            t = (y[at] == b).astype(np.float32)
                            z = design(x[at], h[at], t, p, (1 - k, True), tables)
                            q = 1 / (1 + np.exp(-np.clip(z @ w[p, k].astype(np.float32), -30, 30)))
                            v = np.concatenate([z.T @ (t - q), ((z * (q * (1 - q))[:, None]).T @ z).ravel()]).astype(float)
                            acc[p, k] = acc.get((p, k), 0) + v
            yield from _emit(acc)

        moved = 0.0
        for at, v in _summed(feats, newton).items():
            h = v[d:].reshape(d, d) + ridge * np.eye(d)
            hess[at] = h
            move = np.linalg.solve(h, v[:d] - ridge * w[at])
            w[at] = w[at] + move
            moved = max(moved, float(move @ h @ move) / 2)
        if moved < STILL:
            break
    models = {}
    for at, h in hess.items():
        inv = np.linalg.inv(h)
        each = [w[at]]
        for j in range(len(columns)):
            c = slice(1 + PER_COLUMN * j, 1 + PER_COLUMN * (j + 1))
            each.append(w[at] - inv[:, c] @ np.linalg.solve(inv[c, c], w[at][c]))
        models[at] = np.array(each)
    keep = np.ones((n_columns + 1, d), bool)  # the coefficients that each model has
    for j in range(n_columns):
        keep[j + 1, 1 + PER_COLUMN * j : 1 + PER_COLUMN * (j + 1)] = False
    for _ in range(REFITS):

        def gradient(it):
            acc: dict = {}
            tables = _tables(signs)
            for y, fold, x, h in _batches(it, layout):
                for p, (a, b) in enumerate(pairs):
                    for k in (0, 1):
                        at = ((y == a) | (y == b)) & (fold != k)
                        if at.any() and (p, k) in models:
                            t = (y[at] == b).astype(np.float32)
                            z = design(x[at], h[at], t, p, (1 - k, True), tables)
                            q = 1 / (1 + np.exp(-np.clip(z @ models[p, k].T.astype(np.float32), -30, 30)))
                            acc[p, k] = acc.get((p, k), 0) + ((t[:, None] - q).T @ z).ravel().astype(float)
            yield from _emit(acc)

        for at, g in _summed(feats, gradient).items():
            g = g.reshape(-1, d) - ridge * models[at]
            inv = np.linalg.inv(hess[at])
            for j in range(n_columns):
                c = ~keep[j + 1]
                move = inv @ np.where(c, 0, g[j + 1])
                models[at][j + 1] += move - inv[:, c] @ np.linalg.solve(inv[np.ix_(c, c)], move[c])  # within the constraint
            models[at] = np.where(keep, models[at], 0)

    def scored(it):
        acc: dict = {}
        tables = _tables(signs)
        for y, fold, x, h in _batches(it, layout):
            for p, (a, b) in enumerate(pairs):
                for k in (0, 1):
                    at = ((y == a) | (y == b)) & (fold == k)
                    if at.any() and (p, k) in models:
                        z = design(x[at], h[at], y[at] == b, p, (1 - k, False), tables)
                        s = 1 / (1 + np.exp(-np.clip(z @ models[p, k].T.astype(np.float32), -30, 30)))
                        i = np.minimum((s * BINS).astype(int), BINS - 1) + (np.arange(s.shape[1]) * 2 + 0)[None, :] * BINS + ((y[at] == b) * BINS)[:, None]
                        acc[p, k] = acc.get((p, k), 0) + np.bincount(i.ravel(), minlength=2 * BINS * s.shape[1]).astype(float)
        yield from _emit(acc)

    def auc(h):
        neg, pos = h
        total = neg.sum() * pos.sum()
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / total) if total else None

    sums = _summed(feats, scored)
    out = []
    for p, (a, b) in enumerate(pairs):
        folds = [sums[p, k].reshape(-1, 2, BINS) for k in (0, 1) if (p, k) in sums]
        values = [[auc(f[j]) for f in folds] for j in range(len(columns) + 1)]
        means = [float(np.mean([x for x in v if x is not None])) if any(x is not None for x in v) else None for v in values]
        for j, v in enumerate(means):
            name = columns[j - 1] if j else None
            loss = None if v is None or not j else means[0] - v
            out.append((a, b, name, means[0], v if j else None, loss))
    return out


def contract_columns(schema: Mapping[str, str] | T.StructType) -> list[str]:
    """The columns that describe the data rather than its delivery: all but row_id, load_no, recorded_at and loaded_at."""
    names = schema.names if isinstance(schema, T.StructType) else list(schema)
    return [c for c in names if c not in ("row_id", "load_no", "recorded_at", "loaded_at")]
