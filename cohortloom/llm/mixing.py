"""Mixing sources to target weights (problem 8).

A classifier fitted on labelled documents gives every document posteriors over the sources (soft membership).
Projected-gradient least squares then finds document rates, between 0 and the cap of the source, whose expected token
totals per source match the targets; the totals of the documents that state a source must match them too, and where
both cannot be had, these come first. So the text says which documents of a source are taken, not how much the source
gives. Rates become whole repeats by systematic rounding within each source.

The text's posteriors are calibrated on held-out documents, by one temperature. A document's own source is evidence
too: how far it is trusted is counted on the same held-out documents, as the share that the text outvotes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from cohortloom.llm.features import features, sampled
from cohortloom.store import materialize

TOKENIZER = os.environ.get("COHORTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the split pattern of this public vocabulary's family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents that the classifier is fitted on, at most, by a hash of doc_id.
MOST_LABELLED = 4_000
#: Change of a pass, as a share of all tokens, below which the rates stand: of the joint fit and of the stated totals alone; and passes after which a fit that still moves is refused.
STILL, EXACT, MOST_PASSES = 1e-3, 1e-6, 400


def clean_source(c: Column) -> Column:
    """Lower case, outer spaces off, runs of other characters as one underscore; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s != "", s)


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text by a public tokenizer; 0 for null."""

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        e = _encoding(path)
        return pa.array([len(e.encode_ordinary(x)) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(text)


class Softmax:
    """Multinomial logistic regression by adaptive-moment gradient steps."""

    def __init__(self, w: np.ndarray, bias: np.ndarray):
        self.w, self.bias = w, bias

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 80, rate: float = 0.1, ridge: float = 1e-4) -> Softmax:
        w, bias = np.zeros((x.shape[1], k), np.float32), np.log((np.bincount(y, minlength=k) + 1) / (len(y) + k)).astype(np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        hot = np.eye(k, dtype=np.float32)[y]
        for t in range(1, steps + 1):
            p = Softmax(w, bias)(x)
            g = x.T @ (p - hot) / np.float32(len(y)) + np.float32(ridge) * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return Softmax(w, bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Membership:
    """Posteriors over the sources from text and own source.

    ``temperature`` divides the logits; it is the one with the least loss on documents that the model was not fitted
    on. ``trust[l, j]``: how probable source j is for a document that says l. Where the calibrated text gives another
    source more than half of the probability, it outvotes the label; the outvoted held-out documents of each label,
    with one agreeing document added to each, are counted.
    """

    def __init__(self, model: Softmax, temperature: float, trust: np.ndarray, report: dict[str, float]):
        self.model, self.temperature, self.trust, self.report = model, temperature, trust, report

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, k: int) -> Membership:
        """``y`` from 0. Without documents the posteriors are even and labels fully trusted."""
        if not len(y):
            return Membership(Softmax(np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)), 1.0, np.eye(k), {"n_labelled": 0, "accuracy": None, "log_loss": None, "calibration_error": None, "temperature": 1.0, "outvoted": 0.0})
        fold = np.arange(len(y)) % 2
        z = np.zeros((len(y), k))
        for f in (0, 1):
            z[fold == f] = Softmax.fit(x[fold != f], y[fold != f], k).logits(x[fold == f])
        at = np.arange(len(y))
        loss = lambda t: -np.log(np.maximum(1e-12, softmax(z / t)[at, y])).mean()
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
        t = float(grid[np.argmin([loss(g) for g in grid])])
        p = softmax(z / t)
        best, sure = p.argmax(1), p.max(1)
        against = (best != y) & (sure > 0.5)
        count = np.eye(k) + np.zeros((k, k))
        np.add.at(count, (y[~against], y[~against]), 1)
        np.add.at(count, (y[against], best[against]), 1)
        bins = np.minimum((sure * 10).astype(int), 9)
        off = sum(abs((best == y)[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
        report = {"n_labelled": len(y), "accuracy": float((best == y).mean()), "log_loss": float(loss(t)), "calibration_error": float(off), "temperature": t, "outvoted": float(against.mean())}
        return Membership(Softmax.fit(x, y, k), t, count / count.sum(1, keepdims=True), report)

    def __call__(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Posteriors of documents with features ``x`` and own source ``own`` from 1, 0 where it has none that is listed."""
        q = softmax(self.model.logits(x) / self.temperature)
        known = np.flatnonzero(own > 0)
        q[known] = np.maximum(q[known], 1e-12) * self.trust[own[known] - 1]
        return (q / q.sum(1, keepdims=True)).astype(np.float32)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), "text")


def _place(sources: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")).cast("int")


def membership(documents: DataFrame, sources: list[str]) -> Membership:
    """The classifier of ``sources``, fitted on MOST_LABELLED documents that name one of them."""
    docs = _documents(documents)
    x, y = sampled(docs.where(F.col("source").isin(*sources)).select("doc_id", _place(sources).alias("level")), docs, "doc_id", MOST_LABELLED, "level")
    return Membership.fit(x, y.astype(int) - 1, len(sources))


def members(documents: DataFrame, sources: list[str], model: Membership, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, y, tokens, m): own source and its number from 1 (0: none listed), tokens of the whole text and the posteriors over ``sources``, in their order."""
    k = len(sources)
    schema = "doc_id long, source string, y int, tokens long, m array<float>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cohortloom.llm.letters import steps

        for b in it:
            for first, texts in steps(b.column("text")):
                part = b.slice(first, len(texts))
                q = model(features(texts), np.asarray(part.column("y")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "source", "y", "tokens")], pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, k, dtype=np.int32)), pa.array(q.ravel()))], ["doc_id", "source", "y", "tokens", "m"])

    docs = _documents(documents)
    return docs.select("doc_id", "source", F.coalesce(_place(sources), F.lit(0)).alias("y"), F.coalesce(token_count(F.col("text"), path), F.lit(0)).alias("tokens"), "text").mapInArrow(run, schema)


def _rates(batch: pa.RecordBatch, caps: np.ndarray, history: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates after the steps of ``history``, posteriors, how each document counts in the stated totals).

    The steps are replayed: each is one of the expected totals, for every source, then one of the stated totals.
    """
    m = np.asarray(batch.column("m").flatten(), float).reshape(batch.num_rows, k)
    own = np.asarray(batch.column("y"))
    stated = np.where((own > 0)[:, None], np.eye(k)[np.maximum(own - 1, 0)], m)
    cap = stated @ caps
    r = np.minimum(1.0, cap)
    for step in history:
        r = np.clip(r + m @ step[:k] + stated @ step[k:], 0, cap)
    return r, m, stated


def _sources(targets: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Clean sources, shares and caps: one row a source."""
    rows = targets.where(F.col("source").isNotNull()).groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    return [r.source for r in rows], np.array([float(r.share) for r in rows]), np.array([float(r.cap) for r in rows])


def rates(held: DataFrame, share: np.ndarray, caps: np.ndarray) -> tuple[list[np.ndarray], dict[str, float]]:
    """Steps whose replay gives every document's rate, and how the fit ended: passes, and the residuals of expected and stated totals.

    Least squares in relative terms: the residual of a source is divided by the tokens it holds, and rates are scaled by
    tokens, so that a step is of the right length for every source. A pass sums two numbers per source; the rates are
    replayed from the steps and never stored. First both residuals are brought down, half a step for each; when a pass
    moves the totals by less than STILL, the stated totals alone, until a pass moves them by less than EXACT. What is
    then left of their residual is out of reach of the caps.
    """
    k = len(share)
    names = ("expected", "stated", "hold_e", "hold_s")
    schema = "tokens double, v array<double>"

    def sums(history):
        def run(it):
            v, total = np.zeros(4 * k), 0.0
            for b in it:
                r, m, own = _rates(b, caps, history, k)
                t = np.asarray(b.column("tokens"), float)
                v, total = v + np.concatenate([(r * t) @ m, (r * t) @ own, t @ m, t @ own]), total + t.sum()
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([total]), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

        r = held.mapInArrow(run, schema).agg(F.sum("tokens").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(4 * k)]).first()
        return (r.n or 0.0), dict(zip(names, np.array([r[f"v{i}"] or 0.0 for i in range(4 * k)]).reshape(4, k)))

    history: list[np.ndarray] = []
    joint, before = True, None
    while True:
        total, now = sums(history)
        missing = {n: share * total - now[n] for n in names[:2]}
        moved = np.inf if before is None else max(np.abs(now[n] - before[n]).sum() for n in names[:2]) / max(1.0, total)
        if joint and moved <= STILL:
            joint, moved = False, np.inf
        if not total or (not joint and (moved <= EXACT or np.abs(missing["stated"]).sum() <= EXACT * total)):
            break
        if len(history) >= MOST_PASSES:
            raise RuntimeError(f"the rates still move after {MOST_PASSES} passes")
        e, s = (missing[n] / np.maximum(now[h], 1e-9) for n, h in zip(names[:2], names[2:]))
        history.append(np.concatenate([0.5 * e, 0.5 * s] if joint else [0 * e, s]))
        before = now
    left = {f"residual_{n}": float(np.abs(missing[n]).sum() / total) if total else 0.0 for n in names[:2]}
    return history, {"passes": len(history) + 1} | left


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, rate, repeats) of every document.

    Each source is to give ``target_share`` of as many tokens as the corpus has, no document more than its own source's
    ``max_repeats`` times; where the cap makes a target unreachable, all its documents are at the cap and the actual
    share says so. Documents of no listed source count by their posteriors. Null and blank texts have 0 tokens.

    Rounding: within a source, in the order of token count, a document gets one repeat more where the running sum of
    fractions passes a whole number; running sums are taken within ranges of bounded size whose totals are summed before.
    """
    spark = documents.sparkSession
    sources, share, caps = _sources(targets)
    k = len(sources)
    if not k:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, rate double, repeats int")
    held = materialize(members(documents, sources, membership(documents, sources), path))
    history, _ = rates(held, share, caps)

    def final(it):
        for b in it:
            r, _, _ = _rates(b, caps, history, k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("tokens"), b.column("y"), pa.array(r)], ["doc_id", "source", "tokens", "y", "rate"])

    rated = held.mapInArrow(final, "doc_id long, source string, tokens long, y int, rate double")
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = rated.withColumn("size", F.floor(F.log2(F.col("tokens") + 1) * 8).cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    rated = materialize(rated)
    parts = rated.groupBy("y", "size", "cell").agg(F.sum("part").alias("sum"))  # sources times sizes times cells, whatever the rows
    before = parts.select("y", "size", "cell", (F.sum("sum").over(Window.partitionBy("y").orderBy("size", "cell")) - F.col("sum")).alias("before"))
    run = rated.join(before, ["y", "size", "cell"])
    upto = F.col("before") + F.sum("part").over(Window.partitionBy("y", "size", "cell").orderBy("tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.floor(upto + 0.5) - F.floor(upto - F.col("part") + 0.5)
    return run.select("doc_id", "source", "tokens", "rate", (F.col("whole") + extra).cast("int").alias("repeats"))


def fitted(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row: how good the soft membership is on held-out documents, how often the text outvotes the label, and how the rates ended."""
    spark = documents.sparkSession
    schema = "n_labelled long, accuracy double, log_loss double, calibration_error double, temperature double, outvoted double, passes int, residual_expected double, residual_stated double"
    sources, share, caps = _sources(targets)
    if not sources:
        return spark.createDataFrame([], schema)
    model = membership(documents, sources)
    _, end = rates(materialize(members(documents, sources, model, path)), share, caps)
    r = model.report | end
    return spark.createDataFrame([tuple(r[n.split()[0]] for n in schema.split(", "))], schema)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_documents, most_repeats) of each source of the mix or of the targets."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count_if(F.col("repeats") > 0).alias("n_documents"), F.max("repeats").alias("most_repeats"), F.sum("tokens").alias("held"))
    total = mixed.agg(F.sum("tokens").alias("total"))
    want = targets.select(clean_source(F.col("source")).alias("source"), "target_share")
    out = want.join(got, "source", "full").join(F.broadcast(total))  # one row
    return out.select("source", "target_share", F.try_divide(F.coalesce("tokens", F.lit(0)).cast("double"), "total").alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "most_repeats")
