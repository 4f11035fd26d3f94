"""Reading levels (problem 9): a linear pairwise ranker, calibrated into levels with isotonic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.features import sampled, scored

#: Labelled documents and pairs of them that the ranker is fitted on, at most; the sample is by a hash of doc_id.
MOST_LABELLED, MOST_PAIRS = 5_000, 200_000
FOLDS = 4
LEVELS = (1, 5)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, level): mean rating of each rated document; null ratings don't count."""
    return labels.where(F.col("level").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("level").alias("level"))


def _rank(x: np.ndarray, level: np.ndarray, seed: int, steps: int = 300, ridge: float = 3e-5, rate: float = 0.05) -> np.ndarray:
    """Weights of the logistic loss on graded pairs, by adaptive-moment gradient steps; pairs weigh as their levels differ."""
    rng = np.random.default_rng(seed)
    n = len(level)
    a, b = rng.integers(0, n, MOST_PAIRS), rng.integers(0, n, MOST_PAIRS)
    gap = level[a] - level[b]
    a, b = np.where(gap > 0, a, b)[gap != 0], np.where(gap > 0, b, a)[gap != 0]
    weight = np.abs(gap[gap != 0])
    weight = weight / max(1e-9, weight.sum())
    weight = weight.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        s = x @ w
        pull = weight / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        g = (np.bincount(b, pull, n) - np.bincount(a, pull, n)).astype(np.float32) @ x + np.float32(ridge) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, value) of the non-decreasing least-squares fit; equal scores are one point."""
    s, where = np.unique(score, return_inverse=True)
    mass = np.bincount(where).astype(float)
    mean = np.bincount(where, level) / mass
    blocks: list[list[float]] = []
    for x, y, k in zip(s, mean, mass):
        blocks.append([x, x, y, k])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, hi, y1, k1 = blocks.pop()
            lo, _, y0, k0 = blocks.pop()
            blocks.append([lo, hi, (y0 * k0 + y1 * k1) / (k0 + k1), k0 + k1])
    return np.array([p for b in blocks for p in (b[0], b[1])]), np.array([b[2] for b in blocks for _ in (0, 1)])


class Reader:
    """Weights and calibration; fitted on the driver from a bounded sample of labelled rows."""

    def __init__(self, w: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.w, self.knots, self.values = w, knots, values

    @staticmethod
    def fit(x: np.ndarray, level: np.ndarray) -> Reader:
        """Folds are scored by the ranker of the others, so that calibration sees scores as new documents get them."""
        fold = np.arange(len(level)) % FOLDS
        out, w = np.zeros(len(level)), np.zeros(x.shape[1])
        for k in range(FOLDS):
            own = _rank(x[fold != k], level[fold != k], k)
            s = x @ own
            own = own / max(1e-9, s.std())
            out[fold == k] = x[fold == k] @ own - np.mean(x @ own)
            w += own / FOLDS
        centre = np.mean(x @ w)
        knots, values = isotonic(out, level)
        return Reader(w, knots + centre, values)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.w
        return np.stack([s, np.clip(np.interp(s, self.knots, self.values), *LEVELS)], 1)


def fit(documents: DataFrame, labels: DataFrame) -> Reader | None:
    """None where fewer than two levels are rated."""
    x, level = sampled(graded(labels), documents, "doc_id", MOST_LABELLED, "level")
    if len(set(level.tolist())) < 2:
        return None
    return Reader.fit(x, level)


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, grade, level): every document's rank score, calibrated grade and level 1 to 5.

    Null and blank texts get no level (null score, grade and level); without two rated levels nothing has one.
    Ties in score get the same grade. Documents are scored where they lie, without a shuffle.
    """
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")
    none = F.lit(None).cast("double")
    model = fit(documents, labels)
    if model is None:
        return documents.select("doc_id", none.alias("score"), none.alias("grade"), none.cast("int").alias("level"))
    known = scored(documents.where(~blank), "doc_id", model, ["score", "grade"])
    out = known.unionByName(documents.where(blank).select("doc_id", none.alias("score"), none.alias("grade")))
    return out.withColumn("level", F.floor(F.col("grade") + 0.5).cast("int"))
