"""Vector retrieval: similarities, ranks with stated tie policies, candidate pools, metrics and shortcut baselines.

Candidates are a stated set that every query is scored against, in blocks: the candidate side is split into blocks of
a bounded number of vectors, each query block meets each candidate block in one task as two matrices, and only what a
rank needs leaves the task: counts of candidates above and level with the positive, which add up over blocks. No pair
of query and candidate is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import quantiles
from cohortloom.operators.joins import null_safe_join

EPS = 1e-8
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, kind: str = "none") -> Column:
    """Inner product of flattened sequences, divided by the norm of x, y or both, norms clamped from below."""
    s = dot(a, b)
    if "x" in kind:
        s = s / F.greatest(norm(a), F.lit(EPS))
    if "y" in kind:
        s = s / F.greatest(norm(b), F.lit(EPS))
    return s


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    col = rows.column(column).combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _normed(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), EPS)


def rank_parts(queries: DataFrame, candidates: DataFrame, kind: str = "y", block: int = BLOCK, score=None, digits: int = 9) -> DataFrame:
    """(query_id, above, level, n): candidates above and level with each query's positive, the positive included in ``level``.

    ``queries``: query_id, vector, positive (a candidate_id); ``candidates``: candidate_id, vector; ids distinct. The
    positive's score comes from its own vector, joined by id, so every block can count by itself. Scores are rounded
    to ``digits`` so that blocks agree on ties. Queries without their positive among the candidates are left out.
    """
    n_q = F.pmod(F.xxhash64("query_id"), F.lit(block_count(queries, block)))
    n_c = block_count(candidates, block)
    own = candidates.select(F.col("candidate_id").alias("positive"), F.col("vector").alias("own"))
    q = queries.join(own, "positive").withColumn("qb", n_q).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("candidate_id"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(block_count(queries, block) - 1).cast("bigint"))))

    def count(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a.column("query_id").slice(0, 0), "above": pa.array([], pa.int64()), "level": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y, p = _matrix(a, "vector"), _matrix(b, "vector"), _matrix(a, "own")
        if "x" in kind:
            x = _normed(x)
        if "y" in kind:
            y, p = _normed(y), _normed(p)
        s, own_score = np.round(x @ y.T, digits), np.round((x * p).sum(1), digits)[:, None]
        return pa.table({"query_id": a.column("query_id"), "above": pa.array((s > own_score).sum(1)), "level": pa.array((s == own_score).sum(1)), "n": pa.array(np.full(len(x), len(y)))})

    kind_of = queries.schema["query_id"].dataType.simpleString()
    parts = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(count, f"query_id {kind_of}, above long, level long, n long")
    return parts.groupBy("query_id").agg(F.sum("above").alias("above"), F.sum("level").alias("level"), F.sum("n").alias("n"))


def log_sum_exp(queries: DataFrame, candidates: DataFrame, kind: str = "y", temperature: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, lse): log of the sum over all candidates of exp(score / temperature), summed per block below the block's largest score.

    ``queries``: query_id, vector; ``candidates``: candidate_id, vector; ids distinct. Without candidates there is no row.
    """
    n_q, n_c = block_count(queries, block), block_count(candidates, block)
    q = queries.select("query_id", "vector").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("candidate_id"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))

    def add(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a.column("query_id").slice(0, 0), "top": pa.array([], pa.float64()), "total": pa.array([], pa.float64())})
        x, y = _matrix(a, "vector"), _matrix(b, "vector")
        if "x" in kind:
            x = _normed(x)
        if "y" in kind:
            y = _normed(y)
        s = x @ y.T / temperature
        top = s.max(1)
        return pa.table({"query_id": a.column("query_id"), "top": pa.array(top), "total": pa.array(np.exp(s - top[:, None]).sum(1))})

    kind_of = queries.schema["query_id"].dataType.simpleString()
    parts = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(add, f"query_id {kind_of}, top double, total double")
    most = parts.groupBy("query_id").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("parts"))  # one part a block
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["top"] - F.col("top")))
    return most.select("query_id", (F.col("top") + F.log(total)).alias("lse"))


def block_count(df: DataFrame, block: int = BLOCK) -> int:
    return max(1, -(-df.count() // block))


def ranks(parts: DataFrame) -> DataFrame:
    """Pessimistic (last of the tied) and optimistic (first of the tied) rank of each positive."""
    return parts.select("query_id", (F.col("above") + F.col("level")).alias("pessimistic"), (F.col("above") + 1).alias("optimistic"), "n")


def metrics(df: DataFrame, rank: str, by: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """R@k, median rank and mean reciprocal rank."""
    r = F.col(rank)
    base = df.groupBy(*by).agg(F.count(r).alias("n"), *[F.round(F.avg((r <= k).cast("double")), 9).alias(f"r_at_{k}") for k in ks], F.round(F.avg(1 / r), 9).alias("mrr"))
    median = quantiles.quantiles(df, by, rank, {"median_rank": 0.5}).drop("n")
    return null_safe_join(base, median, list(by), "left").select(*by, "n", *[f"r_at_{k}" for k in ks], F.round("median_rank", 9).alias("median_rank"), "mrr")


def macro(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of each metric over groups; the deviation of one group is 0."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), *[x for c in columns for x in (F.round(F.avg(c), 9).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 9).alias(f"{c}_std"))])


def chance(n: Column, ks: Sequence[int] = (1, 5, 10)) -> list[Column]:
    """Expected metrics of a random order of n candidates."""
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return [*[(F.least(F.lit(k), n) / n).alias(f"r_at_{k}") for k in ks], ((n + 1) / 2.0).alias("median_rank"), (harmonic / n).alias("mrr")]


def interval_pairs(left: DataFrame, right: DataFrame, key: str, width: float, tolerance: float) -> DataFrame:
    """Band join |left.key - right.key| <= tolerance as an equi join on cells of ``width``, left rows spread to neighbours."""
    reach = int(-(-tolerance // width))
    a = left.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(key) / width) - reach, F.floor(F.col(key) / width) + reach)))
    b = right.withColumn("_cell", F.floor(F.col(f"c_{key}") / width))
    return a.join(b, "_cell").where(F.abs(F.col(key) - F.col(f"c_{key}")) <= tolerance).drop("_cell")


def required_missing(have: DataFrame, required: Sequence[str], name: str = "name") -> DataFrame:
    want = have.sparkSession.createDataFrame([(r,) for r in required], f"{name} string")
    return want.join(have.select(name).distinct(), name, "left_anti")


def seed_summary(runs: DataFrame, seed: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each metric over seeds, per key; every seed must have the same keys, each once, else it raises."""
    n = runs.agg(F.countDistinct(seed)).first()[0]
    per = runs.groupBy(*keys).agg(F.countDistinct(seed).alias("s"), F.count(F.lit(1)).alias("r"))
    bad = per.where((F.col("s") != n) | (F.col("r") != n)).head(1)
    if bad:
        raise ValueError(f"{[bad[0][k] for k in keys]} has {bad[0].r} results of {bad[0].s} seeds, there are {n}")
    return macro(runs, columns, keys).withColumnRenamed("groups", "seeds")
