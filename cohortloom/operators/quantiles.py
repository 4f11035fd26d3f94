"""Exact order statistics per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.joins import null_safe_join


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column per name): the value at a rank from 1, given as a function of the number of values.

    Null and NaN are no values; null keys are a group. Equal values are counted before the shuffle. The distinct ones of
    a group fall into cells of one per cent, cells are ranked by their counts, values within their cell: no task
    holds more than the distinct values of one cell. A rank outside 1..n gives null.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    counted = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    cell = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * (F.lit(70_000) + F.floor(F.log2(F.abs("_v")) * 64))).cast("int")
    counted = counted.withColumn("_cell", cell)
    cells = counted.groupBy(*keys, "_cell").agg(F.sum("_k").alias("_sum"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_sum").over(w.orderBy("_cell")) - F.col("_sum")
    cells = cells.select(*keys, "_cell", before.alias("_before"), F.sum("_sum").over(w).alias("n"))
    x = null_safe_join(counted, cells, [*keys, "_cell"])
    upto = F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_upto", upto)
    at = [F.min(F.when((F.col("_upto") >= r(F.col("n"))) & (r(F.col("n")) >= 1), F.col("_v"))).alias(name) for name, r in ranks.items()]
    return x.groupBy(*keys).agg(F.max("n").alias("n"), *at)


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(by, n, one column per name): interpolated quantiles, as by ``percentile``."""
    at = lambda q, n: F.lit(q) * (n - 1)
    ranks = {f"_{name}{end}": (lambda n, q=q, f=f: f(at(q, n)) + 1) for name, q in shares.items() for end, f in (("a", F.floor), ("z", F.ceil))}
    x = order_statistics(df, by, value, ranks)
    mix = [(F.col(f"_{n}a") + (F.col(f"_{n}z") - F.col(f"_{n}a")) * (at(q, F.col("n")) - F.floor(at(q, F.col("n"))))).alias(n) for n, q in shares.items()]
    return x.select(*by, "n", *mix)


def p95_exclusive(df: DataFrame, by: Sequence[str], value: str, name: str = "p95") -> DataFrame:
    """(by, n, p95): the 19th of 20 exclusive quantiles; null with fewer than two values."""
    j = lambda n: F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(19) * (n + 1) / 20)))
    x = order_statistics(df, by, value, {"_a": j, "_z": lambda n: j(n) + 1})
    n = F.col("n")
    delta = F.lit(19) * (n + 1) - F.lit(20) * j(n)
    return x.select(*by, "n", F.when(n >= 2, (F.col("_a") * (F.lit(20) - delta) + F.col("_z") * delta) / 20.0).alias(name))
