"""Joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.store import materialize

#: Parts into which the rows of one key are spread.
SALTS = 16


def spread_join(many: DataFrame, one: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``many`` with ``one``, which has one row per key, when a key may hold a third of ``many``.

    The rows of a key are spread over SALTS parts by a hash of the columns ``by``; ``one`` is repeated for each part, so
    its shuffled size is SALTS times its own, never the product of both. Nulls in ``on`` match nothing, as in any join.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns in which nulls are equal; the columns of ``a`` stay, those of ``b`` but the keys are added. Without keys ``b`` has one row."""
    if not on:
        return a.join(F.broadcast(b), how="left")
    other = b.select(*[F.col(n).alias(f"_on_{n}") for n in on], *[c for c in b.columns if c not in on])
    same = [F.col(n).eqNullSafe(F.col(f"_on_{n}")) for n in on]
    return a.join(other, same, how).drop(*[f"_on_{n}" for n in on])


def ordered_index(df: DataFrame, column: str, name: str = "i") -> DataFrame:
    """Distinct non-null values of a column with their place from 0 in its order, without a task that holds them all.

    Values are cut into ranges and ranked within each; one row a range says how many come before.
    """
    x = df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    x = materialize(x.select(column, F.spark_partition_id().alias("_p")))
    n = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min(column).alias("_first"))
    before = n.select("_p", (F.sum("_n").over(Window.orderBy("_first")) - F.col("_n")).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return x.withColumn("_at", place).join(F.broadcast(before), "_p").select(column, (F.col("_before") + F.col("_at")).alias(name))
