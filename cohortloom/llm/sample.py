"""A sample that stays as data grows: permanent random numbers (problem 4)."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.ids import hash_fraction
from cohortloom.llm.families import clean_id
from cohortloom.store import shared_folder

SHARE = 0.1
STATE = "id string, u double, first_load int"
SETTINGS = "name string, value double"


class Register:
    """The persisted numbers: a Parquet folder to which first-seen identifiers are appended, never changed.

    Beside the numbers it keeps the seed that new numbers are drawn with and the highest threshold that was asked for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or os.path.join(shared_folder(spark), f"cohortloom-numbers-{uuid.uuid4().hex}")
        spark.createDataFrame([], STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/numbers")
        spark.createDataFrame([], SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    @staticmethod
    def of(spark: SparkSession, table_path: str, group: str) -> Register:
        """The register of one table and column in the shared folder: the same in every run that shares the folder."""
        name = hashlib.sha256(f"{table_path.rstrip('/')}\0{group}".encode()).hexdigest()[:24]
        return Register(spark, os.path.join(shared_folder(spark), f"cohortloom-register-{name}"))

    def numbers(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/numbers")

    def setting(self, name: str) -> float | None:
        """The highest value stored under a name."""
        return self.spark.read.schema(SETTINGS).parquet(f"{self.path}/settings").where(F.col("name") == name).agg(F.max("value")).first()[0]

    def _keep(self, name: str, value: float) -> None:
        self.spark.createDataFrame([(name, float(value))], SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    def seed(self, first: int) -> int:
        """The seed of the register; ``first`` where it has none yet."""
        kept = self.setting("seed")
        if kept is None:
            self._keep("seed", first)
            return first
        return int(kept)

    def add(self, ids: DataFrame, number: Column) -> None:
        """Anti-join insert of (id, first_load), one row per id: identifiers without a number get ``number``, once; the rest keep theirs."""
        new = ids.where(F.col("id").isNotNull()).select("id", "first_load").join(self.numbers().select("id"), "id", "left_anti")
        new.select("id", number.cast("double").alias("u"), F.col("first_load").cast("int").alias("first_load")).write.mode("append").parquet(f"{self.path}/numbers")

    def chosen(self, threshold: float = SHARE) -> DataFrame:
        """Identifiers under the threshold. It never falls: a lower one than was asked for before is refused, as it would drop chosen ones."""
        highest = self.setting("threshold")
        if highest is not None and threshold < highest:
            raise ValueError(f"the register was sampled under {highest}; {threshold} would drop identifiers already chosen")
        if highest is None or threshold > highest:
            self._keep("threshold", threshold)
        return self.numbers().where(F.col("u") < threshold)


def first_seed(df: DataFrame, load: str, seed: str) -> int:
    """The commonest seed of the first load, the smallest of equals; stray seeds of single rows don't move the sample."""
    r = df.where(F.col(seed).isNotNull()).groupBy(load, seed).count().orderBy(F.col(load).asc_nulls_last(), F.desc("count"), seed).first()
    return r[seed] if r else 0


def identifiers(df: DataFrame, group: str, load: str) -> DataFrame:
    """(id, first_load): clean identifiers with the least load they are in; null where they are in none. Copies meet before the shuffle."""
    return df.groupBy(clean_id(F.col(group)).alias("id")).agg(F.min(load).cast("int").alias("first_load")).where(F.col("id").isNotNull())


def replay(df: DataFrame, group: str, load: str, seed: str, register: Register | None = None) -> Register:
    """Feed a table into a register. Null or blank identifiers are never sampled; an empty table gives none.

    All identifiers without a number are inserted at once, with the first load they are in: the number depends on
    nothing but the register's seed and the identifier, so loads fed one after the other give the same. It is their hash
    fraction, so a lost register can be redrawn; where a register is kept, its numbers hold, whatever they are.
    """
    out = register or Register(df.sparkSession)
    number = hash_fraction(F.lit(str(out.seed(first_seed(df, load, seed)))), F.col("id"))
    out.add(identifiers(df, group, load), number)
    return out
