"""Texts that print alike in two tables but hold different characters (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.readable import readable
from cohortloom.llm.fold import PLAIN_SPACE, fold
from cohortloom.operators.joins import spread_join


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, form) for each distinct non-null text of a key; one fold per distinct text, however often it is repeated."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias("text")).distinct()
    texts = rows.select("text").distinct().select(_digest(F.col("text")).alias("_d"), fold(F.col("text")).alias("form"))
    return spread_join(rows.withColumn("_d", _digest(F.col("text"))), texts, ["_d"], [key]).select(key, "text", "form")


def alike(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str) -> DataFrame:
    """Distinct (left_key, right_key) whose texts agree in the form but not as strings without plain white space.

    Left texts that are no readable sentences are left out, null texts and keys on either side too; an empty form agrees
    with nothing. Texts are made distinct before they are judged and folded, and meet as texts, by 16-byte digests: the
    rows of a text come in only where it has a partner, spread over many tasks, since one text may hold a third of them.
    """
    def rows(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias(key), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col(key).isNotNull()).select(key, "t", _digest(F.col("t")).alias(name))

    def texts(df: DataFrame, name: str, string: str, clean: bool) -> DataFrame:
        distinct = df.select("t").distinct()
        distinct = distinct.where(readable(F.col("t"))) if clean else distinct
        folded = distinct.select(_digest(F.col("t")).alias(name), F.regexp_replace("t", PLAIN_SPACE, "").alias("s"), fold(F.col("t")).alias("f")).where(F.col("f") != "")
        return folded.select(name, _digest(F.col("s")).alias(string), _digest(F.col("f")).alias("f"))

    a, b = rows(left, left_key, left_text, "_d1"), rows(right, right_key, right_text, "_d2")
    pairs = texts(a, "_d1", "_s1", True).join(texts(b, "_d2", "_s2", False), "f").where(F.col("_s1") != F.col("_s2")).select("_d1", "_d2")
    half = spread_join(a.select(left_key, "_d1").distinct(), pairs, ["_d1"], [left_key]).drop("_d1").distinct()
    return spread_join(half, b.select(right_key, "_d2").distinct(), ["_d2"], [left_key]).select(left_key, right_key).distinct()
