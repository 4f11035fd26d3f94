"""Deterministic content and entity splits, protocols over them, and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.ids import NUL, check_ratios, hash_fraction, partition_of
from cohortloom.functions.text import is_missing

SEED = 42
MASKS = ("fuzzy_global_alignment", "missing_text", "material_variant_uncertain")
# The transfer protocols, as (name, source domains, target domain).
CROSS = (
    ("pl_to_silent_reading_unseen_text", ("passive_listening",), "silent_reading"),
    ("silent_reading_to_pl_unseen_text", ("silent_reading",), "passive_listening"),
    ("pl_silent_reading_to_ra_unseen_text", ("passive_listening", "silent_reading"), "reading_aloud"),
)


def prepare(manifest: DataFrame) -> DataFrame:
    """The columns that protocols need, with clean group, cohort and entity."""
    group = F.lower(F.trim("split_group_id"))
    cohort = F.concat_ws("::", "dataset_version", "paradigm")
    return manifest.select(
        "row_id", "record_id", group.alias("content"), cohort.alias("cohort"), F.concat_ws("::", cohort, F.col("subject_id")).alias("entity"), F.col("paradigm").alias("domain"),
        (F.coalesce(F.col("global_text_alignment_status") == "fuzzy", F.lit(False))).alias("fuzzy"), is_missing(F.col("raw_text")).alias("missing"),
        F.coalesce(F.array_contains(F.split("quality_flag", r"\|"), "material_variant_uncertain"), F.lit(False)).alias("uncertain"), "quality_flag", "split",
    )


def content_partition(content: Column, seed: int | str = SEED, train: float = 0.8, valid: float = 0.1, name: str = "validation") -> Column:
    """Partition of a content group by hash threshold: an expression of the id alone, so no shuffle is needed."""
    check_ratios(train, valid, 1 - train - valid)
    return partition_of(hash_fraction(F.lit(str(seed)), content), train, valid, name)


def quota_counts(sizes: DataFrame, n: str = "n", train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Adds ``n_train, n_valid, n_test`` to distinct sizes: whole quotas nearest to the ratios, none empty.

    Least sum of absolute errors, then of squares, then more train, more validation, less test. Only quotas within
    three of the requested ones can be least, so the search is constant per size. Sizes under three get all in train.
    """
    c = F.col(n).cast("long")
    near = lambda q: F.sequence(F.greatest(F.lit(1), F.least(c - 2, F.floor(c * q) - 3)), F.least(F.greatest(F.lit(1), c - 2), F.ceil(c * q) + 3))
    x = sizes.where(c >= 3).withColumn("t", F.explode(near(train))).withColumn("v", F.explode(near(valid))).withColumn("e", c - F.col("t") - F.col("v")).where("e >= 1")
    err = [F.col("t") - c * train, F.col("v") - c * valid, F.col("e") - c * (1 - train - valid)]
    key = F.struct(F.round(sum((F.abs(z) for z in err[1:]), F.abs(err[0])), 9).alias("a"), F.round(sum((z * z for z in err[1:]), err[0] * err[0]), 9).alias("b"), (-F.col("t")).alias("c"), (-F.col("v")).alias("d"), F.col("e").alias("f"))
    best = x.groupBy(n).agg(F.min_by(F.struct("t", "v", "e"), key).alias("q"))
    few = sizes.where(c < 3).select(n, c.alias("n_train"), F.lit(0).cast("long").alias("n_valid"), F.lit(0).cast("long").alias("n_test"))
    return best.select(n, F.col("q.t").alias("n_train"), F.col("q.v").alias("n_valid"), F.col("q.e").alias("n_test")).unionByName(few)


def entity_partition(rows: DataFrame, seed: int | str = SEED, strict: bool = False) -> DataFrame:
    """(cohort, entity, rank, partition): entities ranked by hash within their cohort and cut by its quotas.

    A cohort of fewer than three entities cannot fill three partitions: all its entities train, or it raises if ``strict``.
    """
    e = rows.select("cohort", "entity").distinct()
    if strict:
        small = e.groupBy("cohort").count().where("count < 3").orderBy("cohort").first()
        if small:
            raise ValueError(f"cohort {small.cohort} has {small['count']} entities, three are needed")
    fraction = hash_fraction(F.concat(F.lit(str(seed) + NUL), F.col("cohort")), F.col("entity"))
    sizes = e.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    quotas = quota_counts(sizes.select("n").distinct())
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("cohort").orderBy(fraction, "entity")) - 1)
    x = ranked.join(sizes, "cohort").join(quotas, "n")
    part = F.when(F.col("rank") < F.col("n_train"), "train").when(F.col("rank") < F.col("n_train") + F.col("n_valid"), "validation").otherwise("test")
    return x.select("cohort", "entity", "rank", part.alias("partition"))


def text_unseen(rows: DataFrame, seed: int | str = SEED) -> DataFrame:
    """Protocol A: every row takes its content group's partition."""
    return rows.withColumn("partition", content_partition(F.col("content"), seed)).withColumn("reason", F.lit(None).cast("string"))


def diagonal(rows: DataFrame, seed: int | str = SEED) -> DataFrame:
    """Protocol B: a row stays where the partitions of its content and its entity agree, else the reason names both."""
    e = entity_partition(rows, seed).select("entity", F.col("partition").alias("_e"))
    x = rows.withColumn("_c", content_partition(F.col("content"), seed)).join(e, "entity")
    same = F.col("_c") == F.col("_e")
    return x.withColumn("partition", F.when(same, F.col("_c"))).withColumn("reason", F.when(~same, F.concat(F.lit("off_diagonal_subject_"), "_e", F.lit("__content_"), "_c"))).drop("_c", "_e")


def strict_masks(rows: DataFrame) -> DataFrame:
    """(content, mask): groups in which any row is fuzzy, lacks text or is of an uncertain variant; one reason, in that order."""
    g = rows.groupBy("content").agg(*[F.bool_or(c).alias(c) for c in ("fuzzy", "missing", "uncertain")])
    mask = F.when(F.col("fuzzy"), MASKS[0]).when(F.col("missing"), MASKS[1]).when(F.col("uncertain"), MASKS[2])
    return g.select("content", F.concat(mask, F.lit("_group_excluded_from_strict_main")).alias("mask")).where(F.col("mask").isNotNull())


def cross_domain(rows: DataFrame, seed: int | str = SEED) -> DataFrame:
    """Protocols C: (protocol, row, partition or reason); masks first, then source, target and out-of-scope rules."""
    x = rows.withColumn("_p", content_partition(F.col("content"), seed)).join(strict_masks(rows), "content", "left")
    each = []
    for name, sources, target in CROSS:
        source, aimed = F.col("domain").isin(*sources), F.col("domain") == target
        keep = F.col("mask").isNull() & ((source & (F.col("_p") != "test")) | (~source & aimed & (F.col("_p") == "test")))
        why = F.when(F.col("mask").isNotNull(), F.col("mask")).when(source, "source_paradigm_test_content_excluded").when(aimed, "target_paradigm_non_test_content_excluded").otherwise("paradigm_out_of_protocol_scope")
        each.append(F.struct(F.lit(name).alias("protocol"), F.when(keep, F.col("_p")).alias("partition"), F.when(~keep, why).alias("reason")))
    return x.withColumn("_x", F.explode(F.array(*each))).select(*rows.columns, "_x.*")


def accounting(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Rows kept, excluded and in total; ``unaccounted`` counts rows with neither or both of partition and reason."""
    kept, out = F.col("partition").isNotNull(), F.col("reason").isNotNull()
    return assigned.groupBy(*by).agg(F.count_if(kept).alias("n_kept"), F.count_if(out).alias("n_excluded"), F.count(F.lit(1)).alias("n_all"), F.count_if(kept == out).alias("unaccounted"))


def partition_counts(assigned: DataFrame, by: list[str]) -> DataFrame:
    kept = assigned.where(F.col("partition").isNotNull())
    return kept.groupBy(*by, "partition").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("content").alias("n_contents"), F.countDistinct("entity").alias("n_entities"), F.countDistinct("domain").alias("n_domains"))


def leakage(assigned: DataFrame, by: list[str], what: str) -> DataFrame:
    """(by, pair, n): distinct ids that two partitions share."""
    sets = assigned.where(F.col("partition").isNotNull()).groupBy(*by, what).agg(F.array_sort(F.collect_set("partition")).alias("p")).where(F.size("p") > 1)
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.concat(a, F.lit("+"), b))))
    return sets.select(*by, F.explode(pairs).alias("pair")).groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"))
