"""Checks of configurations and frozen artifacts, findings, and small shape rules. They run on the driver, over settings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = ("info", "warning", "error")
FINDING = "check string, severity string, source string, message string"


def differences(a: Mapping, b: Mapping, overrides: Iterable[str] = (), at: str = "") -> list[str]:
    """Dotted names whose values differ between two nested configurations, but for the overrides that are allowed."""
    allowed, out = set(overrides), []
    for k in sorted({*a, *b}, key=str):
        name = f"{at}.{k}" if at else str(k)
        if name in allowed:
            continue
        x, y = a.get(k), b.get(k)
        if isinstance(x, Mapping) and isinstance(y, Mapping):
            out += differences(x, y, allowed, name)
        elif x != y or (k in a) != (k in b):
            out.append(name)
    return out


def require_frozen(path: str, sha256: str) -> None:
    """Raises unless the file's bytes have the recorded digest."""
    with open(path, "rb") as f:
        got = hashlib.file_digest(f, "sha256").hexdigest()
    if got != sha256.removeprefix("sha256:"):
        raise ValueError(f"{path} has changed: {got}")


def require_untouched(config: Mapping[str, object], steps: Iterable[str] = ("filter", "resample", "rereference", "ica", "interpolate")) -> None:
    """Raises if a configuration for already processed recordings asks for any processing again."""
    asked = [s for s in steps if config.get(s)]
    if asked:
        raise ValueError(f"recordings are already processed; not allowed: {asked}")


def require_claim(fixed_pace: bool, claim: str) -> None:
    """Times at a fixed pace are display times and may not be called speech timing."""
    if fixed_pace and claim == "speech_timing":
        raise ValueError("a fixed pace is no speech timing")


def findings(spark: SparkSession, rows: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """(check, severity, source, message); another severity raises."""
    rows = list(rows)
    if any(r[1] not in SEVERITIES for r in rows):
        raise ValueError(f"severity must be one of {SEVERITIES}")
    return spark.createDataFrame(rows, FINDING)


def delay_label(milliseconds: Column) -> Column:
    """``000ms``-style label; a fraction is kept with an underscore."""
    whole = F.floor(milliseconds)
    return F.when(whole == milliseconds, F.format_string("%03dms", whole.cast("long"))).otherwise(F.concat(F.replace(milliseconds.cast("string"), F.lit("."), F.lit("_")), F.lit("ms")))


def symmetric_loss(scores: DataFrame, query: str, candidate: str, score: str, positive: Column) -> DataFrame:
    """Mean of both directions' cross entropy of the positives over a long table of scores of fixed batches."""
    top = lambda k: F.max(score).over(Window.partitionBy(k))
    m = scores.withColumn("_mq", top(query)).withColumn("_mc", top(candidate))
    side = lambda k, t: F.col(t) + F.log(F.sum(F.exp(F.col(score) - F.col(t))).over(Window.partitionBy(k)))
    x = m.withColumn("_q", side(query, "_mq") - F.col(score)).withColumn("_c", side(candidate, "_mc") - F.col(score)).where(positive)
    return x.agg(F.count(F.lit(1)).alias("n"), ((F.avg("_q") + F.avg("_c")) / 2).alias("loss"))


def schedule_digest(batches: DataFrame, order: list[str], item: str) -> DataFrame:
    """Digest of a batch schedule: of each batch's items in order, then of the batches' digests in order."""
    per = batches.groupBy(*order).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), "\n").cast("binary"), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "d"))), lambda x: x["d"]), "\n").cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n_batches"))


def require_protocol_input(df: DataFrame, required: Iterable[str], key: str = "record_id", group: str = "split_group_id", version: str = "manifest_schema_version") -> None:
    """A manifest fit for splitting: not empty, all columns there, key and group not null or empty, key unique, one schema version. The first fault raises."""
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    blank = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    r = df.agg(F.count(F.lit(1)).alias("n"), blank(key).alias("k"), blank(group).alias("g"), F.countDistinct(version).alias("v")).first()
    if not r.n:
        raise ValueError("the manifest is empty")
    if r.k or r.g:
        raise ValueError(f"{r.k} rows without {key}, {r.g} without {group}")
    twice = df.groupBy(key).count().where("count > 1").orderBy(key).first()
    if twice:
        raise ValueError(f"{key} {twice[0]} is not unique")
    if r.v != 1:
        raise ValueError(f"{r.v} schema versions")


def require_partitions(setting: str, assigned: DataFrame, manifest: DataFrame, key: str = "record_id", partition: str = "partition") -> None:
    """A protocol fit for windows: of a setting that begins with ``A_``, every id in one partition, every record of the manifest in it and no other. The first fault raises."""
    if not setting.startswith("A_"):
        raise ValueError(f"setting {setting} is not one of unseen text")
    several = assigned.where(F.col(partition).isNotNull()).groupBy(key).agg(F.countDistinct(partition).alias("n")).where("n > 1").orderBy(key).first()
    if several:
        raise ValueError(f"{several[0]} is in several partitions")
    a, b = assigned.where(F.col(partition).isNotNull()).select(key).distinct(), manifest.select(key).distinct()
    for what, x in (("has no partition", b.join(a, key, "left_anti")), ("is no record of the manifest", a.join(b, key, "left_anti"))):
        bad = x.orderBy(key).first()
        if bad:
            raise ValueError(f"{bad[0]} {what}")


def require_dataset(windows: DataFrame, partition: str, entities: DataFrame, features: DataFrame, crop: int, scaler: DataFrame | None, target_steps: int) -> None:
    """A window set fit for a model. The first fault raises.

    The partition is train, validation or test; ``entities`` (entity, index) covers exactly the windows' entities, from 0 without
    gaps; there is one sampling rate; the crop is shorter than every window; there is a scaler; every target has features
    (target_id, split, values) of its own split, all of ``target_steps`` steps. ``windows``: entity, target_id, split, rate, n_samples.
    """
    if partition not in ("train", "validation", "test"):
        raise ValueError(f"unknown partition {partition}")
    if scaler is None or scaler.isEmpty():
        raise ValueError("no scaler")
    mine = windows.where(F.col("split") == partition)
    r = mine.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rate").alias("rates"), F.min("n_samples").alias("least")).first()
    if not r.n:
        raise ValueError("no windows")
    if r.rates != 1:
        raise ValueError(f"{r.rates} sampling rates")
    if crop >= r.least:
        raise ValueError(f"a crop of {crop} leaves nothing of {r.least} samples")
    i = entities.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("e"), F.countDistinct("index").alias("d"), F.min("index").alias("a"), F.max("index").alias("z")).first()
    mixed = windows.select("entity").distinct().join(entities.select("entity"), "entity", "left_anti").head(1) or entities.select("entity").join(windows.select("entity"), "entity", "left_anti").head(1)
    if mixed or i.n != i.e or i.n != i.d or i.a != 0 or i.z != i.n - 1:
        raise ValueError("the entity index must cover the windows' entities exactly, from 0 without gaps")
    found = mine.select("target_id").distinct().join(features.select("target_id", F.col("split").alias("_split"), F.size("values").alias("_n")), "target_id", "left")
    bad = found.where(F.col("_n").isNull() | (F.col("_split") != partition) | (F.col("_n") != target_steps)).orderBy("target_id").first()
    if bad:
        raise ValueError(f"target {bad.target_id} has no features of its split in {target_steps} steps")
