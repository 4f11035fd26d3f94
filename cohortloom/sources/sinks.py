"""Writers: Parquet with a CSV twin, deterministic JSON and JSON lines, array stores, reports, scaler states."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.text import INVISIBLE, PUNCTUATION, RULES


def write_manifest(df: DataFrame, parquet: str, csv: str | None = None) -> None:
    """Parquet (zstd) and, from what was written, a CSV twin; an existing target raises, so one-time results stay."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(parquet)
    if csv:
        df.sparkSession.read.parquet(parquet).write.mode("errorifexists").option("header", "true").option("lineSep", "\n").csv(csv)


def json_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def write_json(value: object, path: str) -> str:
    """Sorted, indented JSON of a small aggregate, put in place at once; gives its SHA-256."""
    data = json_text(value).encode()
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)
    return hashlib.sha256(data).hexdigest()


def write_jsonl(df: DataFrame, path: str, key: str, single: bool = False) -> None:
    """Compact JSON lines with sorted keys in key order: range-partitioned files in order, or one file where bytes must be stable."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    out = df.orderBy(key).select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode("errorifexists").text(path)


STORE = "features-v1"


def write_arrays(df: DataFrame, path: str, meta: Mapping[str, str] | None = None, length: int | None = None, values: str = "values") -> None:
    """Feature sequences as Parquet with array columns and their metadata in every row; Spark's commit protocol makes a partial write invisible.

    ``length``: what every sequence must have. A null, empty, wrongly long or not finite sequence raises before anything is written.
    """
    if values in df.columns:
        n = F.size(values)
        bad = F.col(values).isNull() | (n < 1) | F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        if length is not None:
            bad = bad | (n != length)
        if df.where(bad).head(1):
            raise ValueError(f"{values} must be finite sequences" + (f" of length {length}" if length else ""))
    fixed = {"store_version": STORE, **(meta or {})}
    df.withColumn("meta", F.create_map(*[F.lit(str(x)) for kv in sorted(fixed.items()) for x in kv])).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_arrays(spark: SparkSession, path: str, meta: Mapping[str, str] | None = None) -> DataFrame:
    """A feature store whose version and metadata are as expected; others raise."""
    df = spark.read.parquet(path)
    want = {"store_version": STORE, **(meta or {})}
    wrong = df.where(~F.forall(F.array(*[F.element_at("meta", k).eqNullSafe(str(v)) for k, v in want.items()]), lambda x: x)).head(1)
    if wrong:
        raise ValueError(f"the store is not of {want}")
    return df


def extend_index(spark: SparkSession, wanted: DataFrame, path: str, key: str, extract) -> dict[str, int]:
    """Extract what an index lacks and append it; a second run extracts nothing. Gives existing and extracted counts."""
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = wanted.select(key).limit(0)
    lacking = wanted.join(have, key, "left_anti")
    n = lacking.count()
    if n:
        extract(lacking).write.mode("append").parquet(path)
    return {"existing": wanted.count() - n, "extracted": n}


def save_scaler(fitted: DataFrame, path: str, kind: str, version: str = "scaler-v1") -> None:
    bad = fitted.where(~(F.col("scale") > 0) | F.isnan("scale") | F.isnan("center") | F.col("center").isNull()).head(1)
    if bad:
        raise ValueError("centers must be finite and scales positive")
    fitted.withColumns({"kind": F.lit(kind), "version": F.lit(version)}).write.mode("errorifexists").parquet(path)


def load_scaler(spark: SparkSession, path: str, kind: str, version: str = "scaler-v1") -> DataFrame:
    df = spark.read.parquet(path)
    if df.where(~F.col("kind").eqNullSafe(kind) | ~F.col("version").eqNullSafe(version)).head(1):
        raise ValueError(f"not a {kind} state of version {version}")
    return df.drop("kind", "version")


def normalization_rules() -> dict[str, object]:
    """The rules artifact: version, ordered rules, and the tables they use."""
    return {"version": "text-normalization-v2", "rules": list(RULES), "invisible": INVISIBLE, "punctuation": dict(PUNCTUATION)}


def markdown_table(rows: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    """A report table of a small collected aggregate."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)]) + "\n"


def protocol_artifact(assigned: DataFrame) -> dict[str, object]:
    """Nested counts of a protocol: partitions, exclusions by reason; ids stay in the long table."""
    rows = assigned.groupBy("partition", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content").alias("contents"), F.countDistinct("entity").alias("entities")).collect()  # partitions and reasons
    return {
        "partitions": {r["partition"]: {"trials": r["n"], "content_groups": r["contents"], "entity_groups": r["entities"]} for r in rows if r["partition"]},
        "excluded_by_reason": {r["reason"]: r["n"] for r in rows if r["reason"]},
        "total": sum(r["n"] for r in rows),
    }


def audit_report(title: str, sections: Mapping[str, DataFrame], path: str, most: int = 500) -> str:
    """A Markdown report with a table for each named aggregate, sorted by all its columns; gives its SHA-256.

    Aggregates are small by their nature; one with more than ``most`` rows raises instead of being cut.
    """
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        rows = df.orderBy(*df.columns).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: not for a report")
        parts.append(f"## {name}\n\n" + markdown_table([r.asDict() for r in rows], df.columns))
    data = "\n".join(parts).encode()
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)
    return hashlib.sha256(data).hexdigest()
