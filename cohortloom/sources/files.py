"""Readers: marker tables, workbooks, recording headers, signals and audio, as distributed scans.

Binary formats go through Spark's ``binaryFile`` source and ``mapInPandas``: one file is one row, parsed where it is
read. A file that cannot be parsed gives a row whose ``error`` says why, never a failed job.
"""

from __future__ import annotations

import configparser
import csv
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EVENTS = "onset DOUBLE, duration DOUBLE, trial_type STRING, value STRING, sample BIGINT"
OVERRIDES = ("source_id", "target_id", "status", "reviewer", "reason")
NAME = r"sub-([^_/]+)_ses-([^_]+)_task-([^_]+)_run-([^_]+)_([a-z]+)\.[A-Za-z]+$"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Projected and filtered Parquet scan; both reach the file reader."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab-separated markers with a header and perhaps a byte-order mark; no matching file gives an empty table.

    ``file`` and ``ord`` (the row's place in its file) make the order total.
    """
    schema = T.StructType.fromDDL(EVENTS)
    text = _whole(spark, paths)
    if text is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", T.StringType()), T.StructField("ord", T.IntegerType())]))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = pd.read_csv(io.BytesIO(content), sep="\t", encoding="utf-8-sig", dtype={"trial_type": str, "value": str}, keep_default_na=False, na_values=["n/a", ""])
                rows = rows.reindex(columns=[f.name for f in schema.fields])
                rows["sample"] = pd.to_numeric(rows["sample"], errors="coerce").astype("Int64")
                rows["trial_type"] = rows["trial_type"].str.strip()
                yield rows.assign(file=path, ord=np.arange(len(rows), dtype=np.int32))

    return text.mapInPandas(parse, EVENTS + ", file STRING, ord INT")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Comma-separated text of exactly these columns, in this order, perhaps after a byte-order mark; all values are strings, empty is null.

    Another header raises; a row with more or fewer fields than the header makes the read fail.
    """
    first = spark.read.text(path).limit(1).first()
    head = [] if first is None else next(csv.reader([first[0].removeprefix("\ufeff")]))
    if head != list(columns):
        raise ValueError(f"the header must be {list(columns)}, not {head}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "FAILFAST").option("escape", '"').option("multiLine", "true").csv(path)


def open_random(path: str):
    """A file that can be read at any place, through the file system that its address names; a bare path is local."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class Handles:
    """The files that one task reads, a bounded number of them open at once."""

    def __init__(self, most: int = 64):
        self.most, self.open = most, {}

    def __call__(self, path: str):
        if path not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = open_random(path)
        return self.open[path]


def _whole(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a root by name pattern, in the natural order of subject, session and run; runs that are no numbers come last."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    parts = [F.regexp_extract("path", NAME, i + 1).alias(n) for i, n in enumerate(("subject", "session", "task", "run"))]
    x = found.select("path", "length", *parts)
    return x.withColumn("run_number", F.coalesce(F.expr("try_cast(run AS INT)"), F.lit(10**9))).orderBy("subject", "session", "run_number", "run", "path")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_parts(book: zipfile.ZipFile) -> list[str]:
    """Names of the sheets' parts in the order of the workbook, by its relationships; without a workbook part, by the numbers in the names."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [target.get(x.get(_REL + "id"), "") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet")]
        return [str(PurePosixPath(t.removeprefix("/")) if t.startswith("/") else PurePosixPath("xl") / t) for t in found]
    return sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def xlsx_cells(content: bytes, sheet_index: int = 0) -> list[tuple[int, int, str | None]]:
    """(row, column, value) of one sheet: shared, inline and formula text, booleans, integral numbers without a fraction."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter(_NS + "t")))
    sheets = sheet_parts(book)
    if not 0 <= sheet_index < len(sheets):
        raise ValueError(f"no sheet {sheet_index} among {len(sheets)}")
    out = []
    for cell in ElementTree.fromstring(book.read(sheets[sheet_index])).iter(_NS + "c"):
        ref = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r", ""))
        if not ref:
            raise ValueError(f"bad cell reference {cell.get('r')!r}")
        column = 0
        for letter in ref[1]:
            column = column * 26 + ord(letter) - 64
        kind, value = cell.get("t"), cell.find(_NS + "v")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in cell.iter(_NS + "t"))
        elif value is None or value.text is None:
            continue
        elif kind == "s":
            text = shared[int(value.text)]
        elif kind == "b":
            text = "TRUE" if value.text == "1" else "FALSE"
        elif kind in ("str", "e"):
            text = value.text
        else:
            number = float(value.text)
            text = str(int(number)) if number.is_integer() else repr(number)
        out.append((int(ref[2]), column, text))
    return out


def _parsed(df: DataFrame, parse: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    names = T.StructType.fromDDL(schema).names

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, *r, None) for r in parse(path, content)]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, *[None] * len(names), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype(object).where(lambda x: x.notna(), None)

    return df.select("path", "content").mapInPandas(run, f"path STRING, {schema}, error STRING")


def read_xlsx(spark: SparkSession, paths: str | list[str], sheet_index: int = 0) -> DataFrame:
    """(path, row, column, value, error) of one sheet of each workbook, original row numbers kept."""
    return _parsed(_whole(spark, paths), lambda _, b: xlsx_cells(b, sheet_index), "row INT, column INT, value STRING")


def text_units(cells: DataFrame) -> DataFrame:
    """Workbook cells to text units: the header row and blanks are skipped, a row of digits is a chapter marker and restarts the row count, columns E and F label boundaries."""
    wide = cells.where("error IS NULL AND row > 1").groupBy("path", "row").agg(*[F.max(F.when(F.col("column") == i, F.col("value"))).alias(n) for i, n in ((1, "text"), (5, "start_label"), (6, "end_label"))])
    u = wide.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("is_marker", F.trim("text").rlike("^[0-9]+$"))
    w = Window.partitionBy("path").orderBy("row")
    u = u.withColumn("episode", F.sum(F.col("is_marker").cast("int")).over(w)).withColumn("chapter", F.coalesce(F.last(F.when(F.col("is_marker"), F.expr("try_cast(trim(text) AS INT)")), ignorenulls=True).over(w), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("path", "episode", "is_marker").orderBy("row"))
    return u.select("path", "row", "text", "start_label", "end_label", "is_marker", "chapter", F.when(~F.col("is_marker"), F.format_string("ch%02d:row%04d", "chapter", n)).alias("unit"))


def header_fields(path: str, content: bytes) -> list[tuple]:
    text = content.decode("utf-8-sig", "replace")
    body = "\n".join(text.splitlines()[1:] if not text.lstrip().startswith("[") else text.splitlines())
    body = body.split("[Comment]")[0]
    ini = configparser.ConfigParser(interpolation=None, strict=False, comment_prefixes=(";",))
    ini.optionxform = str
    ini.read_string(body)
    common, binary = ini["Common Infos"], ini["Binary Infos"] if "Binary Infos" in ini else {}
    width = {"INT_16": 2, "IEEE_FLOAT_32": 4, "INT_32": 4}[binary.get("BinaryFormat", "IEEE_FLOAT_32")]
    channels = [ini["Channel Infos"][k].split(",")[0] for k in ini["Channel Infos"]] if "Channel Infos" in ini else []
    stem = PurePosixPath(path).with_suffix("").name
    return [(common.get("DataFile", stem + ".eeg"), common.get("MarkerFile", stem + ".vmrk"), int(common["NumberOfChannels"]), 1e6 / float(common["SamplingInterval"]), width, "|".join(channels))]


def read_headers(spark: SparkSession, paths: str | list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Recording headers: data and marker file, channels, rate; with ``sizes`` (path, length) also samples, remainder and broken references.

    Where the data file named in a header doesn't exist, the file with the header's own stem is taken.
    """
    h = _parsed(_whole(spark, paths), header_fields, "data_file STRING, marker_file STRING, channels INT, rate DOUBLE, width INT, channel_names STRING")
    if sizes is None:
        return h
    folder, stem = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    s1 = sizes.select(F.col("path").alias("_a"), F.col("length").alias("_la"))
    s2 = sizes.select(F.col("path").alias("_b"), F.col("length").alias("_lb"))
    x = h.join(s1, F.concat(folder, F.lit("/"), F.col("data_file")) == F.col("_a"), "left").join(s2, F.concat(folder, F.lit("/"), stem, F.lit(".eeg")) == F.col("_b"), "left")
    n = F.coalesce("_la", "_lb")
    frame = F.col("channels") * F.col("width")
    return x.withColumn("broken_reference", F.col("_la").isNull()).withColumn("n_times", F.expr("coalesce(_la, _lb) div (channels * width)")).withColumn("remainder", n % frame).drop("_a", "_la", "_b", "_lb")


def wav_layout(file, size: int) -> dict[str, int]:
    """Rate, channels, bits, place of the samples and number of frames of a PCM file, from its chunk headers alone."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, out = 12, {}
    while at + 8 <= size and "frames" not in out:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            out |= {"channels": channels, "rate": rate, "bits": bits}
        elif name == b"data" and "rate" in out:
            out |= {"start": at + 8, "frames": min(length, size - at - 8) // max(1, out["channels"] * out["bits"] // 8)}
        at += 8 + length + length % 2
    if "frames" not in out:
        raise ValueError("fmt or data chunk missing")
    return out


def read_wav_info(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, frames, rate, channels, bits, seconds, error) of PCM audio files; only their headers are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    schema = "path STRING, frames BIGINT, rate INT, channels INT, bits INT, seconds DOUBLE, error STRING"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, size in zip(pdf["path"], pdf["length"]):
                try:
                    with open_random(path) as f:
                        w = wav_layout(f, size)
                    rows.append((path, w["frames"], w["rate"], w["channels"], w["bits"], w["frames"] / w["rate"], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    return files.mapInPandas(run, schema)


def _segments(segments: DataFrame, read: Callable[[Handles, dict], np.ndarray], columns: str = "values ARRAY<FLOAT>") -> DataFrame:
    """Adds ``values`` and ``error`` to rows that name a path and bounds; rows of a partition share open files."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + f", {columns}, error STRING"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Handles()
        for pdf in it:
            values, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    values.append(read(files, row).astype(np.float32).ravel().tolist())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(values=values, error=errors)

    return segments.mapInPandas(run, schema)


def read_signal_segments(segments: DataFrame, channels: int, dtype: str = "<f4") -> DataFrame:
    """Adds ``values`` (time-major, channel-interleaved) of [start, stop) of each row's ``path``.

    Only the bytes asked for are read, through the file system that the path names. Bounds outside the file give a null and ``error``.
    """
    width = channels * np.dtype(dtype).itemsize

    def read(files: Handles, row: dict) -> np.ndarray:
        f, a, b = files(row["path"]), int(row["start"]), int(row["stop"])
        n = f.size() // width
        if not 0 <= a < b <= n:
            raise ValueError(f"[{a}, {b}) outside 0..{n}")
        f.seek(a * width)
        return np.frombuffer(f.read((b - a) * width), dtype)

    return _segments(segments, read)


def read_audio_blocks(segments: DataFrame) -> DataFrame:
    """Adds ``values``, the mono samples in -1..1 of [start_sec, stop_sec) of each row's ``path``, a PCM file.

    Bounds are rounded to whole samples, half to even; the channels are averaged. A block that is empty or reaches outside
    the file, or another sample width than 8, 16, 24 or 32 bits, gives a null and ``error``.
    """

    def read(files: Handles, row: dict) -> np.ndarray:
        f = files(row["path"])
        w = wav_layout(f, f.size())
        a, b = round(row["start_sec"] * w["rate"]), round(row["stop_sec"] * w["rate"])
        if not 0 <= a < b <= w["frames"]:
            raise ValueError(f"[{a}, {b}) outside 0..{w['frames']}")
        size = w["bits"] // 8
        f.seek(w["start"] + a * size * w["channels"])
        raw = np.frombuffer(f.read((b - a) * size * w["channels"]), np.uint8).reshape(-1, size)
        if size == 1:
            x = (raw[:, 0].astype(float) - 128) / 128
        elif size in (2, 3, 4):
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - size :] = raw  # at the top of 32 bits, so that the sign is where it belongs
            x = wide.view("<i4")[:, 0] / 2.0**31
        else:
            raise ValueError(f"{w['bits']} bits a sample")
        return mono(x, w["channels"])

    return _segments(segments, read)


def mono(values: list[float] | np.ndarray, channels: int) -> np.ndarray:
    """Mean over the channels of interleaved audio."""
    return np.asarray(values, float).reshape(-1, channels).mean(1)


def read_overrides(spark: SparkSession, path: str, create: bool = False) -> DataFrame:
    """Manual overrides keyed by ``source_id``; the header must be exact; an empty or repeated source raises.

    With ``create`` a file that isn't there is made, with its header alone, for reviewers to fill in.
    """
    if create:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            with system.open_output_stream(inner) as f:
                f.write((",".join(OVERRIDES) + "\n").encode())
    raw = read_csv(spark, path, OVERRIDES)
    if raw.where(F.trim(F.coalesce("source_id", F.lit(""))) == "").head(1):
        raise ValueError("a source_id is empty")
    if raw.groupBy("source_id").count().where("count > 1").head(1):
        raise ValueError("a source_id occurs twice")
    return raw


def read_features(spark: SparkSession, path: str, schema: str, key: str, required: Sequence[str]) -> DataFrame:
    """JSON lines of feature requests: a row without a required field, or a key that occurs twice, raises."""
    df = read_jsonl(spark, path, schema)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in dict.fromkeys([key, *required])]))
    bad = df.select(F.col(key).alias("k"), lacking.alias("m")).where(F.size("m") > 0).orderBy("k").first()
    if bad:
        raise ValueError(f"row {bad.k} lacks {', '.join(bad.m)}")
    twice = df.groupBy(key).count().where("count > 1").orderBy(key).first()
    if twice:
        raise ValueError(f"{key} {twice[0]} occurs twice")
    return df


def tree_digest(spark: SparkSession, root: str, pattern: str = "*") -> str:
    """SHA-256 over the sorted lines ``name``, bar, SHA-256 of the content, for every file under a root; names are relative to it. Files are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    total = hashlib.sha256()
    base = root.rstrip("/").removeprefix("file:")
    for r in files.select("path", F.sha2("content", 256).alias("d")).orderBy("path").toLocalIterator():
        total.update(f"{r.path.split(base, 1)[-1].lstrip('/')}|{r.d}\n".encode())
    return total.hexdigest()


def read_jsonl(spark: SparkSession, path: str, schema: str, version: str | None = None, version_column: str = "window_schema_version") -> DataFrame:
    """JSON lines of a fixed schema; blank lines are skipped; another schema version raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if version is not None and df.where(~F.col(version_column).eqNullSafe(version)).head(1):
        raise ValueError(f"{version_column} must be {version}")
    return df
