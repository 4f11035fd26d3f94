"""Run registered queries from a configuration: ``python -m cohortloom.run CONFIG.json``."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class WindowConfig:
    """Length, stride and delay of the windows of a run; the tail that is shorter than a window is dropped."""

    window_sec: float = 3.0
    stride_sec: float = 3.0
    eeg_delay_ms: float = 0.0
    tail: str = "drop"
    seed: int = 42

    def __post_init__(self):
        if not (self.window_sec > 0 and self.stride_sec > 0 and self.eeg_delay_ms >= 0):
            raise ValueError("window and stride must be positive and the delay at least 0")
        if self.tail != "drop":
            raise ValueError("padding is not allowed here")


@dataclass(frozen=True)
class RunConfig:
    """Which queries run over which tables, and where their results go: a Parquet folder for each."""

    tables: str
    output: str
    queries: tuple[str, ...]
    windows: WindowConfig = field(default_factory=WindowConfig)
    overwrite: bool = False

    @staticmethod
    def read(path: str, **overrides: Any) -> RunConfig:
        """A JSON file, with the values given in place of its own; unknown names raise."""
        with open(path, encoding="utf-8-sig") as f:
            raw = {**json.load(f), **{k: v for k, v in overrides.items() if v is not None}}
        unknown = set(raw) - {x.name for x in fields(RunConfig)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        windows = raw.pop("windows", {})
        return RunConfig(**{**raw, "queries": tuple(raw["queries"])}, windows=WindowConfig(**windows))


def run(spark, config: RunConfig) -> dict[str, str]:
    """Write each query's result to its folder; an existing one raises unless ``overwrite``. Gives the folders."""
    from cohortloom.plans import catalog

    known = catalog.queries()
    missing = [q for q in config.queries if q not in known]
    if missing:
        raise ValueError(f"no such query: {missing}")
    out = {}
    for name in config.queries:
        out[name] = os.path.join(config.output, name)
        known[name](spark, config.tables).write.mode("overwrite" if config.overwrite else "errorifexists").parquet(out[name])
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("config")
    p.add_argument("--tables")
    p.add_argument("--output")
    p.add_argument("--queries", nargs="+")
    p.add_argument("--overwrite", action="store_true", default=None)
    a = vars(p.parse_args(argv))
    from pyspark.sql import SparkSession

    print(json.dumps(run(SparkSession.builder.getOrCreate(), RunConfig.read(a.pop("config"), **a)), sort_keys=True))


if __name__ == "__main__":
    main()
