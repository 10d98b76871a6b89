"""Stage runner: a linear plan of named stages over a run's folder, with skip, force, dry run, preflight, reports and a
state that a later run reads."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import files, read_text, replace, write_text


@dataclass(frozen=True)
class Config:
    """Paths of a run. Each can be set by the environment as QUARRY_ and its name in capitals."""

    raw: str = "data/raw"
    base: str = "data/runs"
    reports: str = "reports"
    models: str = "models"

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None, **given: str) -> Config:
        environ = os.environ if environ is None else environ
        found = {f.name: environ[k] for f in fields(cls) if (k := "QUARRY_" + f.name.upper()) in environ}
        return cls(**(found | given))


def preflight(spark: SparkSession, inputs: dict[str, tuple[str, ...]], least_free: int = 0, folder: str | None = None) -> list[str]:
    """What is missing before a run: tables (path: needed columns), and bytes of space in the folder's file system."""
    problems = []
    for path, needed in inputs.items():
        fs, p = files(spark, path)
        if not fs.exists(p):
            problems.append(f"{path} is missing")
            continue
        lacking = [c for c in needed if c not in spark.read.parquet(path).columns]
        if lacking:
            problems.append(f"{path} lacks {', '.join(lacking)}")
    if least_free and folder:
        fs, p = files(spark, folder)
        free = fs.getStatus(p).getRemaining() if fs.exists(p) else fs.getStatus().getRemaining()
        if free < least_free:
            problems.append(f"{folder} has {free} bytes free of {least_free}")
    return problems


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[SparkSession, DataFrame | None], DataFrame]
    needs: tuple[str, ...] = ()  # columns of its input
    report: Callable[[DataFrame], DataFrame] | None = None  # of its output


@dataclass
class Plan:
    base: str
    run_name: str
    stages: list[Stage]
    log: list[tuple[str, str]] = field(default_factory=list)

    def path(self, stage: str) -> str:
        return f"{self.base}/{self.run_name}/{stage}"

    def done(self, spark: SparkSession, stage: str) -> bool:
        """Whether a stage's output was committed."""
        fs, p = files(spark, self.path(stage) + "/_SUCCESS")
        return fs.exists(p)

    def state(self, spark: SparkSession) -> dict[str, str]:
        """What the last run did with each stage: run, skip or failed."""
        path = self.path("state.json")
        fs, p = files(spark, path)
        return json.loads(read_text(spark, path)) if fs.exists(p) else {}

    def execute(self, spark: SparkSession, force: set[str] = frozenset(), dry: bool = False, skip: set[str] = frozenset(), only_reports: bool = False) -> list[tuple[str, str]]:
        """Runs what isn't done yet; a stage after one that ran runs too, but for those to be skipped, whose old output
        is taken. An old output stays until the new one is whole. Reports are written beside the stages."""
        before: DataFrame | None = None
        stale, state = False, {} if dry else self.state(spark)
        for s in self.stages:
            old = self.done(spark, s.name)
            if (s.name in skip or only_reports) and not old:
                raise ValueError(f"{s.name} has no output to be taken")
            leave = s.name in skip or only_reports or (not stale and s.name not in force and old)
            self.log.append((s.name, "skip" if leave else "would run" if dry else "run"))
            stale = stale or not leave
            if dry:
                continue
            if not leave:
                lacking = [c for c in s.needs if before is None or c not in before.columns]
                if lacking:
                    raise ValueError(f"{s.name} needs {', '.join(lacking)}")
                try:
                    replace(s.run(spark, before), self.path(s.name))
                except Exception:
                    write_text(spark, self.path("state.json"), json.dumps(state | {s.name: "failed"}))
                    raise
            before = spark.read.parquet(self.path(s.name))
            if s.report is not None and (only_reports or not leave):
                replace(s.report(before), self.path(s.name) + ".report")
            state[s.name] = "skip" if leave else "run"
            write_text(spark, self.path("state.json"), json.dumps(state))
        return self.log
