"""Calls of a service for each row (naming, mapping, translation), with retries. The client is the caller's: `make()`
builds it once in a task, and it takes a list of prompts and gives a list of replies. Nothing here knows a service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str | None]]


def replies(client: Client, prompts: list[str], retries: int, wait: float, sleep=time.sleep) -> tuple[list[str | None], str | None]:
    """(replies, error): tried `retries` times more after a failure, waiting twice as long each time; nulls and the last
    error if none of them worked."""
    for attempt in range(retries + 1):
        try:
            found = client(prompts)
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} replies to {len(prompts)} prompts")
            return found, None
        except Exception as e:  # whatever a client raises, the rows say so and the job goes on
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(wait * 2**attempt)
    return [None] * len(prompts), error


def ask(df: DataFrame, prompt: str, make: Callable[[], Client], out: str = "reply", batch: int = 16, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """The rows with a reply and an error (null if there was none). Equal prompts of a batch are asked once; null and
    blank ones not at all. Write the result before it is read twice: a recomputed task asks again."""
    keep = [c for c in df.columns if c not in (out, "error")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    source = df.select(*keep, F.col(prompt).cast("string").alias("_prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for rows in batches:
            prompts = rows.column(len(keep)).to_pylist()
            asked = list(dict.fromkeys(p for p in prompts if p and not p.isspace()))
            found: dict[str, tuple[str | None, str | None]] = {}
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                got, error = replies(client, part, retries, wait)
                found |= {p: (r, error) for p, r in zip(part, got, strict=True)}
            pairs = [found.get(p, (None, None)) for p in prompts]
            columns = [pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *columns], [*keep, out, "error"])

    return source.mapInArrow(run, f"{fields}, `{out}` string, error string")
