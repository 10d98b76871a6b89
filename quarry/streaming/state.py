"""State carried over batches of a stream: mergeable partial aggregates, and last-wins rows.

    <target>/batch=<n>   what batch n of the stream comes to
    <target>/base=<n>    what all batches up to n come to

A batch writes only its own partial state, in place of what an earlier try of it has left, so a batch that is run again after
a crash counts once, and what a batch writes doesn't grow with what came before. The state is the merge of the last base and the
batches after it. Merging is associative, so any split of the input into batches gives the same state; after each `every`
batches they are merged to a base, which counts once it is whole, and what a base stands for is passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import files


class State(NamedTuple):
    """partial: rows to partial state; merge: partial states, put together, to one; finish: state to results."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def figures(keys: list[str], values: list[str]) -> State:
    """By keys: n (rows), and of each value its count, sum, sum of squares, least and largest; finished as mean and standard
    deviation. Null values don't count; a null key is a key."""

    def partial(df: DataFrame) -> DataFrame:
        made = [F.count("*").alias("n")]
        for v in values:
            x = F.col(v).cast("double")
            made += [F.count(v).alias(f"{v}_n"), F.sum(x).alias(f"{v}_sum"), F.sum(x * x).alias(f"{v}_squares"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
        return df.groupBy(*keys).agg(*made)

    def merge(df: DataFrame) -> DataFrame:
        made = [F.sum("n").alias("n")]
        for v in values:
            made += [F.sum(f"{v}_n").alias(f"{v}_n"), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.sum(f"{v}_squares").alias(f"{v}_squares"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
        return df.groupBy(*keys).agg(*made)

    def finish(df: DataFrame) -> DataFrame:
        out = [*keys, "n"]
        for v in values:
            n, total, squares = F.col(f"{v}_n"), F.col(f"{v}_sum"), F.col(f"{v}_squares")
            spread = F.greatest((squares - total * total / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
            out += [f"{v}_n", f"{v}_sum", f"{v}_min", f"{v}_max", (total / F.nullif(n, F.lit(0))).alias(f"{v}_mean"), F.sqrt(F.when(n > 1, spread)).alias(f"{v}_std")]
        return df.select(*out)

    return State(partial, merge, finish)


def last_wins(keys: list[str], *order: str) -> State:
    """The row with the greatest `order` of each key; among equals the one that is greatest as a whole, so that the split into
    batches doesn't matter. Null orders come first. Columns that can't be compared (maps) can't be in the rows."""

    def best(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c not in order]
        row = F.struct(*order, *rest)
        return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, "_row.*").select(*df.columns)

    return State(best, best, lambda df: df)


def whole(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """(the last base, the batches after it), of those that are written to the end."""
    fs, at = files(spark, target)
    done: dict[str, list[int]] = {"base": [], "batch": []}
    if fs.exists(at):
        for folder in fs.listStatus(at):
            kind, _, n = folder.getPath().getName().partition("=")
            if kind in done and fs.exists(files(spark, f"{target}/{kind}={n}/_SUCCESS")[1]):
                done[kind].append(int(n))
    base = max(done["base"], default=None)
    return base, sorted(n for n in done["batch"] if base is None or n > base)


def merged(spark: SparkSession, target: str, state: State) -> DataFrame | None:
    """The state; None before the first batch."""
    base, batches = whole(spark, target)
    parts = [f"{target}/base={base}"] * (base is not None) + [f"{target}/batch={n}" for n in batches]
    if not parts:
        return None
    out = spark.read.parquet(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spark.read.schema(out.schema).parquet(p))
    return state.merge(out)


def results(spark: SparkSession, target: str, state: State) -> DataFrame | None:
    found = merged(spark, target, state)
    return None if found is None else state.finish(found)


def take(df: DataFrame, number: int, target: str, state: State, every: int = 20) -> None:
    """One batch into the state; the same number again does nothing new."""
    spark = df.sparkSession
    base, _ = whole(spark, target)
    if base is not None and number <= base:
        return
    state.partial(df).write.mode("overwrite").parquet(f"{target}/batch={number}")
    _, batches = whole(spark, target)
    if len(batches) >= every:
        merged(spark, target, state).write.mode("overwrite").parquet(f"{target}/base={number}")


def carried(stream: DataFrame, target: str, checkpoint: str, state: State, every: int = 20) -> None:
    """Takes what is there of a stream into the state, then stops; the next call goes on from there."""
    done = stream.writeStream.foreachBatch(lambda df, number: take(df, number, target, state, every)).option("checkpointLocation", checkpoint)
    done.trigger(availableNow=True).start().awaitTermination()
