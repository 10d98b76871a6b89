"""Connected components of links by alternating star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `links` (a, b; any order): root is the smallest node that it reaches.

    Large star: each node hands its larger neighbours to its smallest one. Small star: likewise with its
    smaller neighbours. Both keep the components and end in stars; the number of rounds grows with the
    logarithm of the number of nodes. Every round is checkpointed to the shared folder, so a lost executor costs
    no more than one round. Nothing is collected but two sums."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = (
            small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
            .checkpoint()
        )
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if seen == (now.n, now.h):
            break
        seen = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    # Every edge now leads from a node to its root.
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
