"""Deterministic sampling and ranking. Order that looks random is the md5 of the key: the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash by which groups are counted before they are cut.
DIGITS = 3


def hash_order(key: str, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def sample_rows(df: DataFrame, key: str, size: int, seed: str = "") -> DataFrame:
    """Exactly `size` rows (or all): a top-k, no full sort."""
    return df.orderBy(hash_order(key, seed), key).limit(size)


def top_per_group(df: DataFrame, group: str, size: int, *order: Column) -> DataFrame:
    """The first rows of each group with their rank; Spark cuts each task's rows of a group to `size` first."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= size)


def sample_per_group(df: DataFrame, group: str, key: str, size: int, seed: str = "") -> DataFrame:
    return top_per_group(df, group, size, hash_order(key, seed), F.col(key)).drop("rank")


def first_by_hash(df: DataFrame, group: str, key: str, wanted: Column, seed: str = "") -> DataFrame:
    """The rows with `chosen`: whether a row is among the first of its group in hash order, as many as `wanted` says
    (over class_n, the group's rows, and all_n, all rows). Counts by the first digits of the hash tell where each
    group is cut; only rows at the cut are ranked, so no task sees a whole group."""
    step = F.conv(F.substring(hash_order(key, seed), 1, DIGITS), 16, 10).cast("int")
    rows = df.withColumn("_step", step)
    counts = rows.groupBy(group, "_step").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("class_n"))
    total = sizes.agg(F.sum("class_n").alias("all_n"))
    goals = sizes.crossJoin(F.broadcast(total)).select(group, wanted.alias("_wanted"))
    # 16 ** DIGITS rows a group at most.
    over = W.partitionBy(group).orderBy("_step").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("n").over(over)).join(goals, group)
    reached = F.min(F.when(F.col("_upto") >= F.col("_wanted"), F.struct("_step", "_upto", "n")))
    cuts = upto.groupBy(group).agg(reached.alias("cut"), F.max("_wanted").alias("_wanted"))
    cuts = cuts.select(group, F.coalesce("cut._step", F.lit(16**DIGITS)).alias("_cut"), (F.col("_wanted") - F.col("cut._upto") + F.col("cut.n")).alias("_room"))
    marked = rows.join(cuts, group)
    sure = marked.where("_step != _cut").withColumn("chosen", F.col("_step") < F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(hash_order(key, seed), key))
    edge = marked.where("_step = _cut").withColumn("chosen", rank <= F.col("_room"))
    return sure.unionByName(edge).drop("_step", "_cut", "_room")


def stratified_sample(df: DataFrame, group: str, key: str, size: int, floor: int, seed: str = "") -> DataFrame:
    """Of each class its share of `size` rows, `floor` at least (or all of it), then cut to `size`."""
    wanted = F.greatest(F.lit(floor), F.round(size * F.col("class_n") / F.col("all_n")).cast("int"))
    chosen = first_by_hash(df, group, key, wanted, seed).where("chosen").drop("chosen")
    return sample_rows(chosen.select(df.columns), key, size, seed + "trim")


def split_80_20(df: DataFrame, group: str, key: str, seed: str = "") -> DataFrame:
    """held_out for a fifth of each class (rounded up), in hash order."""
    marked = first_by_hash(df, group, key, F.ceil(F.col("class_n") * 0.2), seed)
    return marked.select(*df.columns, F.col("chosen").alias("held_out"))


def sample_over_shards(df: DataFrame, shard: str, key: str, size: int, seed: str = "") -> DataFrame:
    """`size` rows evenly over shards: size div shards of each, one more of as many (in hash order) as remain. A shard
    with fewer rows gives all, and the sample is that much shorter. Rows come in an order that looks random."""
    shards = df.select(shard).distinct()
    n = shards.count()
    extra = size - size // n * n if n else 0
    place = F.row_number().over(W.orderBy(hash_order(shard, seed), shard))  # one row a shard
    share = shards.select(F.col(shard).alias("_shard"), (F.lit(size // n if n else 0) + (place <= extra).cast("int")).alias("_share"))
    most = size // n + 1 if n else 0
    ranked = top_per_group(df, shard, most, hash_order(key, seed), F.col(key))
    drawn = ranked.join(share, ranked[shard].eqNullSafe(share["_shard"])).where("rank <= _share")
    return drawn.select(df.columns).orderBy(hash_order(key, seed + "order"), key)


def sample_files(paths: list[str], size: int, seed: int | None = None) -> list[str]:
    """Of a sorted list of files `size` drawn with a seed (the first ones without), in order of name."""
    import random

    ordered = sorted(paths)
    chosen = ordered if size >= len(ordered) else random.Random(seed).sample(ordered, size) if seed is not None else ordered[:size]
    return sorted(chosen)


def folds(key: str, k: int) -> Column:
    """Fold of a row, 0 to k - 1."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % k
