"""Projection of vectors by the graph of their neighbours: fuzzy weights, then a spectral layout by filtered iteration.

Each row's neighbours get weights that fall with their distance beyond that of the nearest one, at a scale such that they add
up to the logarithm of their number; a link seen from both ends is the fuzzy union of its two weights. The layout are the
leading eigenvectors of the normalised links (without the one that only tells how many links a row has): rows that are linked
lie together, however the groups lie in the space they come from.

The graph is a table of links and the block of vectors a table of arrays. A step is a join along the links and a sum by row,
and the links lie where they are met, so only sums are shuffled. What comes to the driver is a matrix of a row and a column for
each dimension. A round is a polynomial of the links, one root a step, that is small from -1 to the least value that the block
stands for and grows beyond it. Rounds go on, and get longer where they gain little, until the leading vectors are eigenvectors
up to a residual.

Equal vectors lie at the same place. Results are the same up to the sign, which is fixed by the sum of cubes, and up to
rotations among equal eigenvalues (one for each part of the graph that has no link to the others).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import ensure_checkpoint_dir
from .neighbours import neighbours, tiled

#: Neighbours of a row, extra dimensions that speed the rounds up, steps of a round at first and at most, steps that are planned
#: together, and the length of a residual that ends the rounds.
NEAR, EXTRA, STEPS, MOST_STEPS, CHAIN, STILL = 15, 4, 16, 128, 3, 1e-6


def fuzzy(cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a row's neighbours from their distances, in order."""
    if not len(cost):
        return cost
    beyond, want = np.maximum(cost - cost[0], 0), np.log2(len(cost) + 1)
    low, high = 0.0, np.inf
    scale = 1.0
    for _ in range(rounds):
        total = np.exp(-beyond / scale).sum()
        if total > want:
            high, scale = scale, (low + scale) / 2
        else:
            low, scale = scale, scale * 2 if np.isinf(high) else (scale + high) / 2
    return np.exp(-beyond / max(scale, 1e-3 * cost.mean(), 1e-12))


def fuzzy_links(lists: DataFrame) -> DataFrame:
    """(a, b, w), both ways, from key and found (array of struct(cost, near, ...), nearest first): w = u + v - u v."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            found = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            cost, near = flat.field("cost").to_numpy(zero_copy_only=False), flat.field("near")
            ends = np.cumsum(sizes)
            weights = [fuzzy(cost[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), near, pa.array(np.concatenate(weights) if weights else np.zeros(0))], ["a", "b", "w"])

    one = lists.select("key", "found").mapInArrow(run, "a long, b long, w double")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b")
    # One weight or two: 1 - (1 - u)(1 - v), where a missing one is 0.
    return both.agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def summed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Sums of arrays by key: one sum for each place, so partial sums are made before the shuffle."""
    made = rows.groupBy(key).agg(*(F.sum(F.col(vector)[i]).alias(f"_{i}") for i in range(size)))
    return made.select(key, F.array(*(f"_{i}" for i in range(size))).alias(vector))


def totals(block: DataFrame, cells: list) -> list[float]:
    """Sums over all rows; 0 if there are none."""
    return [x or 0.0 for x in block.agg(F.array(*map(F.sum, cells))).first()[0]]


def filter_roots(low: float, high: float, steps: int) -> np.ndarray:
    """The roots of the polynomial that is least between two values, in an order (Leja's) that keeps all its parts in bounds."""
    left = ((low + high) + (high - low) * np.cos(np.pi * (np.arange(steps) + 0.5) / steps)) / 2
    out, far = [], np.zeros(steps)
    for _ in range(steps):
        i = int(np.argmax(far)) if out else 0
        out.append(left[i])
        with np.errstate(divide="ignore"):
            far += np.log(np.abs(left - left[i]))
    return np.array(out)


def ritz(one_x: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(m, values, residuals) for products of vectors x, of their images y and of the known first vector: (x - one one_x) m are
    orthonormal and stand for the values, largest first; zero columns, of value -2, where vectors depend on each other."""
    wide = len(one_x)
    bare = lambda g: g - np.outer(one_x, one_x)
    xx, xy, yy = bare(xx), bare((xy + xy.T) / 2), bare(yy)
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale = np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0)
    values, vectors = np.linalg.eigh(xx * np.outer(scale, scale))
    good = values > 1e-12 * max(values.max(), 1e-300)
    root = scale[:, None] * vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    values, vectors = np.linalg.eigh(root.T @ xy @ root - 2 * np.diag(~good))
    values, m = values[::-1], root @ vectors[:, ::-1]
    there = values > -1.5
    gaps = np.diag(m.T @ yy @ m) - 2 * values * np.diag(m.T @ xy @ m) + values**2
    return m * there, values, np.sqrt(np.maximum(np.where(there, gaps, 0), 0))


def spectral(links: DataFrame, size: int, rounds: int | None = None, still: float = STILL, extra: int = EXTRA) -> tuple[DataFrame, np.ndarray]:
    """(key, layout: array of `size` numbers; the eigenvalues) of links (a, b, w) both ways: the leading eigenvectors of
    D^-1/2 W D^-1/2 after the first, which is known (the roots of the degrees) and taken out. rounds: None to go on until the
    residuals are under `still`. Fewer rows than dimensions leave the rest 0."""
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    degree = links.groupBy("a").agg(F.sum("w").alias("d")).checkpoint()
    total = degree.agg(F.sum("d")).first()[0] or 1.0
    ends = degree.select(F.col("a").alias("b"), F.col("d").alias("e"))
    scaled = links.join(degree, "a").join(ends, "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"), F.lit(0.0).alias("own"))
    # Each row has a link to itself, for the roots.
    scaled = scaled.unionByName(degree.select("a", F.col("a").alias("b"), F.lit(0.0).alias("w"), F.lit(1.0).alias("own")))
    scaled = scaled.repartition(tasks, "b").sortWithinPartitions("b").checkpoint()
    ones = degree.select(F.col("a").alias("key"), F.sqrt(F.col("d") / total).alias("one")).repartition(tasks, "key").sortWithinPartitions("key").checkpoint()
    wide = size + extra
    each = range(wide)

    def stepped(block: DataFrame, root: float = 0.0, unit: float = 1.0) -> DataFrame:
        """key, x: the sums along the links, less root times x, all over unit."""
        weight = (F.col("w") - F.lit(float(root)) * F.col("own")) / F.lit(float(unit))
        sent = scaled.join(block.select(F.col("key").alias("b"), "x"), "b").select("a", F.transform("x", lambda v: v * weight).alias("x"))
        return summed(sent, "a", "x", wide).withColumnRenamed("a", "key")

    def with_image(block: DataFrame) -> tuple[DataFrame, tuple, np.ndarray]:
        """(key, one, x, y: y is x summed along the links; what `ritz` says of them; the products of x and the first vector)."""
        x = block.checkpoint()
        both = x.join(stepped(x).withColumnRenamed("x", "y"), "key").join(ones, "key").select("key", "one", "x", "y").checkpoint()
        pairs = [(i, j) for i in each for j in each]
        cells = [F.col("one") * F.col("x")[i] for i in each] + [F.col(p)[i] * F.col(q)[j] for p, q in ("xx", "xy", "yy") for i, j in pairs]
        found = np.array(totals(both, cells))
        return both, ritz(found[:wide], *found[wide:].reshape(3, wide, wide)), found[:wide]

    def turned(both: DataFrame, along: np.ndarray, m: np.ndarray, part: str) -> list:
        """The orthonormal vectors (x), or their images (y): the first vector is its own image."""
        bare = [F.col(part)[i] - F.col("one") * F.lit(float(along[i])) for i in each]
        return [sum((bare[i] * F.lit(float(m[i, j])) for i in each), F.lit(0.0)) for j in each]

    # Numbers that look random and are the same everywhere: parts of a hash, from -1 to 1.
    draw = F.array(*(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(2_000_003)) / 1_000_001.0 - 1 for i in each))
    both, (m, values, gaps), along = with_image(ones.select("key", draw.alias("x")))
    steps, done = STEPS, 0
    while gaps[:size].max() > still and (rounds is None or done < rounds):
        there = values[values > -1.5]
        # The filter ends at the least value of the block; a little below the largest if all are equal.
        high = max(min(there[-1], there[0] - 1e-4), -0.99)
        roots = filter_roots(-1.0, high, steps - 1)
        units = np.maximum(there[0], high + 1e-4) - roots
        x, y = turned(both, along, m, "x"), turned(both, along, m, "y")
        block = both.select("key", F.array(*((y[j] - x[j] * F.lit(float(roots[0]))) / F.lit(float(units[0])) for j in each)).alias("x"))
        for i in range(1, len(roots)):
            block = stepped(block.checkpoint() if i % CHAIN == 0 else block, roots[i], units[i])
        before = gaps[:size].max()
        both, (m, values, gaps), along = with_image(block)
        done += 1
        if gaps[:size].max() > before / 10:
            steps = min(2 * steps, MOST_STEPS)
    block = both.select("key", F.array(*turned(both, along, m, "x")[:size]).alias("x")).checkpoint()
    cubes = totals(block, [F.pow(F.col("x")[i], 3) for i in range(size)])
    place = [F.col("x")[i] * (1.0 if cubes[i] >= 0 else -1.0) for i in range(size)]
    return block.select("key", F.array(*place).alias("layout")), np.where(values > -1.5, values, 0.0)[:size]


def projected(df: DataFrame, key: str, vector: str, size: int = 2, near: int = NEAR, rounds: int | None = None) -> DataFrame:
    """`key` and `layout` (array of `size` numbers) for each row with a vector."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    same = rows.groupBy("vector").agg(F.min("id").alias("key")).checkpoint()
    lists = neighbours(*tiled(same, "key", "vector"), near).checkpoint()
    links = fuzzy_links(lists).checkpoint()
    found, _ = spectral(links, size, rounds)
    alone = F.array(*(F.lit(0.0) for _ in range(size)))
    of = rows.join(same, "vector").select("id", "key").join(found, "key", "left")
    return of.select(F.col("id").alias(key), F.coalesce("layout", alone).alias("layout"))
