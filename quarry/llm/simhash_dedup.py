"""Operator 6. SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles: numpy exclusive-or and bit counts over all pairs of two tiles, tile pairs
whose population counts differ by more than the radius are never formed. So that the number of tile pairs does
not grow with the square of the corpus, tiles hold fingerprints that agree in some of their bits: cut into
radius + k blocks, two fingerprints within the radius agree in k blocks at least, so each choice of k blocks is a band
and no link is lost. The more fingerprints there are, the larger k is taken (4 bands of 16 bits, then 10 of 25, 20 of
32, 35 of 36), so that the fingerprints of a band value stay few on average; the links are the same for every k. A
band value that many fingerprints share nevertheless is cut into several tiles, and its tile pairs go to different
tasks.

Equal fingerprints are one node. A tile pair returns a spanning forest of its links, not the links, so that a
group of copies yields no square of rows.

Defined results: a null or empty text (no words) has fingerprint zero and links like any other; very long texts are
hashed whole, in blocks; ties take the smallest doc_id; a null id is no candidate for a component's id (null if there is
no other); rows repeated with the same id each give a row; an empty table gives an empty table; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_texts
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints of a band value and population count that one tile holds at most, on average.
TILE = 4096
#: Rows of bands in a partition, on average.
PARTITION_ROWS = 4 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    total = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    for i in range(0, n, 1 << 16):
        octets = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); map tasks only."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(df, id_col, text_col, "fp long", make)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of links between numbers: (node, root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := find(x)) != x]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius of two sorted tiles of uint64, each pair once if the tiles are the same."""
    found_a, found_b, same = [], [], left is right
    pop_l, pop_r = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    order = np.argsort(pop_r, kind="stable")
    right_by_pop, pops = right[order], pop_r[order]
    for pop in np.unique(pop_l):
        rows = left[pop_l == pop]
        lo, hi = np.searchsorted(pops, pop - radius), np.searchsorted(pops, pop + radius, side="right")
        near = right_by_pop[lo:hi]
        if not len(near):
            continue
        step = max(1, (1 << 20) // len(near))
        for i in range(0, len(rows), step):
            block = rows[i : i + step]
            hit = np.bitwise_count(block[:, None] ^ near[None, :]) <= radius
            x, y = np.nonzero(hit)
            x, y = block[x], near[y]
            keep = x < y if same else x != y
            if keep.any():
                f = np.array(forest(x[keep], y[keep]), dtype=np.uint64)
                found_a.append(f[:, 0])
                found_b.append(f[:, 1])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def small_tile_links(task: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small tiles at once, each compared with itself. Rows are ordered by tile and population
    count, and each meets the one d places on, d = 1, 2, ..., until its tile ends or the counts differ too much."""
    pop = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((fps, pop, task))
    task, fps, pop = task[order], fps[order], pop[order]
    at, d, found_a, found_b = np.arange(len(task)), 1, [], []
    while True:
        at = at[at + d < len(task)]
        at = at[(task[at + d] == task[at]) & (pop[at + d] - pop[at] <= radius)]
        if not len(at):
            break
        x, y = fps[at], fps[at + d]
        hit = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        found_a.append(x[hit])
        found_b.append(y[hit])
        d += 1
    none = np.zeros(0, dtype=np.uint64)
    a = np.concatenate(found_a) if found_a else none
    b = np.concatenate(found_b) if found_b else none
    if not len(a):
        return none, none
    f = np.array(forest(a, b), dtype=np.uint64).reshape(-1, 2)
    return f[:, 0], f[:, 1]


#: Up to this size, tiles are compared together with others.
SMALL = 256


def _compare(radius: int):
    """Over rows (task, side, fp) sorted by task: the forests of the tile pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the tile pair that may go on in the next batch
        current = None

        def close(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate(parts)
            left, right = np.unique(both["fp"][both["side"] != 1]), np.unique(both["fp"][both["side"] != 0])
            if (both["side"] == 2).all():
                return tile_links(left, left, radius)
            return tile_links(left, right, radius)

        def out(pairs: list) -> pa.RecordBatch:
            a = np.concatenate([p[0] for p in pairs]).view(np.int64)
            b = np.concatenate([p[1] for p in pairs]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            task = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.empty(len(task), dtype=[("side", "i4"), ("fp", "u8")])
            rows["side"] = batch.column(1).to_numpy(zero_copy_only=False)
            rows["fp"] = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.nonzero(task[1:] != task[:-1])[0] + 1).tolist(), len(task)]
            pairs, few = [], np.zeros(len(task), dtype=bool)
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and task[lo] != current:
                    if sum(map(len, held)) > 1:
                        pairs.append(close(held))
                    held = []
                if not held and hi - lo <= SMALL and hi < len(task) and (rows["side"][lo:hi] == 2).all():
                    few[lo:hi] = True  # it ends in this batch
                else:
                    current = task[lo]
                    held.append(rows[lo:hi])
            if few.any():
                pairs.append(small_tile_links(task[few], rows["fp"][few], radius))
            if pairs:
                yield out(pairs)
        if sum(map(len, held)) > 1:
            yield out([close(held)])

    return run


#: Blocks that agree in a band, at most.
MOST_BLOCKS = 4


def blocks_for(n: int, tile: int = TILE, radius: int = RADIUS) -> int:
    """How many blocks a band takes, so that a band value has no more than a tile of n fingerprints on average."""
    k = 1
    while k < MOST_BLOCKS and n >> (64 * k // (radius + k)) > tile:
        k += 1
    return k


def band_masks(k: int, radius: int = RADIUS) -> list[int]:
    """The bits of each band, as signed longs: all choices of k of radius + k blocks."""
    edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    sums = (sum(block[i] for i in chosen) for chosen in combinations(range(radius + k), k))
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints `fp`: forests of all links within the radius."""
    n = prints.count()
    masks = band_masks(blocks or blocks_for(n, tile, radius), radius)
    key = [F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks]
    lanes = prints.select(
        "fp",
        F.bit_count("fp").cast("int").alias("pop"),
        F.posexplode(F.array(*key)).alias("band", "value"),
    )
    sizes = lanes.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    # Only band values with another fingerprint near in population count can hold a link.
    about = sizes.groupBy("band", "value").agg(
        F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("by_pop")
    )
    about = about.where(F.col("all") > 1)
    joined = lanes.join(about, ["band", "value"])
    # Tiles of a large band value: one population count each, cut by hash into as many as its size asks for.
    cut = lambda pop: F.ceil(F.coalesce(F.try_element_at("by_pop", pop), F.lit(0)) / tile).cast("int")
    small = joined.where(F.col("all") <= tile).select(
        F.xxhash64("band", "value").alias("task"), F.lit(2).alias("side"), "fp"
    )
    own = F.pmod(F.xxhash64("fp"), F.greatest(cut(F.col("pop")), F.lit(1))).cast("int")
    large = joined.where(F.col("all") > tile).withColumn("own", own)
    near = F.flatten(
        F.transform(
            F.sequence(F.col("pop") - radius, F.col("pop") + radius),
            lambda p: F.when(
                cut(p) > 0, F.transform(F.sequence(F.lit(0), cut(p) - 1), lambda t: F.struct(p.alias("p"), t.alias("t")))
            ).otherwise(F.array().cast("array<struct<p:int,t:int>>")),
        )
    )
    mine = F.struct(F.col("pop").alias("p"), F.col("own").alias("t"))
    spread = large.withColumn("other", F.explode(near)).withColumn("mine", mine)
    spread = spread.select(
        F.xxhash64("band", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "fp",
    )
    tasks = small.unionByName(spread)
    fewest = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tasks.repartition(max(fewest, n * len(masks) // PARTITION_ROWS), "task").sortWithinPartitions("task")
    return placed.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `df`."""
    ensure_checkpoint_dir(df.sparkSession)
    prints = fingerprints(df, id_col, text_col).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = links(nodes.select("fp"), radius, tile).distinct()
    roots = components(found).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A component's id is the smallest doc_id of its fingerprints. Fingerprints without a link keep their own.
    least = joined.where(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("first").alias("low"))
    heads = joined.join(least, "root", "left")
    ids = heads.where(F.col("root") == F.col("fp")).select(
        F.col("fp").alias("root"), F.coalesce(F.least("first", "low"), "first").alias("component_id")
    )
    named = joined.select("fp", "root").join(ids, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
