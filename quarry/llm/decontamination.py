"""Operator 2. Benchmark decontamination by SimHash windows.

Each item has the SimHash of its word shingles, of 128 bits. In a text, the windows of an item's length (in words) are
considered that could reach the similarity at all: a window as similar as `SIMILARITY` shares at least
2s/(1+s) of its shingles with the item, so it must hold that many shingles that occur in some item of this
length; all other windows are ruled out by one running count. A text shorter than an item is one window, the
whole text, unless the two lengths rule the similarity out.

The windows' SimHashes are looked up in a multi-index of BLOCKS blocks of 16 bits. Two fingerprints within RADIUS = 31
bits differ by 3 bits at most in one of 8 blocks (or all would differ by 4, which makes 32), and by 4 at most in two of
them (or seven would differ by 5, which makes 35). Items that meet both are all items within the radius and about
2 % of the others; their full distance decides. Each block keeps its distinct values, 65,536 at most however many
items there are, and the items of each value. What is found is verified by the exact weighted Jaccard similarity of the
two shingle bags.

At similarity 0.8 the cosine of the bags is about 0.89, so 19 of 128 bits differ, with a deviation of 4: the radius
lies three deviations above, and more for higher similarities.

Items are sent to the workers in blocks of ITEM_BYTES of text at most, as flat arrays of about four times their size
that a worker reads once; more items take more passes over the texts.

Defined results: null or empty texts and items without a word match nothing; items or texts of fewer than
`shingle` words have one shingle, the whole sequence; very long texts are searched whole; ties take the earliest
window; repeated items and rows each match; an item without an id matches as any other, with a null item_id, and so does
a text without an id; empty tables give an empty table; other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import text_pieces

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, WIDTH = 31, 8, 16
#: Bits by which one block differs at most within the radius, and by which two do.
ONE, TWO = RADIUS // BLOCKS, RADIUS // (BLOCKS - 1)
ITEM_BYTES = 16 << 20
FILTER_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
MEMO_ENTRIES = 250_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_hashes = Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = words[: n - size + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out *= MIX
            out ^= out >> np.uint64(31)
            out += words[i : n - size + 1 + i]
        out *= MIX
        out ^= out >> np.uint64(29)
    return out


def simhash(hashes: np.ndarray) -> np.ndarray:
    """128 bits, as the values of BLOCKS blocks: the majority of the hashes' bits, then of those of a mixture."""
    with np.errstate(over="ignore"):
        more = (hashes ^ (hashes >> np.uint64(30))) * MIX
        more ^= more >> np.uint64(27)
    raw = np.stack((hashes, more), axis=1).view(np.uint8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u2")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags; `b` in order."""
    kinds, n = np.unique(a, return_counts=True)
    there = np.searchsorted(b, kinds, side="right") - np.searchsorted(b, kinds, side="left")
    common = int(np.minimum(n, there).sum())
    return common / (len(a) + len(b) - common)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of `x` are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


class Items:
    """Items of one length: ids, bags (one row of hashes each, in order), fingerprints, and the multi-index."""

    def __init__(self, ids: list[int | None], bags: list[np.ndarray]) -> None:
        self.ids, self.size = ids, len(bags[0])
        self.prints = np.stack([simhash(b) for b in bags])
        self.bags = np.sort(np.stack(bags), axis=1)
        self.need = self.common(self.size)
        #: Of each block: distinct values, where the items of each begin, and the items.
        self.index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(BLOCKS):
            order = np.argsort(self.prints[:, k], kind="stable").astype(np.int32)
            values, begin = np.unique(self.prints[order, k], return_index=True)
            self.index.append((values, np.append(begin, len(order)).astype(np.int32), order))

    def common(self, size: int) -> int:
        """Shingles that an item and a window of `size` shingles share at least if they are similar."""
        return int(np.ceil(round((self.size + size) * SIMILARITY / (1 + SIMILARITY), 9)))

    def candidates(self, fingerprint: np.ndarray) -> np.ndarray:
        """The items with a block within ONE bits, and two within TWO: among them all within the radius."""
        found, closest = [], []
        for (values, begin, order), value in zip(self.index, fingerprint, strict=True):
            far = np.bitwise_count(values ^ value)
            for at in np.nonzero(far <= TWO)[0].tolist():
                items = order[begin[at] : begin[at + 1]]
                found.append(items)
                closest.append(np.full(len(items), far[at] <= ONE))
        if not found:
            return np.zeros(0, dtype=np.int64)
        items, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        return items[(n > 1) & (np.bincount(at, weights=np.concatenate(closest)) > 0)].astype(np.int64)

    def near(self, fingerprint: np.ndarray) -> np.ndarray:
        """All items within RADIUS bits."""
        at = self.candidates(fingerprint)
        return at[np.bitwise_count(self.prints[at] ^ fingerprint).sum(axis=1) <= RADIUS]


class Benchmark:
    def __init__(self, rows: list[tuple[int, str]]) -> None:
        groups: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in rows:
            words = word_hashes(text)
            if len(words):
                groups[len(words)].append((item, shingles(words)))
        self.items = {n: Items([i for i, _ in g], [b for _, b in g]) for n, g in sorted(groups.items())}
        self.short = {n for n in self.items if n < SHINGLE}
        long = [b for n, g in groups.items() if n >= SHINGLE for _, b in g]
        self.all = np.unique(np.concatenate(long)) if long else np.zeros(0, dtype=np.uint64)
        #: Whether any item's shingle begins with these bits.
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.all >> np.uint64(64 - FILTER_BITS)] = True
        self.own = {n: np.unique(np.concatenate([b for _, b in groups[n]])) for n in groups}

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that a text holds."""
        words = word_hashes(text)
        if not len(words):
            return []
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        runs = shingles(words) if len(words) >= SHINGLE else words[:0]
        maybe = np.nonzero(self.filter[runs >> np.uint64(64 - FILTER_BITS)])[0]
        hits = maybe[member(runs[maybe], self.all)]
        for n, items in self.items.items():
            if n in self.short:
                if len(words) < n:
                    continue
                grams = shingles(words, n)
                starts = np.nonzero(member(grams, self.own[n]))[0]
            elif len(words) < n:
                need = items.common(len(runs))
                if need > len(hits) or member(runs[hits], self.own[n]).sum() < need:
                    continue
                starts = np.zeros(1, dtype=np.int64)
            else:
                if len(hits) < items.need:
                    continue
                mine = hits[member(runs[hits], self.own[n])]
                if len(mine) < items.need:
                    continue
                # Windows [s, s + size) of shingles with at least `need` hits: s lies between the last of the
                # `need` hits less the size, and the first of them.
                first, last = mine[: len(mine) - items.need + 1], mine[items.need - 1 :]
                lo, hi = np.maximum(last - items.size + 1, 0), np.minimum(first, len(runs) - items.size)
                spans = [np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist()) if a <= b]
                starts = np.unique(np.concatenate(spans)) if spans else mine[:0]
            for s in starts.tolist():
                bag = grams[s : s + 1] if n in self.short else runs[s : s + items.size]
                for i in items.near(simhash(bag)).tolist():
                    similarity = weighted_jaccard(bag, items.bags[i])
                    if similarity >= SIMILARITY and similarity > best.get((n, i), (0.0,))[0]:
                        best[n, i] = (similarity, s, min(n, len(words)))
        return [(self.items[n].ids[i], *found) for (n, i), found in sorted(best.items())]


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The items in parts that are small enough to be sent to every worker."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows for b in range(n)]


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each item that a row's text holds, by its best window."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, passes = df.sparkSession, []
    for block in item_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute  # noqa: F401

            benchmark = shared.value  # read once by a worker, and kept for its next tasks
            for batch in batches:
                for start, texts in text_pieces(batch, 1):
                    ids = batch.column(0).slice(start, len(texts)).to_pylist()
                    rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in benchmark.matches(t)]
                    columns = list(zip(*rows)) if rows else [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        passes.append(source.mapInArrow(run, MATCHES))
    if not passes:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, passes)
