"""Operator 10. Removal of repeated passages by external induced sorting of suffixes.

Each window of WINDOW bytes has an anchor: the k-mer in it with the least hash, leftmost among equals. Equal
windows have equal anchors, so windows that belong together meet if texts are cut into runs of windows with one
anchor, and these are dealt to shards by the anchor's hash, mixed again (least hashes alone crowd at the low end).
The steps, all of them shuffles of packed arrays:

1. each split of texts reports the anchors it holds, and a shard's bucket answers which occur in more than one
   document (a filter only: nothing else can hold a repeated window) and which occur very often;
2. a split sends each distinct run of those to its shard once, with the smallest id that holds it in this split;
   what the split needs later to apply the answer travels past the shards;
3. a shard folds equal runs, then sorts the suffixes of all runs whose anchor has several forms, and of all hot
   windows, by external induced sorting (`induced`): suffix tuples and their common-prefix values go through queues
   on disk, and neighbours whose common prefix reaches WINDOW are one string, which its smallest document keeps;
4. a split marks the bytes of the windows to be removed and cuts them out.

Sizes. A split holds SPLIT_BYTES of text, and a shard the runs of about SHARD_BYTES of it, on average. Of
a sort the queues go to disk beyond MEMORY bytes, as do texts and types; but other arrays (the stars' places, names and
prefixes, the runs' bytes, flags and ids) stay in memory, some 36 bytes for a byte of a shard, so it is small shards that bound
memory. Equal runs are folded before the sort, and a run of an anchor with one form is decided by the fold alone, without
the sort. Nothing is sent for a pair of split and shard that have nothing in common, so there are never more rows than
anchors. An anchor that occurs HOT_RUNS times or more (the edge of a line that a third of all documents share, say)
would make one shard large: its runs are cut into single windows, dealt by the hash of the whole window, which equal
windows share as well, to shards that sort them like any other.

Defined results: a null or empty text has no bytes; texts shorter than WINDOW lose nothing, very long ones are
read whole; only documents of a smaller id count, so rows that repeat an id keep what they share; a null id counts as
greater than all others; an empty table gives an empty table; other columns of the input are not looked at. Removal
is by bytes: a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bucket_bounds, dealt_rows, pack, parted, releasing, rows_of_split, unpack
from .induced import MEMORY, repeated_windows

WINDOW, KMER, BLOCK = 50, 20, 1 << 15
SPLIT_BYTES, SHARD_BYTES, HOT_RUNS = 8 << 20, 8 << 20, 1 << 16
#: The id of rows without one.
LAST = np.iinfo(np.int64).max
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= C[1]
        h ^= h >> np.uint64(29)
        return h


def kmer_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes at each place, by joining hashes of 1, 2, 4, 8, 16 and then 16 + 4 bytes."""
    with np.errstate(over="ignore"):
        x = (raw.astype(np.uint64) + np.uint64(1)) * C[4]
        x2 = x[:-1] * C[0] + x[1:]
        x4 = x2[:-2] * C[1] + x2[2:]
        x8 = x4[:-4] * C[2] + x4[4:]
        x16 = x8[:-8] * C[3] + x8[8:]
        return mixed(x16[:-4] * C[0] + x4[16:])


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the ranges."""
    lengths = lengths.astype(np.int64)
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class Texts:
    """The texts of a split, end to end in order of id, and their runs of windows with one anchor."""

    def __init__(self, table: pa.Table) -> None:
        table = rows_of_split(table).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table = table
        self.ids = table.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
        parts = [x.encode() for x in table.column("text").to_pylist()]
        self.data = b"".join(parts)
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)

    def runs(self) -> None:
        """start, windows, key (hash of the anchor) and row of each run."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        reach = WINDOW - KMER + 1  # k-mers of a window
        fits = np.ones(len(raw), dtype=bool)
        for a, b in zip((self.ends - self.sizes).tolist(), self.ends.tolist()):
            fits[max(a, b - WINDOW + 1) : b] = False
        starts, counts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        low = np.uint32((1 << 16) - 1)
        numbers = np.arange(BLOCK + WINDOW, dtype=np.uint32)
        for at in range(0, max(len(raw) - WINDOW + 1, 0), BLOCK):
            h = kmer_hashes(raw[at : at + BLOCK + WINDOW - 1])
            least = ((h >> np.uint64(32)).astype(np.uint32) & ~low) | numbers[: len(h)]
            width = 1
            while 2 * width <= reach:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < reach:
                least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
            anchor = least & low
            fit = fits[at : at + len(anchor)]
            head = np.append(0, np.nonzero((anchor[1:] != anchor[:-1]) | (fit[1:] != fit[:-1]))[0] + 1)
            count = np.diff(np.append(head, len(anchor)))
            keep = fit[head]
            head, count = head[keep], count[keep]
            starts.append(head + at)
            counts.append(count)
            keys.append(h[anchor[head]])
        self.start, self.windows = np.concatenate(starts), np.concatenate(counts)
        with np.errstate(over="ignore"):
            self.key = mixed(np.concatenate(keys) * C[2])
        # Two runs of one anchor can touch where texts meet; they then are in different rows.
        self.row = np.searchsorted(self.ends, self.start, side="right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortened keys in order; of each 0 if one id has it alone, else the bits of the number of its runs; each run's number."""
        short, at, runs = np.unique(self.key >> np.uint64(16), return_inverse=True, return_counts=True)
        low, high = np.full(len(short), LAST), np.zeros(len(short), np.int64)
        if len(at):
            order = np.argsort(at, kind="stable")  # in order of the text, hence of the id
            last = np.cumsum(runs) - 1
            low, high = self.ids[self.row[order[last - runs + 1]]], self.ids[self.row[order[last]]]
        several = low < high
        return short, np.where(several, np.frexp(runs.astype(np.float64))[1], 0).astype("u1"), at

    def single_windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of some runs, and keys that tell whole windows apart."""
        at = spans(self.start[chosen], self.windows[chosen])
        raw, key = np.frombuffer(self.data, dtype=np.uint8), np.empty(len(at), np.uint64)
        step = (WINDOW - KMER) // 2
        with np.errstate(over="ignore"):
            for a in range(0, len(at), BLOCK):
                rows = raw[at[a : a + BLOCK, None] + np.arange(WINDOW)]
                h = kmer_hashes(np.append(rows.ravel(), np.zeros(KMER, np.uint8)))
                one = np.arange(len(rows)) * WINDOW
                key[a : a + BLOCK] = mixed((h[one] * C[2] + h[one + step]) * C[3] + h[one + 2 * step])
        return at, key


def _blobs(a: str, x, b: str, y, data: list[bytes]) -> pa.Table:
    return pa.table({a: pa.array(list(x), pa.int32()), b: pa.array(list(y), pa.int32()), "data": pa.array(data, pa.binary())})


def _report(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts = Texts(table)
        texts.runs()
        keys, several, _ = texts.anchors()
        cuts = bucket_bounds(keys << np.uint64(16), buckets)
        full = np.nonzero(np.diff(cuts))[0].tolist()
        data = []
        for b in full:
            own = keys[cuts[b] : cuts[b + 1]]
            data.append(pack((own >> np.uint64(16)).astype("<u4"), (own & np.uint64(0xFFFF)).astype("<u2"), several[cuts[b] : cuts[b + 1]]))
        return _blobs("bucket", full, "split", [key[0].as_py()] * len(full), data)

    return run


def _which_repeat(hot_runs: int):
    """For each split's keys whether they are in several documents, and whether they are hot."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, several = [], []
        for x in table.column("data"):
            high, low, bits = unpack(x.as_py(), "<u4", "<u2", "u1")
            keys.append(high.astype(np.uint64) << np.uint64(16) | low)
            several.append(bits)
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        bits = np.concatenate(several)
        # In two splits: of two rows, though they may repeat one id; no harm, as this is a filter.
        repeated = (n > 1) | (np.bincount(at, weights=bits, minlength=len(n)) > 0)
        runs = np.bincount(at, weights=np.where(bits, 0.75 * 2.0**bits, 1.0), minlength=len(n))
        hot = repeated & (runs >= hot_runs)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        replies = [pack(np.packbits(p), np.packbits(q), np.array([len(p)])) for p, q in zip(np.split(repeated[at], cuts), np.split(hot[at], cuts))]
        return _blobs("split", table.column("split").to_pylist(), "bucket", [key[0].as_py()] * len(replies), replies)

    return run


def _send(buckets: int):
    """The distinct runs of repeated anchors to their shards, and where they are to the split itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _blobs("bucket", [], "split", [], [])
        split = left.column("split")[0].as_py()
        texts = Texts(left)
        texts.runs()
        keys, _, at = texts.anchors()
        repeated, hot = [np.zeros(0, bool)], [np.zeros(0, bool)]
        for x in right.sort_by("bucket").column("data"):
            p, q, n = unpack(x.as_py(), "u1", "u1", "<i8")
            repeated.append(np.unpackbits(p, count=int(n[0])).astype(bool))
            hot.append(np.unpackbits(q, count=int(n[0])).astype(bool))
        repeated, hot = np.concatenate(repeated), np.concatenate(hot)
        if len(repeated) != len(keys):
            raise ValueError("answers and anchors of a split differ")
        whole, cut = np.nonzero((repeated & ~hot)[at])[0], np.nonzero(hot[at])[0]
        single, single_key = texts.single_windows(cut)
        start = np.concatenate((texts.start[whole], single))
        windows = np.concatenate((texts.windows[whole], np.ones(len(single), np.int64)))
        key = np.concatenate((texts.key[whole], single_key))
        hot_run = np.arange(len(start)) >= len(whole)
        if len(single):
            order = np.argsort(start, kind="stable")
            start, windows, key, hot_run = start[order], windows[order], key[order], hot_run[order]
        data = texts.data
        del keys, at, repeated, hot, whole, single, single_key
        strings = pa.array([data[a:b] for a, b in zip(start.tolist(), (start + windows + WINDOW - 1).tolist())], pa.binary())
        coded = strings.dictionary_encode()
        del strings
        code, count = coded.indices.to_numpy(), len(coded.dictionary)
        # Runs are in order of id, so a string's first run has its smallest id.
        first = np.empty(count, dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        ids = texts.ids[np.searchsorted(texts.ends, start, side="right")]
        least = ids[first]
        # Strings in order of their keys are cut into the shards' parts.
        by_key = np.argsort(key[first], kind="stable")
        number = np.empty(count, dtype=np.int64)
        number[by_key] = np.arange(count)
        chosen, width = coded.dictionary.take(pa.array(by_key)), windows[first][by_key].astype("u1")
        cuts = bucket_bounds(key[first][by_key], buckets)
        group = ((key[first][by_key] >> np.uint64(34)) & np.uint64(0xFFFFFF)).astype("<u4")
        group[hot_run[first][by_key]] = 0
        own = pack(np.diff(start, prepend=0).astype("<u4"), number[code].astype("<u4"), np.packbits(ids > least[code]), width)
        out_data, out_bucket = [own], [buckets + split]
        for b in np.nonzero(np.diff(cuts))[0].tolist():
            lo, hi = cuts[b], cuts[b + 1]
            joined = b"".join(chosen.slice(lo, hi - lo).to_pylist())
            codes = group[lo:hi]
            out_data.append(pack(np.frombuffer(joined, np.uint8), width[lo:hi], least[by_key[lo:hi]], (codes >> 8).astype("<u2"), codes.astype("u1")))
            out_bucket.append(b)
        return _blobs("bucket", out_bucket, "split", [split] * len(out_data), out_data)

    return run


def _sort(buckets: int, memory: int):
    """Of each string that a split sent, which windows a lesser document has: all, or a bit for each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, splits = key[0].as_py(), table.column("split").to_pylist()
        if bucket >= buckets:  # what a split sent itself
            return _blobs("split", splits, "bucket", [bucket] * table.num_rows, table.column("data").to_pylist())
        asked = [unpack(x.as_py(), "u1", "u1", "<i8", "<u2", "u1") for x in table.column("data")]
        counts = [len(a[1]) for a in asked]
        length = np.concatenate([a[1] for a in asked]).astype(np.int64) + WINDOW - 1
        ids = np.concatenate([a[2] for a in asked])
        group = np.concatenate([a[3] for a in asked]).astype(np.uint32) << 8 | np.concatenate([a[4] for a in asked])
        offsets = np.concatenate(([0], np.cumsum(length)))
        data = b"".join([a[0] for a in asked])
        del asked
        strings = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = strings.dictionary_encode()
        del strings, data
        code, count = coded.indices.to_numpy(), len(coded.dictionary)
        least = np.full(count, LAST)
        np.minimum.at(least, code, ids)
        size = np.zeros(count, dtype=np.int64)
        size[code] = length
        # A run whose anchor has no other form has nothing to be compared with. (Groups are shortened hashes: now and
        # then two anchors share one, and their runs are sorted for nothing.)
        of_string = np.zeros(count, dtype=np.uint32)
        of_string[code] = group
        _, at, forms = np.unique(of_string, return_inverse=True, return_counts=True)
        compared = np.nonzero((forms[at] > 1) | (of_string == 0))[0]
        distinct = b"".join(coded.dictionary.take(pa.array(compared)).to_pylist())
        del coded, group, of_string, at
        flags = repeated_windows(distinct, size[compared], least[compared], WINDOW, memory)
        del distinct
        begin, some = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=bool)
        begin[compared] = np.cumsum(size[compared]) - size[compared]
        if len(compared):
            some[compared] = np.add.reduceat(flags, begin[compared], dtype=np.int64) > 0
        out, base = [], 0
        for n in counts:
            c, mine = code[base : base + n], ids[base : base + n]
            base += n
            whole = mine > least[c]
            part = np.nonzero(~whole & some[c])[0]
            bits = flags[spans(begin[c[part]], size[c[part]] - WINDOW + 1)]
            out.append(pack(np.packbits(whole), part.astype("<u4"), np.packbits(bits), np.array([n, len(bits)])))
        return _blobs("split", splits, "bucket", [bucket] * len(out), out)

    return run


def _cut(buckets: int, digest: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left)
        right = right.sort_by("bucket")
        blobs, owners = right.column("data"), right.column("bucket").to_pylist()
        gone = np.zeros(len(texts.data), dtype=bool)
        if owners:
            if owners[-1] < buckets:
                raise ValueError("a split's own places are missing")
            step, number, covered, width = unpack(blobs[len(owners) - 1].as_py(), "<u4", "<u4", "u1", "u1")
            start, covered = np.cumsum(step.astype(np.int64)), np.unpackbits(covered, count=len(number)).astype(bool)
            width = width.astype(np.int64)
            wholes, parts, bits, base = [np.zeros(0, bool)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], 0
            for x in blobs[: len(owners) - 1]:
                w, p, f, n = unpack(x.as_py(), "u1", "<u4", "u1", "<i8")
                wholes.append(np.unpackbits(w, count=int(n[0])).astype(bool))
                parts.append(p.astype(np.int64) + base)
                bits.append(np.unpackbits(f, count=int(n[1])).astype(bool))
                base += int(n[0])
            if base != len(width):
                raise ValueError("answers and strings of a split differ")
            whole, part, bits = np.concatenate(wholes), np.concatenate(parts), np.concatenate(bits)
            change = np.zeros(len(texts.data) + 1, dtype=np.int16)
            every = covered | whole[number] if len(number) else covered
            np.add.at(change, start[every], 1)
            np.add.at(change, start[every] + width[number[every]] + WINDOW - 1, -1)
            if len(part):
                where = np.full(len(width), -1, dtype=np.int64)
                where[part] = np.cumsum(width[part]) - width[part]
                runs = np.nonzero(~every & (where[number] >= 0))[0]
                size = width[number[runs]]
                at = spans(start[runs], size)[bits[spans(where[number[runs]], size)]]
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
            gone = np.cumsum(change[:-1], dtype=np.int16) > 0
            del change
        raw = np.frombuffer(texts.data, dtype=np.uint8)
        removed, found, kept = [], [], []
        for a, b in zip((texts.ends - texts.sizes).tolist(), texts.ends.tolist()):
            g = gone[a:b]
            n = int(np.count_nonzero(g))
            removed.append(n)
            found.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0)
            rest = raw[a:b][~g].tobytes() if n else texts.data[a:b]
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "ignore"))
        if not digest:
            return pa.table({"row": texts.table.column("row"), "text": pa.array(kept, pa.string())})
        return pa.table(
            {
                "doc_id": texts.table.column("doc_id"),
                "n_bytes": pa.array(texts.sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(found, pa.int64()),
                "kept_sha256": pa.array(kept, pa.string()),
            }
        )

    return run


def _passages(df: DataFrame, id_col: str, text_col: str, digest: bool, split_bytes: int, shard_bytes: int, hot_runs: int, memory: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [] if digest else [F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row")]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *row)
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits, buckets = max(fewest, -(-size // split_bytes)), max(fewest, -(-size // shard_bytes))
    dealt = parted(dealt_rows(source, splits), "split", splits, fewest)
    to_bucket, to_split = "bucket int, split int, data binary", "split int, bucket int, data binary"
    texts = dealt.groupBy("split")
    report, which, send, sort, cut = map(releasing, (_report(buckets), _which_repeat(hot_runs), _send(buckets), _sort(buckets, memory), _cut(buckets, digest)))
    reports = texts.applyInArrow(lambda key, table: report(key, table), to_bucket)
    answers = parted(reports, "bucket", buckets, fewest).groupBy("bucket").applyInArrow(lambda key, table: which(key, table), to_split)
    answers = parted(answers, "split", splits, fewest)
    sent = texts.cogroup(answers.groupBy("split")).applyInArrow(lambda left, right: send(left, right), to_bucket)
    # Shards and what splits sent themselves.
    sent = parted(sent, "bucket", buckets + splits, fewest)
    replies = parted(sent.groupBy("bucket").applyInArrow(lambda key, table: sort(key, table), to_split), "split", splits, fewest)
    if digest:
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        schema = StructType([source.schema["row"], StructField("text", StringType())])
    return texts.cogroup(replies.groupBy("split")).applyInArrow(lambda left, right: cut(left, right), schema)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_bytes: int = SPLIT_BYTES, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS, memory: int = MEMORY
) -> DataFrame:
    """The rows of `df` with their remaining text; what a cut leaves of a split character is dropped."""
    cut = _passages(df, id_col, text_col, False, split_bytes, shard_bytes, hot_runs, memory)
    return cut.select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in df.columns))


def repeat_digest(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_bytes: int = SPLIT_BYTES, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS, memory: int = MEMORY
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) for each row."""
    return _passages(df, id_col, text_col, True, split_bytes, shard_bytes, hot_runs, memory)
