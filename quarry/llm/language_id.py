"""Operator 7. Language identification, words first.

A known word adds its log frequency in each language. An unseen word is read from left to right by the longest
known character n-gram, falling back to shorter ones down to single characters. Frequencies are counted over
all training texts, for all words, n-grams and languages.

Nothing of the tables is collected or broadcast. They lie in buckets, by hash of the word or n-gram, as packed
rows. Texts are read in chunks; a chunk asks the buckets for its own words, then for the n-grams of those words
that no training text has, and is scored from the answers, one language at a time. Only the names and totals of
languages are on the driver and in each task.

Defined results: `und` with score 0 for a null text, a text without a letter, or if nothing was learned; ties
take the first language in order of name; very long texts are read whole; repeated rows each give a row; a null id is
kept; an empty table gives an empty table;
other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, pack, text_pieces, unpack

#: The longest n-gram; bytes of training text for each bucket, on average; letters of text in a chunk.
LONGEST, BUCKET_BYTES, CHUNK_LETTERS = 5, 64 << 20, 16 << 20
COUNT_ENTRIES = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
ROW = "kind int, key long, other long, data binary"
DOCS, ASKED, TABLE, ANSWER, UNSEEN = range(5)


def normal_words(part: str) -> list[str]:
    return LETTERS.findall(part.lower())


def grams_of(word: str) -> Iterator[str]:
    padded = f"<{word}>"
    for size in range(1, LONGEST + 1):
        for i in range(len(padded) - size + 1):
            yield padded[i : i + size]


def bucket_of(key: str, buckets: int) -> int:
    return crc32(key.encode()) % buckets


def squeeze(*arrays: np.ndarray) -> bytes:
    raw = pack(*arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *types: str) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    return unpack(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), *types)


def joined(keys: Iterable[str]) -> np.ndarray:
    return np.frombuffer("\n".join(keys).encode(), "u1")


def parted(data: np.ndarray) -> list[str]:
    return data.tobytes().decode().split("\n") if len(data) else []


def packed_counts(keys: list[str], langs: list[str], at: np.ndarray, n: np.ndarray) -> bytes:
    """One entry for each key and language; `at` are numbers in `langs`."""
    used, at = np.unique(at, return_inverse=True)
    names = np.frombuffer(json.dumps([langs[i] for i in used]).encode(), "u1")
    return squeeze(names, joined(keys), at.astype("<u4"), n.astype("<i8"))


def counts_of(data: bytes) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    names, keys, at, n = unsqueeze(data, "u1", "u1", "<u4", "<i8")
    return parted(keys), json.loads(names.tobytes()), at, n


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds, keys, others, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    arrays = [pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "key", "other", "data"])


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows_of(rows)])


def dealt(counts: dict[str, Counter], buckets: int) -> pa.RecordBatch:
    """Counts of keys by language, as a packed row for each bucket."""
    langs = list(counts)
    parts: dict[int, tuple[list, list, list]] = {}
    for i, lang in enumerate(langs):
        for key, n in counts[lang].items():
            part = parts.setdefault(bucket_of(key, buckets), ([], [], []))
            part[0].append(key)
            part[1].append(i)
            part[2].append(n)
    counts.clear()
    return rows_of([(TABLE, b, 0, packed_counts(k, langs, np.array(at), np.array(n))) for b, (k, at, n) in parts.items()])


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        parts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            counts: dict[str, Counter] = {}
            for lang, found in parts.items():
                words = counts[lang] = Counter()
                for part, n in found.items():
                    for word in normal_words(part):
                        words[word] += n
            parts.clear()
            return dealt(counts, buckets)

        for batch in batches:
            for start, texts in text_pieces(batch, 1):
                for text, lang in zip(texts, batch.column(0).slice(start, len(texts)).to_pylist(), strict=True):
                    parts.setdefault(lang, Counter()).update(text.split())
                if sum(map(len, parts.values())) > COUNT_ENTRIES:
                    yield out()
        if parts:
            yield out()

    return run


def _count_grams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for data in batch.column("data"):
                words, langs, at, n = counts_of(data.as_py())
                for k, (word, i, times) in enumerate(zip(words, at.tolist(), n.tolist(), strict=True)):
                    found = counts.setdefault(langs[i], Counter())
                    for gram in grams_of(word):
                        found[gram] += times
                    if k % 1000 == 0 and sum(map(len, counts.values())) > COUNT_ENTRIES:
                        yield dealt(counts, buckets)
        if counts:
            yield dealt(counts, buckets)

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """All counts of a bucket, in order of the key."""
    counts: dict[tuple[str, str], int] = {}
    for data in table.column("data"):
        keys, langs, at, n = counts_of(data.as_py())
        for k, i, times in zip(keys, at.tolist(), n.tolist(), strict=True):
            pair = (k, langs[i])
            counts[pair] = counts.get(pair, 0) + times
    pairs = sorted(counts)
    langs = sorted({p[1] for p in pairs})
    number = {x: i for i, x in enumerate(langs)}
    at, n = np.array([number[p[1]] for p in pairs]), np.array([counts[p] for p in pairs])
    return table_of([(TABLE, key[0].as_py(), 0, packed_counts([p[0] for p in pairs], langs, at, n))])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counts by language, and the number of keys (in a row without a language)."""
    for batch in batches:
        for data in batch.column("data"):
            keys, langs, at, n = counts_of(data.as_py())
            sums = np.zeros(len(langs), dtype=np.int64)
            np.add.at(sums, at, n)
            arrays = [pa.array([*langs, None], pa.string()), pa.array([*sums.tolist(), len(set(keys))], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "n"])


@dataclass
class Model:
    """Counts by language of words and n-grams, in buckets, and their totals."""

    languages: list[str]
    buckets: int
    words: DataFrame
    grams: DataFrame
    word_scale: np.ndarray
    gram_scale: np.ndarray


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all rows of `df` with a language."""
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ensure_checkpoint_dir(df.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    merged = lambda counts: counts.groupBy("key").applyInArrow(_merged, ROW).checkpoint()
    words = merged(rows.mapInArrow(_count_words(buckets), ROW))
    grams = merged(words.mapInArrow(_count_grams(buckets), ROW))
    of = lambda t: {r.lang: r.n for r in t.mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    word_total, gram_total = of(words), of(grams)
    languages = sorted(x for x in word_total if x is not None)
    scale = lambda t: np.log(np.array([t[x] for x in languages], dtype=np.float64) + 0.1 * (t.get(None, 0) + 1))
    return Model(languages, buckets, words, grams, scale(word_total), scale(gram_total))


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Chunk:
    """Some texts as counts of their parts between blanks; parts as numbers of words."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.parts, self.texts, self.letters = Numbers(), [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.ids.append(doc_id)
        pieces = text.split()
        found, times = np.unique(np.fromiter(map(self.parts.__getitem__, pieces), np.uint32, len(pieces)), return_counts=True)
        self.texts.append((found, times.astype(np.uint32)))
        self.letters += len(text) + 64

    def rows(self, split: int, buckets: int) -> list[tuple]:
        number = Numbers()
        lists = [[number[w] for w in normal_words(p)] for p in self.parts]
        bucket = np.fromiter((bucket_of(w, buckets) for w in number), np.int64, len(number))
        order = np.argsort(bucket, kind="stable")
        renumber = np.empty(len(number), dtype=np.uint32)
        renumber[order] = np.arange(len(number), dtype=np.uint32)
        words = list(number)
        alpha = np.fromiter((any(map(str.isalpha, p)) for p in self.parts), np.uint8, len(self.parts))
        in_part = np.fromiter(map(len, lists), np.uint32, len(lists))
        of_part = renumber[np.fromiter((w for x in lists for w in x), np.int64)]
        in_text = np.fromiter((len(x[0]) for x in self.texts), np.uint32, len(self.texts))
        part, times = np.concatenate([x[0] for x in self.texts]), np.concatenate([x[1] for x in self.texts])
        # Differences by bytes of the same weight, which compress well; they wrap around from text to text.
        planes = lambda a: a.astype("<u4").view("u1").reshape(-1, 4).T.ravel()
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        nulls = np.array([x is None for x in self.ids], dtype="u1")
        steps = np.diff(part, prepend=np.uint32(0))
        out = [(DOCS, split, 0, squeeze(ids, nulls, alpha, in_part, of_part, in_text, planes(steps), planes(times)))]
        for b, own in zip(*grouped(bucket[order], order), strict=True):
            out.append((ASKED, b, split, squeeze(joined(words[i] for i in own))))
        return out


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """The distinct keys of an ordered array, and the values of each."""
    distinct, starts = np.unique(keys, return_index=True)
    return distinct.tolist(), [x.tolist() for x in np.split(values, starts[1:])] if len(keys) else []


def _chunks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        split, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for start, texts in text_pieces(batch, 1):
                for doc_id, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts, strict=True):
                    chunk.add(doc_id, text)
                    if chunk.letters > CHUNK_LETTERS:
                        yield rows_of(chunk.rows(split, buckets))
                        split, chunk = split + 1, Chunk()
        if chunk.ids:
            yield rows_of(chunk.rows(split, buckets))

    return run


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the ranges."""
    lengths = lengths.astype(np.int64)
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def owners(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


class Lookup:
    """A bucket's counts by key: numbers of languages (those of the model) and counts."""

    def __init__(self, table: pa.Table, number: dict[str, int]) -> None:
        self.row: dict[str, int] = {}
        self.first = self.lengths = self.lang = self.n = np.zeros(0, dtype=np.int64)
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            if kind == TABLE:
                keys, langs, at, self.n = counts_of(data.as_py())
                self.lang = np.array([number[x] for x in langs], dtype="<u4")[at]
                starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
                self.row = {keys[i]: r for r, i in enumerate(starts)}
                self.first = np.array(starts, dtype=np.int64)
                self.lengths = np.diff(self.first, append=len(keys))

    def counts(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are known; of those, how many languages have each, the languages, the counts."""
        row = np.fromiter((self.row.get(k, -1) for k in keys), np.int64, len(keys))
        known = row >= 0
        row = row[known]
        at = spans(self.first[row], self.lengths[row])
        return known, self.lengths[row].astype("<u4"), self.lang[at].astype("<u4"), self.n[at].astype("<i8")


def _asked(table: pa.Table) -> list[tuple[int, list[str]]]:
    columns = zip(table.column("kind").to_pylist(), table.column("other").to_pylist(), table.column("data"), strict=True)
    return [(split, parted(unsqueeze(data.as_py(), "u1")[0])) for kind, split, data in columns if kind == ASKED]


def _word_answers(number: dict[str, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out, asked = [], _asked(table)
        lookup = Lookup(table, number) if asked else None
        for split, words in asked:
            known, *counts = lookup.counts(words)
            out.append((ANSWER, split, key[0].as_py(), squeeze(known.astype("u1"), *counts)))
            if not known.all():
                out.append((UNSEEN, split, key[0].as_py(), squeeze(joined(words[i] for i in np.nonzero(~known)[0].tolist()))))
        return table_of(out)

    return run


def _unseen(table: pa.Table) -> list[str]:
    """The words of a chunk that no training text has, in order of their numbers."""
    rows = sorted((r["other"], r["data"]) for r in table.to_pylist() if r["kind"] == UNSEEN)
    return [w for _, data in rows for w in parted(unsqueeze(data, "u1")[0])]


def _ask_grams(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams = sorted({g for word in _unseen(table) for g in grams_of(word)})
        parts: dict[int, list[str]] = {}
        for gram in grams:
            parts.setdefault(bucket_of(gram, buckets), []).append(gram)
        return table_of([(ASKED, b, key[0].as_py(), squeeze(joined(x))) for b, x in parts.items()])

    return run


def _gram_answers(number: dict[str, int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        out, asked = [], _asked(table)
        lookup = Lookup(table, number) if asked else None
        for split, grams in asked:
            known, *counts = lookup.counts(grams)
            found = [grams[i] for i in np.nonzero(known)[0].tolist()]
            out.append((TABLE, split, key[0].as_py(), squeeze(joined(found), *counts)))
        return table_of(out)

    return run


def read_by_grams(word: str, known: dict[str, int]) -> list[int]:
    """Numbers of the n-grams by which a word is read."""
    padded, at, out = f"<{word}>", 0, []
    while at < len(padded):
        for size in range(min(LONGEST, len(padded) - at), 0, -1):
            found = known.get(padded[at : at + size])
            if found is not None:
                out.append(found)
                at += size
                break
        else:
            at += 1  # a character that no language showed tells nothing
    return out


class Logs:
    """Log frequencies of some keys, a language at a time."""

    def __init__(self, lengths: np.ndarray, lang: np.ndarray, n: np.ndarray, scale: np.ndarray) -> None:
        order = np.argsort(lang, kind="stable")
        self.size, self.scale = len(lengths), scale
        self.row, self.gain = owners(lengths)[order], np.log(n[order] + 0.1)
        self.edges = np.searchsorted(lang[order], np.arange(len(scale) + 1))

    def of(self, language: int) -> np.ndarray:
        out = np.full(self.size, np.log(0.1))
        a, b = self.edges[language], self.edges[language + 1]
        out[self.row[a:b]] = self.gain[a:b]
        return out - self.scale[language]


def _scores(languages: list[str], word_scale: np.ndarray, gram_scale: np.ndarray):
    whole = lambda a: np.ascontiguousarray(a.reshape(4, -1).T).view("<u4").ravel()
    many = lambda arrays, kind: np.concatenate([np.zeros(0, kind), *arrays])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        types = "<i8", "u1", "u1", "<u4", "<u4", "<u4", "u1", "u1"
        ids, nulls, alpha, in_part, of_part, in_text, steps, times = unsqueeze(left.column("data")[0].as_py(), *types)
        part, times = np.cumsum(whole(steps), dtype=np.uint32), whole(times).astype(np.float64)
        rows = sorted((r["kind"], r["other"], r["data"]) for r in right.to_pylist())
        words = [unsqueeze(d, "u1", "<u4", "<u4", "<i8") for kind, _, d in rows if kind == ANSWER]
        grams = [unsqueeze(d, "u1", "<u4", "<u4", "<i8") for kind, _, d in rows if kind == TABLE]
        known = many([x[0] for x in words], "u1").astype(bool)
        number = {g: i for i, g in enumerate(g for x in grams for g in parted(x[0]))}
        of_words = Logs(*(many([x[k] for x in words], t) for k, t in ((1, "<u4"), (2, "<u4"), (3, "<i8"))), word_scale)
        of_grams = Logs(*(many([x[k] for x in grams], t) for k, t in ((1, "<u4"), (2, "<u4"), (3, "<i8"))), gram_scale)
        read = [read_by_grams(w, number) for w in _unseen(right)]
        if len(known) != (of_part.max(initial=0) + 1 if len(of_part) else 0) or len(read) != (~known).sum():
            raise ValueError("answers and words of a chunk differ")
        gram = np.fromiter((g for x in read for g in x), np.int64)
        gram_of = np.repeat(np.arange(len(read)), np.fromiter(map(len, read), np.int64, len(read)))
        text, word_of = owners(in_text), owners(in_part)
        total = lambda owner, values, size: np.bincount(owner, values, size)
        best, most, weight = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf), np.zeros(len(ids))
        for i in range(len(languages)):
            logs = np.empty(len(known))
            logs[known] = of_words.of(i)
            logs[~known] = total(gram_of, of_grams.of(i)[gram], len(read))
            by_part = total(word_of, logs[of_part], len(in_part))
            x = total(text, by_part[part] * times, len(ids))
            above = x > most
            top = np.where(above, x, most)
            weight = weight * np.exp(most - top) + np.exp(x - top)
            best[above], most = i, top
        some = (total(text, alpha[part].astype(np.float64), len(ids)) > 0) & bool(languages)
        found = [languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        score = np.where(some, 1 / np.maximum(weight, 1e-300), 0.0)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls.astype(bool)), "lang_pred": pa.array(found, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. Texts are read once; their counts of words are what is shuffled."""
    ensure_checkpoint_dir(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    number, buckets = {x: i for i, x in enumerate(model.languages)}, model.buckets
    # Checkpoints, as rows for the answers and for the scores have to come from the same chunks.
    chunks = source.mapInArrow(_chunks(buckets), ROW).checkpoint()
    words = model.words.union(chunks.where(F.col("kind") == ASKED)).groupBy("key").applyInArrow(_word_answers(number), ROW).checkpoint()
    asked = words.where(F.col("kind") == UNSEEN).groupBy("key").applyInArrow(_ask_grams(buckets), ROW)
    grams = model.grams.union(asked).groupBy("key").applyInArrow(_gram_answers(number), ROW)
    scores = _scores(model.languages, model.word_scale, model.gram_scale)
    texts, answers = chunks.where(F.col("kind") == DOCS).groupBy("key"), words.union(grams).groupBy("key")
    return texts.cogroup(answers).applyInArrow(scores, "doc_id long, lang_pred string, score double")


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of an id, as text, falls in the fold."""
    return (F.crc32(doc_id.cast("string")) % folds) == fold
