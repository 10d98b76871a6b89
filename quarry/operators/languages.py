"""Language of a text by profiles of character trigrams: learned from labelled texts as a table, scored by looking them up.

A profile is the most frequent trigrams of a language. The table has a row for each trigram of any profile, with its weight in
every language: a thousandth of a natural logarithm, as a whole number, so that scores are exact sums. It is small (SIZE
trigrams for each language) and can be kept as a Parquet artefact. Texts are bared in Spark (lower-cased letters, all else one
space); their trigrams are numbers made of three code points, counted and looked up in Arrow batches: what leaves a task is a
count for each language and trigram, or a row for each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import replace
from .sampling import top_per_group

#: Trigrams of a profile, languages at most, characters that are looked up at once.
SIZE, LANGUAGES, CHARS = 2000, 1000, 1 << 18


def bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " "))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, trigram) of all windows of three characters within a text, a space put around each."""
    points = np.frombuffer("".join(f" {t} " for t in texts if t).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    filled = [i for i, t in enumerate(texts) if t]
    of = np.repeat(np.array(filled, dtype=np.int64), [len(texts[i]) + 2 for i in filled])
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = of[2:] == of[:-2]
    return of[2:][within], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[within]


def written(codes: np.ndarray) -> list[str]:
    return ["".join(chr(c >> k & 0x1FFFFF) for k in (42, 21, 0)) for c in codes.tolist()]


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of some CHARS characters at a time."""
    start, used = 0, 0
    for i, t in enumerate(texts):
        if i > start and used + len(t) > CHARS:
            yield start, texts[start:i]
            start, used = i, 0
        used += len(t) + 2
    if start < len(texts):
        yield start, texts[start:]


def learn(df: DataFrame, text: str, lang: str, size: int = SIZE) -> DataFrame:
    """(gram, langs, weights): the languages in order, and the trigram's weight in each. Null languages and texts are left
    out. Weights are logarithms of (count + 1) / (count of all of the language's trigrams + number of trigrams in the table).
    ValueError for more than LANGUAGES languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False)
            for start, texts in pieces(batch.column(1).to_pylist()):
                of, codes = trigrams(texts)
                grams, place = np.unique(codes, return_inverse=True)
                both, n = np.unique(number[start + of] * max(1, len(grams)) + place, return_counts=True)
                names = coded.dictionary.take(pa.array(both // max(1, len(grams))))
                every = pa.array(written(grams), pa.string())
                yield pa.RecordBatch.from_arrays([names, every.take(pa.array(both % max(1, len(grams)))), pa.array(n)], ["lang", "gram", "c"])

    source = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), bare(F.col(text)).alias("text")).where("text <> ''")
    counts = source.mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).persist()
    try:
        totals = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).limit(LANGUAGES + 1).collect())
        if len(totals) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        kept = top_per_group(counts, "lang", size, F.desc("c"), F.col("gram")).select("gram").distinct()
        names = [name for name, _ in totals]
        by_lang = [F.coalesce(F.max(F.when(F.col("lang") == name, F.col("c"))), F.lit(0)) for name in names] or [F.lit(0)]
        table = counts.join(kept, "gram").groupBy("gram").agg(F.array(*by_lang).alias("c")).toPandas()  # SIZE rows a language at most
    finally:
        counts.unpersist()
    rows = [(g, names, [round(1000 * math.log((x + 1) / (total + len(table)))) for x, (_, total) in zip(c, totals, strict=True)]) for g, c in zip(table["gram"], table["c"], strict=True)] if names else []
    return df.sparkSession.createDataFrame(rows, "gram string, langs array<string>, weights array<int>")


def detect(df: DataFrame, keep: list[str], text: str, profiles: DataFrame, unknown: str = "unknown") -> DataFrame:
    """The kept columns, lang and margin for each row: the language with the largest sum of weights (ties: the first by name),
    and how far it is ahead of the next, in thousandths for each trigram known. `unknown` and null for texts without a known
    trigram. Map tasks only: the profiles are sent to each, their size is checked when they are learned."""
    rows = profiles.collect()
    names = rows[0].langs if rows else []
    codes = np.array([ord(r.gram[0]) << 42 | ord(r.gram[1]) << 21 | ord(r.gram[2]) for r in rows], dtype=np.int64)
    order = np.argsort(codes)
    shared = df.sparkSession.sparkContext.broadcast((codes[order], np.array([r.weights for r in rows], dtype=np.float64).reshape(len(rows), len(names))[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        known, weights = shared.value
        for batch in batches:
            for start, texts in pieces(batch.column(len(keep)).to_pylist()):
                of, codes = trigrams(texts)
                at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                of, at = of[hit], at[hit]
                n = np.bincount(of, minlength=len(texts))
                sums = np.stack([np.bincount(of, weights[at, i], len(texts)) for i in range(weights.shape[1])] or [np.zeros(len(texts))], axis=1)
                part = batch.slice(start, len(texts))
                values = pa.array(sums.astype(np.int64).ravel())
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * sums.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, values)], [*keep, "_n", "_s"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    scored = df.select(*keep, bare(F.col(text)).alias("_text")).mapInArrow(run, f"{fields}, _n long, _s array<long>")
    labels = F.array(*map(F.lit, names)) if names else F.array(F.lit(unknown))
    ranked = scored.select(*keep, "_n", F.array_sort(F.zip_with("_s", labels, lambda s, x: F.struct((-s).alias("s"), x.alias("x")))).alias("_o"))
    some = F.col("_n") > 0
    margin = F.round((F.get("_o", F.lit(1))["s"] - F.get("_o", F.lit(0))["s"]) / F.col("_n"), 3)
    return ranked.select(*keep, F.when(some, F.get("_o", F.lit(0))["x"]).otherwise(F.lit(unknown)).alias("lang"), F.when(some, margin).alias("margin"))


def save(profiles: DataFrame, path: str) -> None:
    replace(profiles, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
