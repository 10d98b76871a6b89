"""Operator 11. Fill-in-the-middle transformation over code points.

Each text is decoded to a UTF-32 numpy array. Every code point has a class (its place, whether it is white space, or
its line), neighbouring classes are compared, and `flatnonzero` gives the places where a unit (code point, run of white
space or of other characters, line) ends. Two ranks drawn from the document's id index these ends; the three slices are
encoded again and put together with the sentinels. Ends are made block by block, so a very long text takes its UTF-32
form and one block beside itself. `restored` rebuilds the text from output and form with Spark functions.

No text with a sentinel in it is transformed, and a sentinel can't arise where a piece meets one (it has `<` only at its
start), so each output holds every sentinel once and the text comes back exactly.

Defined results: a null text is empty; an empty text is plain; very long texts are cut whole; a null id draws like an id
of no digits; ties (both ranks equal) give an empty middle; rows repeated with the same id and text each give the same
row; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: Code points whose classes are compared at once.
BLOCK = 1 << 20

SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
CLASSES = {
    "char": lambda points: np.arange(len(points)),
    "word": lambda points: np.isin(points, SPACES),
    "line": lambda points: np.cumsum(points == 10) - (points == 10),
}


def unit_ends(points: np.ndarray, unit: str) -> Iterator[np.ndarray]:
    """Where the units end, in order, by blocks."""
    n = len(points)
    for a in range(0, n, BLOCK):
        kinds = CLASSES[unit](points[a : a + BLOCK + 1])
        yield a + 1 + np.flatnonzero(kinds[1:] != kinds[:-1])
    if n:
        yield np.array([n])


def end_of(points: np.ndarray, unit: str, rank: int) -> int:
    """The place behind the first `rank` units."""
    if rank == 0:
        return 0
    for ends in unit_ends(points, unit):
        if rank <= len(ends):
            return int(ends[rank - 1])
        rank -= len(ends)
    raise IndexError("the text has fewer units")


def draws(key: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16])


def transformed(key: int | None, text: str, unit: str = "char", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = sum(map(len, unit_ends(points, unit)))
    h1, h2, h3, h4 = draws(key, seed)
    if n == 0 or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = end_of(points, unit, low), end_of(points, unit, high)
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, None)))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the output for each row of `df`; map tasks only."""
    if unit not in CLASSES:
        raise ValueError(f"unit is one of {', '.join(CLASSES)}")
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for start, texts in text_pieces(batch, 1):
                ids = batch.column(0).slice(start, len(texts))
                rows = [transformed(key, text, unit, seed, rate, suffix_first) for key, text in zip(ids.to_pylist(), texts, strict=True)]
                columns = [pa.array(c, type=kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(name for name, _ in fields)])

    return source.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    head = F.substr(output, F.lit(len(PREFIX) + 1))
    first = F.call_function("substring_index", head, second, F.lit(1))
    rest = F.substr(head, F.length(first) + len(PREFIX) + 1)
    other, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))


def fim_digest(df: DataFrame, **options) -> DataFrame:
    """The transformation with hashes in place of the output."""
    made = fill_in_middle(df, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def oracle() -> str:
    """The query in DuckDB's SQL."""
    h = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marks = " OR ".join(f"contains(t, '{x}')" for x in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, n, {h} FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR {marks} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
         FROM drawn),
pieces AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m
                   ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
