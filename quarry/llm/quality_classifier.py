"""Operator 5. Quality classifier: a factorisation machine.

Features are hashed words (by the root of their share), structure statistics of the text, and metadata: the number of
characters that the table states (`n_chars`, if there is such a column), and how far it is from the text's.
Score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), the pairs in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2 for each factor. It is fitted on TRAIN_ROWS labelled rows at most (whole classes of
a hash of the id, taken while they fit), which bounds what the driver reads; all rows are scored.

Defined results: a null or empty text has the structure features of no words and gets a score; an n_chars
that is null, missing or no number counts as 0; very long texts are read whole; equal rows (ties, repeated rows) have equal scores and each give
a row; a null id is kept; without labelled rows every score is 0.5; an empty table gives an empty table; other columns of
the input are not looked at. Rows of labels without a document, or with a null label, don't count; of several labels of
one id the greatest does.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

#: Labelled rows used at most; buckets of hashed words; factors; passes, step and penalty of the fit.
TRAIN_ROWS, BUCKETS, FACTORS, EPOCHS, STEP, PENALTY = 8_000, 1 << 14, 8, 12, 0.1, 1e-5
#: From this score on, label 1 is predicted.
THRESHOLD = 0.3
MEMO_ENTRIES = 300_000
DIGITS = re.compile(r"[0-9]").findall
STRUCTURE = 12
META = "n_chars"


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        from zlib import crc32

        if len(self) >= MEMO_ENTRIES:
            self.clear()
        b = self[word] = crc32(word.lower().encode()) % BUCKETS
        return b


_buckets = Buckets()


def features(text: str, stated: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features: hashed words, then STRUCTURE figures between 0 and 1; `stated` is
    the number of characters by the metadata."""
    words = text.split()
    n = len(words)
    ids = np.fromiter(map(_buckets.__getitem__, words), dtype=np.int32, count=n)
    counts = np.bincount(ids, minlength=1)
    found = np.nonzero(counts)[0] if n else np.zeros(0, dtype=np.int64)
    values = np.sqrt(counts[found] / max(n, 1))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    size = max(len(text), 1)
    share = lambda x, most=1.0: min(x / most, 1.0)
    symbols = sum(map(text.count, "#*$%&|<>"))
    marks = text.count("!") + text.count("?")
    figures = [
        share(symbols / max(n, 1)),
        share(marks / max(n, 1)),
        sum(map(str.isupper, words)) / max(n, 1),
        1 - len(set(words)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        share(size / max(n, 1), 20),
        share(np.log1p(n), 12),
        share(len(DIGITS(text)) / size),
        share(max(map(len, words), default=0), 100),
        share(len(lines) / max(n, 1)),
        share(np.log1p(max(stated or 0, 0)), 14),
        share(abs((stated or 0) - len(text)) / size),
    ]
    return np.concatenate((found, BUCKETS + np.arange(STRUCTURE))).astype(np.int32), np.concatenate((values, figures)).astype(np.float32)


class Machine:
    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None) -> None:
        size = BUCKETS + STRUCTURE
        self.w0 = w0
        self.w = np.zeros(size, dtype=np.float32) if w is None else w
        self.v = np.zeros((size, FACTORS), dtype=np.float32) if v is None else v

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of rows laid end to end; no row is empty, as all have the structure figures."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * (sums**2 - squares).sum(axis=1), sums, vx

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1])).astype(np.int64)
        z, _, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in batches."""
    if not rows:
        return Machine()
    draw = np.random.default_rng(seed)
    size = BUCKETS + STRUCTURE
    machine = Machine(0.0, None, draw.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 128):
            take = order[at : at + 128]
            lengths = np.array([len(rows[i][0]) for i in take])
            ids, x = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            z, sums, vx = machine.raw(ids, x, starts)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]
            e = np.repeat(error, lengths) * x / len(take)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, weights=e) + PENALTY * machine.w[used]
            dv = e[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(place, weights=dv[:, k]) for k in range(FACTORS)], axis=1) + PENALTY * machine.v[used]
            d0 = error.mean()
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += d0**2
            machine.w[used] -= STEP * dw / np.sqrt(gw[used])
            machine.v[used] -= STEP * dv / np.sqrt(gv[used])
            machine.w0 -= STEP * d0 / np.sqrt(g0)
    return machine


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    stated = F.col(f"`{META}`").try_cast("long") if META in df.columns else F.lit(None).cast("long")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), stated.alias("stated"))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """`most` rows of (id, y) at most: all if they are so few, else those of some classes of a hash of the id. The
    classes have a 64th of `most` rows on average; one that doesn't fit, as an id is repeated too often, is left out."""
    n = rows.count()
    if n <= most:
        return rows
    classes = 64 * n // most
    of_row = F.pmod(F.xxhash64("id"), F.lit(classes))
    found = rows.groupBy(of_row.alias("c")).agg(F.count("*").alias("n")).where(F.col("c") < 128).collect()
    chosen, room = [], most
    for c, size in sorted((r.c, r.n) for r in found):
        if size <= room:
            chosen.append(c)
            room -= size
    return rows.where(of_row.isin(chosen))


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Machine:
    """Fits on `most` rows of `df` that `labels` marks, at most."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null")
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    rows = _rows(df, id_col, text_col)
    chosen = sample(rows.select("id").join(marked, "id"), most).distinct()  # an id's rows are all in or all out
    found = _featured(rows.join(chosen, "id")).collect()  # `most` rows at most
    found.sort(key=lambda r: (r.id, bytes(r.ids), bytes(r.x)))
    rows = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.x, np.float32)) for r in found]
    return fit(rows, np.array([r.y for r in found], dtype=np.float64))


def _featured(df: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [features(t or "", c) for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())],
                ["id", "y", "ids", "x"],
            )

    return df.select("id", "y", "text", "stated").mapInArrow(run, "id long, y int, ids binary, x binary")


def quality_scores(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row; map tasks only. The machine is BUCKETS rows of 9 floats (0.6 MB)."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for start, texts in text_pieces(batch, 1):
                stated = batch.column(2).slice(start, len(texts)).to_pylist()
                scores: list[float] = []
                for i in range(0, len(texts), 256):
                    made = [features(t, c) for t, c in zip(texts[i : i + 256], stated[i : i + 256], strict=True)]
                    scores += shared.value.score(made).astype(float).tolist()
                arrays = [batch.column(0).slice(start, len(texts)), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted"])

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
