"""What the operators share: table reading, Arrow mapping over whole texts, packed blobs, memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import ensure_checkpoint_dir  # noqa: F401

#: Bytes of text that one call of a batch function sees at most (one longer text is a batch of its own).
BATCH_BYTES = 8 << 20
#: Splits or buckets that one task takes, one after the other.
GROUPS_A_TASK = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pieces(batch: pa.RecordBatch, column: int, size: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch with at most `size` bytes of text: (first row, texts). Null texts are empty."""
    values = batch.column(column)
    n, start, used = len(values), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    for i, length in enumerate(lengths):
        if used and used + length > size:
            yield start, [x or "" for x in values.slice(start, i - start).to_pylist()]
            start, used = i, 0
        used += length + 64
    if start < n:
        yield start, [x or "" for x in values.slice(start).to_pylist()]


def map_texts(
    df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list[str]], list[list]]], size: int = BATCH_BYTES
) -> DataFrame:
    """One output row for each input row, in map tasks only (no shuffle): the id, then what the function that
    `make()` builds in the worker returns for a slice of whole texts, as one list per column of `schema`."""
    from pyspark.sql.types import _parse_datatype_string

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = _parse_datatype_string(schema)
    names = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        fn = make()
        for batch in batches:
            for start, texts in text_pieces(batch, 1, size):
                columns = fn(texts)
                arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)).cast(pa.int64()), *arrays], ["doc_id", *names]
                )

    return source.mapInArrow(run, f"doc_id long, {schema}")


def release() -> None:
    """Gives freed memory back to the system: workers are kept from group to group and from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(fn: Callable) -> Callable:
    """A group's function that releases what it freed, and what groups before it did."""

    def run(*args):
        release()
        try:
            return fn(*args)
        finally:
            release()

    return run


def dealt_rows(df: DataFrame, splits: int) -> DataFrame:
    """(split, data): the rows of `df` (doc_id, text and others) dealt to splits by a hash, as compressed Arrow batches,
    which take well under half the room of rows in a shuffle. The place of a row counts as well, so that rows which repeat
    each other are dealt out too."""
    of_row = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(splits)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            split = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(split, kind="stable")
            rows = batch.drop_columns([batch.schema.names[-1]]).take(pa.array(order))
            cuts = [0, *(np.nonzero(np.diff(split[order]))[0] + 1).tolist(), len(split)]
            found, data = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows.slice(a, b - a))
                found.append(split[order[a]])
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], ["split", "data"])

    return df.withColumn("split", of_row).mapInArrow(run, "split int, data binary")


def parted(df: DataFrame, key: str, groups: int, fewest: int) -> DataFrame:
    """Rows by key in as many partitions as the number of groups asks for (GROUPS_A_TASK each), so that what a task reads
    doesn't grow with the data."""
    return df.repartition(max(fewest, -(-groups // GROUPS_A_TASK)), key)


def rows_of_split(table: pa.Table) -> pa.Table:
    """The rows of a split, from its batches."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("data")])


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(a.tobytes() for a in arrays)])


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<i8", len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def planes(a: np.ndarray) -> np.ndarray:
    """Numbers by bytes of the same weight, as many as the greatest needs, which stands first."""
    a = a.astype("<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return np.append(np.uint8(width), a.view("u1").reshape(-1, 8)[:, :width].T.ravel())


def from_planes(data: np.ndarray) -> np.ndarray:
    width = int(data[0])
    out = np.zeros(((len(data) - 1) // width, 8), dtype="u1")
    out[:, :width] = data[1:].reshape(width, -1).T
    return out.view("<u8").ravel()


def bucket_bounds(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes starts in an ordered array; one more for the end."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(ordered, np.array(edges, dtype=np.uint64)), [len(ordered)])).astype(int)
