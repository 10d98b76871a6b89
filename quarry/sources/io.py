"""Reading and writing: typed Parquet, all-string CSV, record files, shards, manifests, model artefacts, index files."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LISTS = ("authors", "affiliations", "topics", "related_titles")
#: The columns of a parsed record.
RECORD = StructType(
    [
        StructField(c, ArrayType(StringType()) if c in LISTS else StringType())
        for c in (
            "file title abstract language doi authors affiliations journal publisher publication_date volume issue "
            "start_page end_page topics related_titles created_at modified_at error"
        ).split()
    ]
)


def session(app: str = "quarry", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, nulls as ''; a byte-order mark is dropped by the reader."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"').na.fill("")


def write_csv(df: DataFrame, path: str, bom: bool = False, lists: str = "join") -> None:
    """Arrays are joined by '; ', or dropped with `lists="drop"`; with `bom` every file begins with a byte-order mark."""
    kept = [(c, t) for c, t in df.dtypes if lists == "join" or not t.startswith("array")]
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in kept]
    out = df.select(*flat)
    if bom:
        out = out.withColumnRenamed(kept[0][0], "\ufeff" + kept[0][0])
    replace(out, path, "csv", header="true", escape='"')


def files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a finished output where another may be: that one goes only once the new one is there, and comes back if
    the new one can't be moved."""
    fs, new = files(spark, source)
    _, old = files(spark, target)
    _, aside = files(spark, target.rstrip("/") + ".old")
    fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"can't move {target} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't move {source} to {target}")
    fs.delete(aside, True)


def replace(df: DataFrame, path: str, form: str = "parquet", **options: str) -> None:
    """Writes beside the old output, which stays until the new one is whole."""
    beside = path.rstrip("/") + ".new"
    df.write.mode("overwrite").options(**options).format(form).save(beside)
    move(df.sparkSession, beside, path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only on a local master
    (tests), as machines of a cluster don't share theirs."""
    sc = spark.sparkContext
    conf, found = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return conf or found.get()
    if conf is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        conf = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(conf)
    return conf


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """The rows numbered from 0 in a total order, without one task that sees them all: sorted by ranges, numbered
    within each, and moved by the sizes of the ranges before."""
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut.select("*", F.spark_partition_id().alias("_part"), within.alias("_row")).checkpoint()
    sizes = sorted((r._part, r.n) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    base, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, base))
        base += n
    moved = placed.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _base long")), "_part")
    return moved.select(*df.columns, (F.col("_row") + F.col("_base")).alias(name))


def rows_between(df: DataFrame, start: int, end: int, name: str = "position") -> DataFrame:
    """Rows [start, end) by a stored position: a filter that reaches the scan."""
    return df.where((F.col(name) >= start) & (F.col(name) < end))


def read_tolerant(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, without the files that can't be read."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def _parquet_file(path: str):
    """A Parquet file opened in a task, of a local (or mounted) folder or of any file system with an address."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if re.match("^(file:)?/", path):
        return pq.ParquetFile(re.sub("^file:/+", "/", path))
    system, at = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(at))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, rows, error) of each row group, by the files' footers alone. A file without row groups has one row
    with a null group and no rows; one whose footer can't be read has one with null rows and what went wrong."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    meta = _parquet_file(name).metadata
                    found = [(name, i, meta.row_group(i).num_rows, None) for i in range(meta.num_row_groups)] or [(name, None, 0, None)]
                except (OSError, pa.ArrowException) as e:
                    found = [(name, None, None, str(e)[:500])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["path", "row_group", "rows", "error"])

    return files.mapInArrow(run, "path string, row_group int, rows long, error string")


def read_row_groups(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of `schema` (missing ones null, others cast) and _path, _row_group, _error, _lost. A row group that can't be
    read, or a file without a readable footer, is one row of nulls that says why and how many rows are lost (null: unknown);
    all other row groups are whole. Each row group is read in one piece, by one task."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tagged(columns: list[pa.Array], n: int, name: str, group: int | None, error: str | None, lost: int | None) -> pa.RecordBatch:
            tags = [pa.array([v] * n, t) for v, t in ((name, pa.string()), (group, pa.int32()), (error, pa.string()), (lost, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *tags], [*arrow.names, "_path", "_row_group", "_error", "_lost"])

        for batch in batches:
            for name, group, rows, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is None and group is None:
                    continue
                try:
                    if error is not None:
                        raise OSError(error)
                    file = _parquet_file(name)
                    have = [f for f in arrow.names if f in file.schema_arrow.names]
                    got = file.read_row_group(group, columns=have)
                    whole = pa.table([got.column(f.name).cast(f.type) if f.name in have else pa.nulls(rows, f.type) for f in arrow], schema=arrow)
                except (OSError, pa.ArrowException) as e:
                    yield tagged([pa.nulls(1, f.type) for f in arrow], 1, name, group, str(e)[:500], rows)
                    continue
                for part in whole.to_batches(max_chunksize=10_000):
                    yield tagged(part.columns, part.num_rows, name, group, None, None)

    kinds = StructType([StructField(f.name, f.dataType, True) for f in schema])
    for name, kind in (("_path", "string"), ("_row_group", "integer"), ("_error", "string"), ("_lost", "long")):
        kinds = kinds.add(name, kind)
    return row_groups(spark, path).repartition("path", "row_group").mapInArrow(run, kinds)


def unreadable_files(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """(path) of the files of which `read_tolerant` gives no row, though their footer tells of rows or can't be read."""
    bare = F.regexp_replace("path", "^[a-z0-9]+:/+", "/").alias("path")
    full = row_groups(spark, path).where(F.col("error").isNotNull() | (F.col("rows") > 0)).select(bare).distinct()
    seen = read_tolerant(spark, path, schema).select(F.input_file_name().alias("path")).select(bare).distinct()
    return full.join(seen, "path", "left_anti")


def unreadable(spark: SparkSession, path: str, schema: StructType | None = None) -> list[str]:
    """The paths of `unreadable_files`, in order: broken files, which are few."""
    return sorted(r.path for r in unreadable_files(spark, path, schema).collect())


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` in its order and types; missing ones are null, others are dropped."""
    return df.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)
    )


def union_conformed(parts: list[DataFrame], schema: StructType) -> DataFrame:
    out = conform(parts[0], schema)
    for p in parts[1:]:
        out = out.unionByName(conform(p, schema))
    return out


def write_shards(df: DataFrame, path: str, key: str, shard_rows: int) -> None:
    """A dataset partitioned by shard_id = key div shard_rows: a shard can be read, or repaired, alone."""
    shard = F.floor(F.col(key) / shard_rows).cast("long")
    df.withColumn("shard_id", shard).repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)


def write_exact_shards(df: DataFrame, path: str, shard_rows: int, *order: str) -> None:
    """Shards of exactly `shard_rows` rows in a total order, the last one of what is left, and their manifest."""
    placed = with_position(df, *order)
    out = placed.withColumn("shard_id", F.floor(F.col("position") / shard_rows).cast("long")).drop("position")
    out.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)
    spark = df.sparkSession
    done = spark.read.parquet(path).groupBy("shard_id").agg(F.count("*").alias("n"))
    replace(done.coalesce(1), path.rstrip("/") + ".manifest")


def completed_shards(spark: SparkSession, path: str) -> list[int]:
    """The shards that the manifest has, in order."""
    return sorted(r.shard_id for r in spark.read.parquet(path.rstrip("/") + ".manifest").collect())


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Only shards that the manifest has: pruned by partition, whatever else lies in the folder."""
    return spark.read.parquet(path).where(F.col("shard_id").isin(completed_shards(spark, path)))


def merge_batches(spark: SparkSession, folder: str, target: str, schema: StructType, keep: bool = False) -> int:
    """Puts the batches batch_* of a folder together in one schema, and removes them once the result is there."""
    fs, root = files(spark, folder)
    found = sorted(f.getPath().toString() for f in fs.listStatus(root) if f.getPath().getName().startswith("batch_"))
    if not found:
        return 0
    replace(union_conformed([spark.read.parquet(p) for p in found], schema), target)
    for p in [] if keep else found:
        fs.delete(files(spark, p)[1], True)
    return len(found)


def copy_sample(spark: SparkSession, source: str, target: str, size: int, seed: int | None = None) -> list[str]:
    """Copies `size` folders of `source`, drawn with a seed; gives their names."""
    from ..operators.sampling import sample_files

    fs, root = files(spark, source)
    names = sample_files([f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()], size, seed)
    util, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        to, p = files(spark, f"{target}/{name}")
        util.copy(fs, files(spark, f"{source}/{name}")[1], to, p, False, True, conf)
    return names


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced as a whole."""
    fs, p = files(spark, path + ".new")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    move(spark, path + ".new", path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def save_model(spark: SparkSession, path: str, weights: dict[str, np.ndarray], classes: dict[str, list[str]], metrics: dict) -> None:
    """Weights as a table (name, shape, numbers), classes and metrics as JSON beside it."""
    made = [(k, [int(x) for x in np.shape(w)], [float(x) for x in np.ravel(w)]) for k, w in weights.items()]
    replace(spark.createDataFrame(made, "name string, shape array<int>, numbers array<double>").coalesce(1), f"{path}/weights")
    write_text(spark, f"{path}/classes.json", json.dumps(classes, ensure_ascii=False))
    write_text(spark, f"{path}/metrics.json", json.dumps(metrics, ensure_ascii=False))


def load_model(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> tuple[dict[str, np.ndarray], dict, dict]:
    """(weights, classes, metrics); a weight's name that begins with a key of `renames` gets its value instead."""
    weights = {}
    for r in spark.read.parquet(f"{path}/weights").collect():
        name = next((new + r.name[len(old) :] for old, new in (renames or {}).items() if r.name.startswith(old)), r.name)
        weights[name] = np.array(r.numbers).reshape(r.shape)
    return weights, json.loads(read_text(spark, f"{path}/classes.json")), json.loads(read_text(spark, f"{path}/metrics.json"))


#: What a search service is told about the index.
INDEX_SETTINGS = {
    "searchableAttributes": ["title", "abstract", "authors", "journal"],
    "filterableAttributes": [
        "pred_lcc_main", "pred_lcc", "pred_lcc_div", "lcc.lvl0", "lcc.lvl1", "lcc.lvl2", "journal", "publisher", "year",
        "trust_tier", "pred_centroid_sim", "conf_div",
    ],
    "sortableAttributes": ["year", "pred_centroid_sim", "conf_div"],
    "rankingRules": ["words", "typo", "proximity", "attribute", "sort", "exactness"],
}


def write_index(df: DataFrame, path: str, batch: int = 2000, settings: dict | None = None) -> None:
    """Documents as files of JSON lines, `batch` at most in each, and the settings: what a search service is loaded
    with. The old index stays until the new one is whole."""
    replace(df, f"{path}/documents", "json", maxRecordsPerFile=str(batch))
    write_text(df.sparkSession, f"{path}/settings.json", json.dumps(settings or INDEX_SETTINGS))


def repair_shards(df: DataFrame, path: str, key: str, shard_rows: int) -> None:
    """Overwrites only the shards that `df` has rows of."""
    shard = F.floor(F.col(key) / shard_rows).cast("long")
    out = df.withColumn("shard_id", shard).repartition("shard_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(path)


def vectors_from_text(c: Column) -> Column:
    """A vector from JSON or comma-parted text; null if it can't be read."""
    json = F.when(F.btrim(c).startswith("["), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    return F.from_json(json, "array<float>")


def vector_sizes(df: DataFrame, col: str) -> DataFrame:
    """How many rows have vectors of each size (null: no vector): more than one row of this is an error."""
    return df.groupBy(F.when(F.col(col).isNotNull(), F.size(col)).alias("size")).agg(F.count("*").alias("n"))
