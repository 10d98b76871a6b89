"""Vector operators on array columns: norms, centroids, similarities to class centroids, cohesion.

Rows meet classes in map tasks: the centroids are sent to every task as one matrix of a checked size (in several
parts, one pass each, if there are more), and a batch of rows is multiplied with it at once. Rows meet rows only for a
held-out set, likewise in parts, and a task returns one row for each held-out vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import once

#: Numbers in a matrix that is sent to every task at most (32 MB).
BROADCAST_NUMBERS = 4 << 20
#: Rows of a batch, and products of rows with classes or held-out rows, that a task holds at once (8 MB).
BLOCK, PAIRS = 2048, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays. The norm is a variable, so it is not worked out again for each number."""
    unit = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return once(norm(a), unit)


def centroids(df: DataFrame, group: str, vector: str, unit: bool = False) -> DataFrame:
    """Mean vector per group: partial sums by (group, dimension), so one group's rows never meet in a task."""
    flat = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n")
    )
    return out.withColumn("centroid", normalise(F.col("centroid"))) if unit else out


def batch_matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which rows have a vector of `size` numbers); other rows are zero."""
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    fits = lengths == size
    out = np.zeros((len(column), size))
    for at in range(0, len(column), BLOCK):  # copies on the way are of a block, not of all rows
        own = fits[at : at + BLOCK]
        flat = column.slice(at, BLOCK).filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        out[at : at + BLOCK][own] = np.nan_to_num(flat.astype(np.float64)).reshape(-1, size)
    return out, fits


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _parts(classes: DataFrame, label: str, vector: str) -> list[DataFrame]:
    """Classes in parts whose numbers may be sent to every task."""
    size = classes.agg(F.sum(F.size(vector))).first()[0] or 0
    n = max(1, -(-size // BROADCAST_NUMBERS))
    n = 2 * n if n > 1 else n  # parts by hash differ in size
    return [classes.where(F.pmod(F.xxhash64(label), F.lit(n)) == k) if n > 1 else classes for k in range(n)]


def _matrix(part: DataFrame, label: str, vector: str) -> tuple[list, np.ndarray]:
    """Labels in order and their vectors; the part's size is bounded."""
    rows = sorted(part.select(label, vector).where(F.col(vector).isNotNull()).collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def class_scores(df: DataFrame, keep: list[str], vector: str, classes: DataFrame, label: str) -> tuple[DataFrame, list]:
    """(the kept columns and `scores`, the dot products with all centroids; the labels in that order). Vectors of
    another size than the centroids' have null scores. ValueError if the centroids are too many for one matrix."""
    parts = _parts(classes, label, "centroid")
    if len(parts) > 1:
        raise ValueError("too many classes for one row of scores; `nearest` takes them in parts")
    labels, matrix = _matrix(parts[0], label, "centroid")
    return _mapped(df, keep, vector, matrix, "scores array<double>", lambda s: [pa.array(list(s), pa.list_(pa.float64()))]), labels


def _mapped(df: DataFrame, keep: list[str], vector: str, matrix: np.ndarray, schema: str, made) -> DataFrame:
    """The kept columns and those that `made` gives for a batch's products with a matrix."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    source = df.select(*keep, F.col(vector).cast("array<double>").alias("_vector"))
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        m = shared.value
        if not len(m):
            return
        step = max(1, PAIRS // len(m))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            x, fits = batch_matrix(batch.column(len(keep)), m.shape[1])
            new = [pa.compute.if_else(pa.array(fits), a, pa.scalar(None, a.type)) for a in made(x @ m.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *names])

    return source.mapInArrow(run, f"{fields}, {schema}")


def nearest(df: DataFrame, keep: list[str], vector: str, classes: DataFrame, label: str) -> DataFrame:
    """The kept columns, the label of the class with the largest dot product (ties: the least), and `sim`. Rows
    without a vector of the classes' size drop out."""
    kind = classes.schema[label].dataType.simpleString()
    found = []
    for part in _parts(classes, label, "centroid"):
        labels, matrix = _matrix(part, label, "centroid")
        names = pa.array(labels, to_arrow_type(classes.schema[label].dataType))
        best = _mapped(df, keep, vector, matrix, f"`{label}` {kind}, sim double", lambda s, names=names: [names.take(pa.array(s.argmax(axis=1))), pa.array(s.max(axis=1), pa.float64())])
        found.append(best.where("sim is not null"))
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy(*keep).agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col(label).alias("l"))).alias("b"))
    return best.select(*keep, F.col("b.l").alias(label), (-F.col("b.s")).alias("sim"))


def nearest_rows(df: DataFrame, key: str, vector: str, held: DataFrame, label: str) -> DataFrame:
    """For each row of `held` (key, label, vector) its nearest row of `df`: key, label, near_key, near_label, sim.
    Held-out rows go out in parts of a checked size, and each task returns its best for each of them."""
    kind, name = df.schema[key].dataType.simpleString(), df.schema[label].dataType.simpleString()
    found = []
    for part in _parts(held, key, vector):
        rows = part.select(key, vector).where(F.col(vector).isNotNull()).collect()
        rows.sort(key=lambda r: r[0])
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in rows], matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute as pc

            keys, m = shared.value
            if not keys:
                return
            best, who, what = np.full(len(keys), -np.inf), np.full(len(keys), None), np.full(len(keys), None)
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(start, BLOCK)
                    batch = batch.take(pc.sort_indices(batch.column(0)))  # the first of equal ones has the least key
                    x, fits = batch_matrix(batch.column(2), m.shape[1])
                    ids, names = (np.array([*batch.column(i).to_pylist(), None], dtype=object)[:-1] for i in (0, 1))
                    for a in range(0, len(keys), max(1, PAIRS // len(x))):
                        part = slice(a, a + max(1, PAIRS // len(x)))
                        sims = m[part] @ x.T
                        sims[:, ~fits] = -np.inf
                        at = sims.argmax(axis=1)
                        top = sims[np.arange(len(at)), at]
                        more, same = top > best[part], np.nonzero((top == best[part]) & np.isfinite(top))[0]
                        more[same] = ids[at[same]] < who[part][same]
                        best[part][more], who[part][more], what[part][more] = top[more], ids[at[more]], names[at[more]]
            some = np.nonzero(np.isfinite(best))[0].tolist()
            take = lambda v: [v[q] for q in some]
            yield pa.RecordBatch.from_pydict({"query": take(keys), "near_key": take(who), "near_label": take(what), "sim": take(best.tolist())}, schema=pa.schema(out))

        out = [("query", to_arrow_type(df.schema[key].dataType)), ("near_key", to_arrow_type(df.schema[key].dataType)), ("near_label", to_arrow_type(df.schema[label].dataType)), ("sim", pa.float64())]
        source = df.select(key, label, F.col(vector).cast("array<double>"))
        found.append(source.mapInArrow(run, f"query {kind}, near_key {kind}, near_label {name}, sim double"))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("query").agg(F.min(F.struct((-F.col("sim")).alias("s"), "near_key", "near_label")).alias("b"))
    return best.select(F.col("query").alias(key), "b.near_key", "b.near_label", (-F.col("b.s")).alias("sim")).join(held.select(key, label), key)


def silhouettes(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, silhouette) by cosine distance, exactly and in linear time: the mean distance to a class follows
    from the sum of its unit vectors. 0 in classes of one row."""
    unit = df.select(key, label, normalise(F.col(vector)).alias("u"))
    flat = unit.select(label, F.posexplode("u").alias("i", "x"))
    sums = flat.groupBy(label, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    classes = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("centroid"), F.max("n").alias("n"))
    scores, labels = class_scores(unit, [key, label], "u", classes, label)
    if not labels:
        return df.select(key, label, F.lit(0.0).alias("silhouette")).limit(0)
    sizes = dict(classes.select(label, "n").collect())
    many = F.array(*(F.lit(float(sizes[x])) for x in labels))
    at = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    own, n = F.get("scores", at), F.get(many, at)
    a = (n - own) / F.nullif(n - 1, F.lit(0.0))
    other = F.zip_with(F.zip_with("scores", many, lambda s, m: 1 - s / m), F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda d, i: F.when(i != at, d))
    b = F.array_min(other)
    return scores.select(key, label, F.coalesce((b - a) / F.greatest(a, b), F.lit(0.0)).alias("silhouette"))


def class_quality(df: DataFrame, key: str, label: str, vector: str, least: float = 0.3) -> DataFrame:
    """(label, n, cohesion, separation, silhouette, status) of each class; a class of one row has cohesion 1. Status:
    good, or which of cohesion and separation is below `least`."""
    close = cohesion(df, label, vector).select(label, "n", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))
    means = centroids(df.select(label, normalise(F.col(vector)).alias(vector)), label, vector, unit=True)
    apart = separation(means, label)
    mean = silhouettes(df, key, label, vector).groupBy(label).agg(F.avg("silhouette").alias("silhouette"))
    low, near = F.col("cohesion") < least, F.col("separation") < least
    status = F.when(low & near, "review needed").when(near, "low separation").when(low, "low cohesion").otherwise("good")
    return close.join(apart, label, "left").join(mean, label, "left").withColumn("status", status)


def cohesion(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine of all pairs in a group, from the sum vector alone: (|sum|^2 - n) / (n (n - 1))."""
    flat = df.select(group, F.posexplode(normalise(F.col(vector))).alias("i", "x"))
    sums = flat.groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    n = F.col("n")
    return out.select(group, "n", F.when(n > 1, (F.col("q") - n) / (n * (n - 1))).alias("cohesion"))


def separation(classes: DataFrame, label: str) -> DataFrame:
    """1 - mean cosine of a class's centroid to the others': class pairs only."""
    a = classes.select(F.col(label).alias("a"), F.col("centroid").alias("x"))
    b = classes.select(F.col(label).alias("b"), F.col("centroid").alias("y"))
    pairs = a.join(b, F.col("a") != F.col("b")).select("a", (dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("c"))
    return pairs.groupBy(F.col("a").alias(label)).agg((1 - F.avg("c")).alias("separation"))


def choice_in_row(sub_scores: Column, subs: list, div_scores: Column, divs: list, hierarchy: set[tuple]) -> Column:
    """struct(sub, div, conf) from two arrays of scores in the order of `subs` and `divs`: the best sub, then the best
    of its divs, with its softmax among these. Ties take the first."""
    allowed = F.array(*(F.array(*(F.lit((s, d) in hierarchy) for d in divs)) for s in subs))

    def pick(z: Column) -> Column:
        sub = (F.array_position(z["sub"], F.array_max(z["sub"])) - 1).cast("int")
        masked = F.zip_with(z["div"], F.get(allowed, sub), lambda x, ok: F.when(ok, x))
        top = F.array_max(masked)
        total = F.aggregate(F.filter(masked, lambda x: x.isNotNull()), F.lit(0.0), lambda t, x: t + F.exp(x - top))
        div = F.get(F.array(*map(F.lit, divs)), (F.array_position(masked, top) - 1).cast("int"))
        return F.struct(F.get(F.array(*map(F.lit, subs)), sub).alias("sub"), div.alias("div"), (F.lit(1.0) / total).alias("conf"))

    return F.transform(F.array(F.struct(sub_scores.alias("sub"), div_scores.alias("div"))), pick)[0]


def masked_choice(sub_scores: DataFrame, div_scores: DataFrame, hierarchy: DataFrame, key: str) -> DataFrame:
    """Best sub, then the best of its divs by the hierarchy, with its softmax among these.

    sub_scores: key, sub, z; div_scores: key, div, z; hierarchy: sub, div."""
    sub = sub_scores.groupBy(key).agg(F.min(F.struct((-F.col("z")).alias("z"), "sub")).alias("b")).select(key, F.col("b.sub").alias("sub"))
    allowed = div_scores.join(sub, key).join(hierarchy, ["sub", "div"])
    out = allowed.groupBy(key, "sub").agg(
        F.min(F.struct((-F.col("z")).alias("z"), "div")).alias("b"), F.collect_list("z").alias("zs")
    )
    top = -F.col("b.z")
    total = F.aggregate("zs", F.lit(0.0), lambda s, z: s + F.exp(z - top))
    return out.select(key, "sub", F.col("b.div").alias("div"), (F.lit(1.0) / total).alias("conf"))
