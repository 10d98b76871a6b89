"""Batch inference with weights (one head, or two over one trunk with a hierarchy mask) and trainable baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import batch_matrix

SCHEMA = "pred_div string, pred_sub string, pred_main string, conf_div double"


class TwoHead:
    """weights: list of (W, b) of the trunk with ReLU between, then (W, b) for subs and divs."""

    def __init__(self, trunk, sub_head, div_head, subs: list[str], divs: list[str], hierarchy: set[tuple[str, str]]) -> None:
        self.trunk, self.sub_head, self.div_head, self.subs, self.divs = trunk, sub_head, div_head, subs, divs
        self.mask = np.array([[(s, d) in hierarchy for d in divs] for s in subs])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sub, div, confidence): the best sub, then the best of its divs, with its softmax among these."""
        for w, b in self.trunk:
            x = np.maximum(x @ w + b, 0)
        sub = (x @ self.sub_head[0] + self.sub_head[1]).argmax(axis=1)
        z = np.where(self.mask[sub], x @ self.div_head[0] + self.div_head[1], -np.inf)
        div = z.argmax(axis=1)
        return sub, div, 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)


class Flat:
    """One head over divs. parents: the sub of each div, if they have one."""

    def __init__(self, trunk, head, divs: list[str], parents: dict[str, str] | None = None) -> None:
        self.trunk, self.sub_head, self.divs = trunk, head, divs
        of = [(parents or {}).get(d, "") for d in divs]
        self.subs = sorted(set(of))
        self.parent = np.array([self.subs.index(x) for x in of], dtype=np.int64)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sub, div, confidence): the best div, its sub, and its softmax."""
        for w, b in self.trunk:
            x = np.maximum(x @ w + b, 0)
        z = x @ self.sub_head[0] + self.sub_head[1]
        div = z.argmax(axis=1)
        return self.parent[div], div, 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)


def classify(df: DataFrame, model: TwoHead | Flat, vector: str, keep: list[str]) -> DataFrame:
    """The kept columns and predictions, without the vectors; nulls for rows without a vector of the model's size.
    Weights (a few MB) go to each task once, batches are multiplied with them at once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    size = (model.trunk[0] if model.trunk else model.sub_head)[0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        m = shared.value
        divs, subs, mains = pa.array(m.divs), pa.array(m.subs), pa.array([s[:1] for s in m.subs])
        for batch in batches:
            x, fits = batch_matrix(batch.column(len(keep)), size)
            sub, div, conf = m.predict(x) if len(x) else (np.zeros(0, np.int64),) * 3
            sub, div = pa.array(sub, mask=~fits), pa.array(div, mask=~fits)
            made = [divs.take(div), subs.take(sub), mains.take(sub), pa.array(np.round(conf.astype(np.float64), 4), mask=~fits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, "pred_div", "pred_sub", "pred_main", "conf_div"])

    return df.select(*keep, vector).mapInArrow(run, f"{fields}, {SCHEMA}")


def cross_validated(df: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """(key, label, predicted): each row by the nearest unit centroid of the classes of the other folds."""
    from . import vectors as V
    from .sampling import folds

    rows = df.select(key, label, vector, folds(key, k).alias("fold"))
    out = None
    for f in range(k):
        classes = V.centroids(rows.where(F.col("fold") != f), label, vector, unit=True).select(F.col(label).alias("predicted"), "centroid")
        found = V.nearest(rows.where(F.col("fold") == f), [key, label], vector, classes, "predicted").drop("sim")
        out = found if out is None else out.unionByName(found)
    return out


def train_baseline(df: DataFrame, vector: str, label: str, steps: int = 30):
    """Multinomial logistic regression over vectors: (model, transform)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(ready)
    model = LogisticRegression(labelCol="y", maxIter=steps).fit(index.transform(ready))
    names = F.array(*map(F.lit, index.labels))

    def transform(new: DataFrame) -> DataFrame:
        v = new.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
        done = model.transform(v).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
        return done.drop("features", "rawPrediction", "probability", "prediction")

    return model, transform
