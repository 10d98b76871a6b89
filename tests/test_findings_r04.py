"""What the fourth round of findings was about."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import hierarchy, layout, tfidf
from quarry.operators import neighbours as N
from quarry.plans.all import QUERIES


def test_layout_rounds_end_at_eigenvectors(spark):
    """Close eigenvalues and large negative ones (pairs of rows that are linked to each other's neighbours only)."""
    draw, n = np.random.default_rng(3), 240
    w = np.zeros((n, n))
    for i in range(n):
        for j in draw.choice(n, 6, replace=False):
            if i != j and (i + j) % 2:
                w[i, j] = w[j, i] = draw.uniform(0.1, 1)
    rows = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
    got, values = layout.spectral(spark.createDataFrame(rows, "a long, b long, w double"), 2)
    d = w.sum(axis=1)
    m = w / np.sqrt(np.outer(d, d))
    expected, vectors = np.linalg.eigh(m)
    x = np.array([r.layout for r in sorted(got.collect())])
    assert np.allclose(values, expected[::-1][1:3], atol=1e-6) and np.allclose(x.T @ x, np.eye(2), atol=1e-6)
    assert np.abs(m @ x - x * values).max() < 1e-5
    for k in range(2):
        assert abs(x[:, k] @ vectors[:, n - 2 - k]) > 0.9999


def test_layout_of_few_rows_and_of_parts(spark):
    two = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "a long, b long, w double")
    got, values = layout.spectral(two, 2)
    x = np.array([r.layout for r in sorted(got.collect())])
    assert np.allclose(np.abs(x[:, 0]), 0.5**0.5) and np.allclose(x[:, 1], 0) and np.allclose(values, [-1, 0])
    # Ten parts of three rows: the largest value ten times.
    parts = [(3 * p + i, 3 * p + j, 1.0) for p in range(10) for i in range(3) for j in range(3) if i != j]
    got, values = layout.spectral(spark.createDataFrame(parts, "a long, b long, w double"), 2)
    x = np.array([r.layout for r in sorted(got.collect())]).reshape(10, 3, 2)
    assert np.allclose(values, 1, atol=1e-6) and np.abs(x - x[:, :1]).max() < 1e-5


def test_the_layout_query_leaves_the_rounds_alone(spark, monkeypatch):
    made, real = [], layout.spectral
    monkeypatch.setattr(layout, "spectral", lambda links, size, rounds=None: made.append(rounds) or real(links, size, 1))
    assert QUERIES["v12_spectral_layout"](spark, "/root/testdata/sf0.001").count() and made == [None]


def test_queries_are_merged_with_their_own_rows_only(monkeypatch):
    """Each of 64 queries meets a tile of its own: what is sorted doesn't grow with what the others have found."""
    k, tiles, sorted_, real = 3, 64, [], np.lexsort
    y = np.arange(tiles * k, dtype=float)[:, None]
    x = y[::k].copy()
    cuts, keys = np.arange(tiles + 1) * k, np.arange(tiles * k)
    mine = lambda x, comp, core, bound, y, *rest: (np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x)), np.abs(x - y[:, 0]).ravel())
    monkeypatch.setattr(N, "nearest_in_tile", mine)
    monkeypatch.setattr(np, "lexsort", lambda by, axis=-1: sorted_.append(np.size(by[0])) or real(by, axis=axis))
    n = np.zeros(tiles)
    query, near, cost = N.nearest_in_group(x, n, n, n + np.inf, np.eye(tiles, dtype=bool), cuts, y, keys, keys, np.zeros(len(y)), k)
    assert query.tolist() == np.repeat(np.arange(tiles), k).tolist() and near.tolist() == keys.tolist() and cost.tolist() == [0, 1, 2] * tiles
    assert sum(sorted_) <= 2 * k * tiles


def test_nearest_tiles():
    least, count = np.array([[2.0, 1.0, 1.0, 3.0], [0.0, 0.0, 0.0, 0.0]]), np.array([5, 2, 2, 9])
    assert N.first_tiles(least, count, 3).tolist() == [[False, True, True, False], [True, False, False, False]]
    assert N.first_tiles(least, count, 4).tolist() == [[True, True, True, False], [True, False, False, False]]
    assert N.first_tiles(least[:0], count, 4).shape == (0, 4)


def test_vectors_of_topics_are_made_once(spark):
    draw, total = np.random.default_rng(7), spark.sparkContext.accumulator(0)
    rows = [(i, f"word{i % 2} rest{i % 2} all", [float(v) for v in draw.normal(10 * (i % 2), 0.1, 6)]) for i in range(60)]
    texts = spark.createDataFrame(rows, "id long, t string, v array<double>")

    def count(batches):
        for batch in batches:
            total.add(batch.num_rows)
            yield batch

    df = texts.mapInArrow(count, texts.schema)
    documents, levels = hierarchy.density_topics(df, "id", "t", "v", 8, 3, [0.4], texts=texts.select("id", "t"), most=1, share=1.0, least_df=1)
    assert documents.count() == 60 and levels.count() == 2 and total.value == 60


def test_pairs_of_outliers_are_made_of_words(spark):
    texts = ["red fox red fox", "a fox", "", "fox red"]
    words = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tfidf.tokens(F.col("t")).alias("w")).collect()]
    terms, idf = pa.array(["fox", "fox red", "red", "red fox"]), np.array([1.0, 2.0, 3.0, 4.0])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(words, pa.list_(pa.string()))], ["id", "_words"])
    (got,) = hierarchy._coded(iter([batch]), terms, idf, 2)
    assert got.column(1).to_pylist() == [[0, 1, 2, 3], [0], [], [0, 1, 2]]
    assert got.column(2).to_pylist() == [[2.0, 2.0, 6.0, 8.0], [1.0], [], [1.0, 2.0, 3.0]]
