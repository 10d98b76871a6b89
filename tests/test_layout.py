"""The projection by a neighbour graph, against numpy."""

import numpy as np

from quarry.operators import layout as L
from quarry.operators.cluster import reduce_dimensions


def test_fuzzy_weights():
    cost = np.array([1.0, 1.5, 2.0, 4.0, 9.0])
    w = L.fuzzy(cost)
    assert w[0] == 1 and (np.diff(w) < 0).all() and abs(w.sum() - np.log2(6)) < 1e-6
    assert len(L.fuzzy(np.zeros(0))) == 0 and L.fuzzy(np.array([0.0, 0.0])).tolist() == [1, 1]


def test_links_are_unions(spark):
    rows = [(1, [(1.0, 2), (2.0, 3)]), (2, [(1.0, 1), (1.0, 3)]), (3, [])]
    lists = spark.createDataFrame(rows, "key long, found array<struct<cost:double,near:long>>")
    got = {(r.a, r.b): r.w for r in L.fuzzy_links(lists).collect()}
    one = {(1, 2): L.fuzzy(np.array([1.0, 2.0]))[0], (1, 3): L.fuzzy(np.array([1.0, 2.0]))[1], (2, 1): 1.0, (2, 3): 1.0}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        u, v = one.get((a, b), 0.0), one.get((b, a), 0.0)
        assert abs(got[a, b] - (u + v - u * v)) < 1e-12 and got[b, a] == got[a, b]


def test_eigenvectors(spark):
    n = 40
    at = np.sort(np.random.default_rng(1).uniform(0, 6, n))
    w = np.exp(-((at[:, None] - at[None]) ** 2))
    w[w < 1e-3] = 0
    rows = [(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
    got, values = L.spectral(spark.createDataFrame(rows, "a long, b long, w double"), 2, rounds=4)
    d = w.sum(axis=1)
    expected, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    assert np.allclose(values, expected[::-1][1:3], atol=1e-3)
    x = np.array([r.layout for r in sorted(got.collect())])
    for k in range(2):
        assert abs(x[:, k] @ vectors[:, n - 2 - k]) > 0.99 and (x[:, k] ** 3).sum() >= 0


def recall(x, y, k=15):
    near = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2), axis=1)[:, 1 : k + 1]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y), strict=True)])


def test_neighbours_survive_better_than_in_principal_components(spark):
    """A closed curve whose third harmonic is the widest: the graph follows it once around, the widest plane three times."""
    t = np.sort(np.random.default_rng(2).uniform(0, 2 * np.pi, 120))
    x = np.stack([np.cos(t), np.sin(t), 1.3 * np.cos(3 * t), 1.3 * np.sin(3 * t)], axis=1)
    x[5] = x[4]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(999, None)], "id long, v array<double>")
    rows = sorted(L.projected(df, "id", "v", near=8, rounds=5).collect())
    y = np.array([r.layout for r in rows])
    assert len(rows) == 120 and rows[4].layout == rows[5].layout
    flat = np.array([r.reduced for r in sorted(reduce_dimensions(df.where("v is not null"), "v", 2).select("id", "reduced").collect())])
    assert recall(x, y) > recall(x, flat) + 0.2
    assert L.projected(df.limit(0), "id", "v").count() == 0
