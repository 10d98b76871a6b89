"""Training with parameter averaging, and language profiles."""

import numpy as np
import pytest

from quarry.operators import languages
from quarry.operators.predict import Flat, classify
from quarry.operators.train import Layout, layers, loss_and_gradient, train, trained_on


@pytest.mark.parametrize("heads,shares", [((3,), (1.0,)), ((2, 3), (0.35, 0.65))])
def test_gradient(heads, shares):
    draw = np.random.default_rng(2)
    layout = Layout((3, 5, 4), heads, shares)
    flat = layout.start(1)[: layout.count()] + draw.normal(0, 0.3, layout.count())
    x, ys = draw.normal(size=(7, 3)), [draw.integers(0, n, 7) for n in heads]
    weights = [draw.random(n) + 0.5 for n in heads]
    keep = [(draw.random((7, w)) >= 0.3) / 0.7 for w in layout.sizes[1:]]
    of = lambda w: loss_and_gradient(w, layout, x, ys, weights, keep)
    gradient = of(flat)[1]
    for k in range(layout.count()):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert (of(flat + step)[0] - of(flat - step)[0]) / 2e-6 == pytest.approx(gradient[k], abs=2e-5)


def test_folded_layers_are_the_network():
    draw = np.random.default_rng(3)
    layout = Layout((4, 6), (3,), (1.0,))
    x, y = draw.normal(size=(200, 4)), draw.integers(0, 3, 200)
    state, _ = trained_on(layout.start(0), layout, x, [y], [np.ones(3)], 0.01, 0.0, draw, 50)
    (w, b), (hw, hb) = layers(state, layout)[0][0], layers(state, layout)[1][0]
    raw_w, raw_b, scale, shift = (state[:24].reshape(4, 6), state[24:30], state[30:36], state[36:42])
    mean, var = state[-13:-7], state[-7:-1]
    plain = np.maximum((x @ raw_w + raw_b - mean) / np.sqrt(var + 1e-5) * scale + shift, 0)
    assert np.allclose(np.maximum(x @ w + b, 0), plain) and hw.shape == (6, 3) and hb.shape == (3,)


ROWS = 400


def separable(spark):
    draw = np.random.default_rng(5)
    rows = [(i, f"S{i % 4 // 2}", f"D{i % 4}", (np.eye(4)[i % 4] * 3 + draw.normal(0, 0.4, 4)).tolist(), i % 5 == 0) for i in range(ROWS)]
    rows += [(ROWS, "S0", "D0", None, False), (ROWS + 1, None, "D1", [0.0] * 4, False), (ROWS + 2, "S0", None, [0.0] * 4, True)]
    return spark.createDataFrame(rows, "id int, s string, d string, v array<double>, held boolean").repartition(3)


@pytest.mark.parametrize("sub", [None, "s"])
def test_training(spark, sub):
    df = separable(spark)
    model, history = train(df, "v", "d", "held", sub, hidden=(16, 8), epochs=20, rate=0.01, batch=16, stop_after=5)
    assert max(h["val_bal"] for h in history) > 0.95 and history[-1]["va_loss"] < history[0]["va_loss"] and len(history) <= 20
    got = {r.id: (r.pred_sub, r.pred_div) for r in classify(df, model, "v", ["id"]).collect()}
    assert sum(got[i][1] == f"D{i % 4}" and (sub is None or got[i][0] == f"S{i % 4 // 2}") for i in range(ROWS)) > 0.95 * ROWS
    assert got[ROWS] == (None, None)


def test_training_needs_rows(spark):
    with pytest.raises(ValueError):
        train(separable(spark).limit(0), "v", "d", "held")


def test_flat_model():
    model = Flat([], (np.eye(3), np.zeros(3)), ["D0", "D1", "D2"], {"D0": "S1", "D1": "S0", "D2": "S1"})
    sub, div, conf = model.predict(np.array([[0.0, 0.0, 9.0], [1.0, 2.0, 1.0]]))
    assert [model.subs[i] for i in sub] == ["S1", "S0"] and div.tolist() == [2, 1] and conf[0] > 0.99


def test_trained_accuracy(spark):
    from quarry.plans.all import QUERIES

    got = {r.model: r for r in QUERIES["v19_trained_accuracy"](spark, "/root/testdata/sf0.01").collect()}
    near = got["nearest centroid"].balanced
    for name in ("flat", "two heads"):
        assert got[name].balanced > 0.9 and got[name].balanced > near - 0.05


def test_profiles(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = languages.learn(d.where("doc_id % 4 <> 2"), "text", "lang")
    languages.save(learned, str(tmp_path / "profiles"))
    kept = languages.load(spark, str(tmp_path / "profiles"))
    found = languages.detect(d.where("doc_id % 4 = 2"), ["doc_id"], "text", kept).withColumnRenamed("lang", "guess").join(d, "doc_id").collect()
    assert sum(r.guess == r.lang for r in found) > 0.97 * len(found) and all(r.margin is None or r.margin >= 0 for r in found)


def test_profiles_of_odd_texts(spark):
    schema = "id long, text string, lang string"
    rows = [(1, "ab ab ab", "x"), (2, "ÉÉ é", "y"), (3, None, "x"), (4, "12 !", "y"), (5, "ab", None), (6, "a", "x")]
    df = spark.createDataFrame(rows, schema)
    learned = languages.learn(df, "text", "lang")
    got = {r.id: r.lang for r in languages.detect(df, ["id"], "text", learned).collect()}
    assert got == {1: "x", 2: "y", 3: "unknown", 4: "unknown", 5: "x", 6: "x"}
    of, codes = languages.trigrams(["éé é", "", "a"])
    assert of.tolist() == [0, 0, 0, 0, 2] and languages.written(codes) == [" éé", "éé ", "é é", " é ", " a "]
    nothing = languages.learn(df.limit(0), "text", "lang")
    assert {r.lang for r in languages.detect(df, ["id"], "text", nothing).collect()} == {"unknown"} and languages.detect(df.limit(0), ["id"], "text", learned).count() == 0


def test_fingerprint_of_texts_in_order(spark):
    from quarry.operators.embed import ordered_fingerprint

    rows = [(i, f"text {i % 7}") for i in range(50)] + [(60, None), (61, "")]
    frame = lambda r, parts: spark.createDataFrame(r, "id int, t string").repartition(parts)
    of = lambda r, parts=3: tuple(ordered_fingerprint(frame(r, parts), "t", "id").first())
    one = of(rows)
    assert one == of(rows[::-1], 5) == of([*rows[:50], (60, ""), (61, None)]) and one[0] == 52
    swapped = [(rows[1][0], rows[0][1]), (rows[0][0], rows[1][1]), *rows[2:]]
    assert len({one, of(swapped), of(rows[1:]), of([*rows, (62, "")])}) == 4
    assert of([]) == (0, "0")


def test_expected_information_of_large_classes():
    from quarry.operators.stats import expected_mutual_information

    assert expected_mutual_information([10**8] * 2, [10**8] * 2) == pytest.approx(1 / (4 * 10**8), rel=0.01)


def test_ordered_distinct(spark):
    from quarry.operators.stats import ordered_distinct

    rows = [("a", 2, ["x", "y"]), ("a", 1, ["y", None, "y"]), ("a", 3, []), ("b", 1, []), ("c", 1, None), ("a", 2, ["z", "x"])]
    got = {r.g: r.items for r in ordered_distinct(spark.createDataFrame(rows, "g string, o int, x array<string>"), "g", "o", "x").collect()}
    assert got["a"][:2] == ["y", None] and sorted(got["a"][2:]) == ["x", "z"] and got["b"] == got["c"] == []


def test_words_are_counted_in_stretches(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarry.operators import tfidf

    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i))) for i in range(12)] + [(20, None)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    of = lambda: sorted(map(tuple, tfidf.term_counts(df, ["id"], F.split("t", " "), 2).collect()))
    whole = of()
    batch = df.select("id", F.split("t", " ").alias("w")).toArrow().to_batches()[0]
    parts = list(tfidf.stretches(batch, 1, 9))
    assert len(parts) > 4 and sum(p.num_rows for p in parts) == 13 and all(p.num_rows == 1 or sum(len(x or []) for x in p.column(1).to_pylist()) <= 9 for p in parts)
    assert whole and whole == of()
