import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import cluster, sampling, stats, taxonomy, tfidf
from quarry.operators import vectors as V
from quarry.operators.predict import TwoHead, classify


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a string, b string")


def test_entropy_and_purity(spark):
    df = pairs(spark, "g" * 10, "x" * 9 + "y")
    r = stats.purity(df, "a", "b").first()
    assert r.dominant == "x" and r.purity == 0.9 and r.norm_entropy == pytest.approx(0.468996, abs=1e-6)
    assert stats.purity(pairs(spark, "ggg", "xxx"), "a", "b").first().norm_entropy == 0
    tie = stats.purity(pairs(spark, "gg", "yx"), "a", "b").first()
    assert tie.dominant == "x" and tie.norm_entropy == pytest.approx(1)


def test_agreement(spark):
    same = pairs(spark, "xxyy", "ppqq")
    assert stats.adjusted_mutual_information(same, "a", "b") == pytest.approx(1.0)
    assert stats.adjusted_rand(same, "a", "b").first().ari == 1.0
    crossed = pairs(spark, "xxyy", "pqpq")
    assert stats.adjusted_mutual_information(crossed, "a", "b") == pytest.approx(-0.5)
    assert stats.lift(pairs(spark, "xxyy", "pppp"), "a", "b").first().lift == 1.0


@given(st.lists(st.integers(1, 4), min_size=1, max_size=3), st.data())
def test_expected_mutual_information_is_the_mean_over_permutations(rows, data):
    from itertools import permutations

    n = sum(rows)
    if n > 6:
        return
    labels = [i for i, k in enumerate(rows) for _ in range(k)]
    other = data.draw(st.lists(st.integers(0, 2), min_size=n, max_size=n))

    def mi(a, b):
        return sum(
            c / n * math.log(n * c / (a.count(x) * b.count(y)))
            for x in set(a) for y in set(b) if (c := sum(p == (x, y) for p in zip(a, b)))
        )

    every = [mi(labels, list(p)) for p in permutations(other)]
    cols = [other.count(x) for x in sorted(set(other))]
    assert stats.expected_mutual_information(rows, cols) == pytest.approx(sum(every) / len(every), abs=1e-9)


def test_reports(spark):
    df = pairs(spark, "aaab", "aabb")
    r = stats.balanced_accuracy(df, "a", "b").first()
    assert r.accuracy == 0.75 and r.balanced == pytest.approx(0.833333, abs=1e-6)
    w = {x.a: x.weight for x in stats.class_weights(pairs(spark, "aaab", "    "), "a").collect()}
    assert w["a"] == pytest.approx(0.666667, abs=1e-6) and w["b"] == 2.0


def test_quantile_bins(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "x")
    e = stats.edges(df, "x", 10)
    counts = df.groupBy(stats.quantile_bin(F.col("x"), e).alias("b")).count().collect()
    assert sorted(r["count"] for r in counts) == [10] * 10
    flat = spark.createDataFrame([(1,)] * 9 + [(2,)], "x int")
    assert stats.edges(flat, "x", 10) == pytest.approx([1.0, 1.1, 2.0], abs=1)


def test_buckets(spark):
    df = spark.createDataFrame([("QC|TK", "TK"), ("QC|TK", "T"), ("", "")], "g string, p string")
    assert [r.ok for r in df.select(taxonomy.in_bucket(F.col("g"), F.col("p")).alias("ok")).collect()] == [True, False, False]
    codes = spark.createDataFrame([("QP",), ("RC",), ("",)], "c string")
    assert [r.b for r in codes.select(taxonomy.bucket(F.col("c")).alias("b")).collect()] == ["QH|QP|RC", "RC", ""]
    f = spark.range(1).select(taxonomy.facet_levels(F.lit("Q"), F.lit("QD"), F.lit("QD1")).alias("f"), taxonomy.facet_levels(F.lit(""), F.lit("QD"), F.lit("")).alias("g")).first()
    assert f.f.lvl2 == "Q — Science > QD > QD1" and f.g is None


def test_vectors(spark):
    rows = [(i, i % 3, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(12)] + [(99, 5, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, g int, v array<float>")
    u = {r.id: np.array(r.u) for r in df.select("id", V.normalise(F.col("v")).alias("u")).collect()}
    assert (u[99] == 0).all() and np.linalg.norm(u[1]) == pytest.approx(1)
    c = {r.g: r.cohesion for r in V.cohesion(df.where("g < 5"), "g", "v").collect()}
    for g in range(3):
        m = np.array([u[i] for i in range(12) if i % 3 == g])
        s = m @ m.T
        assert c[g] == pytest.approx((s.sum() - np.trace(s)) / (len(m) * (len(m) - 1)))


def test_masked_choice(spark):
    sub = spark.createDataFrame([(1, "S0", 1.0), (1, "S1", 2.0)], "k int, sub string, z double")
    div = spark.createDataFrame([(1, "D0", 9.0), (1, "D1", 0.0), (1, "D2", 1.0)], "k int, div string, z double")
    h = spark.createDataFrame([("S0", "D0"), ("S0", "D1"), ("S1", "D2")], "sub string, div string")
    r = V.masked_choice(sub, div, h, "k").first()
    assert (r.sub, r.div, r.conf) == ("S1", "D2", 1.0)


def test_two_heads(spark):
    one = (np.eye(2), np.zeros(2))
    model = TwoHead([one], one, (np.array([[9.0, 0, 0], [9, 0, 1]]), np.zeros(3)), ["S0", "S1"], ["D0", "D1", "D2"], {("S0", "D0"), ("S0", "D1"), ("S1", "D2")})
    df = spark.createDataFrame([(1, [0.0, 3.0]), (2, [3.0, 0.0])], "id int, v array<float>")
    got = {r.id: (r.pred_sub, r.pred_div) for r in classify(df, model, "v", ["id"]).collect()}
    assert got == {1: ("S1", "D2"), 2: ("S0", "D0")}


def test_stratified_floor(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "few") for i in range(100)], "id int, g string")
    counts = {r.g: r["count"] for r in sampling.stratified_sample(df, "g", "id", 50, 10).groupBy("g").count().collect()}
    assert sum(counts.values()) == 50 and sampling.stratified_sample(df, "g", "id", 1000, 300).count() == 100


def test_grams(spark):
    df = spark.createDataFrame([("The red fox of red fox",)], "t string")
    assert df.select(tfidf.grams(tfidf.tokens(F.col("t"))).alias("g")).first().g == ["red", "fox", "red", "fox", "red fox", "fox red", "red fox"]


def test_linkage():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert cluster.average_linkage(d, 0.2).tolist() == [0, 0, 1]
    assert cluster.merge_quality(d, np.array([0, 0, 0])) == -1
    assert cluster.tune_threshold(d) == pytest.approx(0.11, abs=0.02)


def test_merge_of_too_many_classes(spark, tmp_path):
    from quarry.plans.vector_queries import v11_merge_classes

    e = spark.range(8).selectExpr("id AS vec_id", "cast(id AS int) AS label", "array(float(1), float(id)) AS embedding")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert v11_merge_classes(spark, str(tmp_path), 8).count() == 8
    with pytest.raises(ValueError, match="more than 7 classes"):
        v11_merge_classes(spark, str(tmp_path), 7)


def test_merge_reads_beyond_the_most_classes(spark, tmp_path, monkeypatch):
    from quarry.plans.vector_queries import v11_merge_classes

    monkeypatch.setattr(cluster, "tune_threshold", lambda d: 0.0)
    monkeypatch.setattr(cluster, "average_linkage", lambda d, t: np.zeros(len(d), dtype=int))  # 5,000 classes take minutes
    e = spark.range(5001).selectExpr("id AS vec_id", "cast(id AS int) AS label", "array(float(1), float(id)) AS embedding")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(ValueError, match="more than 5000 classes"):
        v11_merge_classes(spark, str(tmp_path))


def test_quantiles_are_exact(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=3000), np.full(2000, 0.25), draw.integers(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    for keep in (10_000, 50, 3):
        assert stats.quantiles(df, "v", at, keep) == pytest.approx(np.quantile(x, at).tolist(), abs=1e-12)
    assert stats.quantiles(df.limit(0), "v", at) == []


def test_first_by_hash_is_exact(spark):
    rows = [(i, "big" if i % 10 else "few") for i in range(30_000)]
    df = spark.createDataFrame(rows, "id int, g string")
    held = {(r.id, r.g) for r in sampling.split_80_20(df, "g", "id").where("held_out").collect()}
    from hashlib import md5

    for g in ("big", "few"):
        ids = sorted((i for i, x in rows if x == g), key=lambda i: (md5(str(i).encode()).hexdigest(), i))
        assert {i for i, x in held if x == g} == set(ids[: math.ceil(len(ids) * 0.2)])


def test_sample_over_shards(spark):
    df = spark.createDataFrame([(i, i % 3 if i > 2 else 3) for i in range(40)], "id int, s int")
    counts = {r.s: r["count"] for r in sampling.sample_over_shards(df, "s", "id", 18).groupBy("s").count().collect()}
    assert sorted(counts.values())[:1] == [3] and counts[3] == 3 and sum(counts.values()) in (16, 17) and max(counts.values()) == 5


def test_nearest_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(0)
    m, x = draw.normal(size=(9, 4)), draw.normal(size=(30, 4))
    classes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "c int, centroid array<double>")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None), (98, [1.0])], "id int, v array<double>")
    expected = {i: (int((m @ r).argmax()), float((m @ r).max())) for i, r in enumerate(x)}
    for most in (1 << 20, 8):
        monkeypatch.setattr(V, "BROADCAST_NUMBERS", most)
        got = {r.id: (r.c, r.sim) for r in V.nearest(df, ["id"], "v", classes, "c").collect()}
        assert got.keys() == expected.keys() and all(got[i][0] == e[0] and got[i][1] == pytest.approx(e[1]) for i, e in expected.items())
        rows = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(x)], "id int, g int, v array<double>")
        near = {r.id: r.near_key for r in V.nearest_rows(rows.where("id >= 5"), "id", "v", rows.where("id < 5"), "g").collect()}
        assert near == {i: 5 + int((x[5:] @ x[i]).argmax()) for i in range(5)}


def test_silhouettes(spark):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(25, 3)), draw.integers(0, 3, 25)
    y[0] = 7
    df = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(y, x))], "id int, c int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for r in V.silhouettes(df, "id", "c", "v").collect():
        own = (y == y[r.id]) & (np.arange(25) != r.id)
        if not own.any():
            assert r.silhouette == 0
            continue
        a, b = d[r.id][own].mean(), min(d[r.id][y == c].mean() for c in set(y.tolist()) if c != y[r.id])
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


def test_topics_are_found(spark):
    words = ["red fox", "blue whale", "green tree"]
    draw = np.random.default_rng(6)
    rows = [(i, f"{words[i % 3]} {words[i % 3]}", (np.eye(6)[i % 3] + draw.normal(0, 0.05, 6)).tolist()) for i in range(90)]
    docs, topics = cluster.topic_model(spark.createDataFrame(rows, "id int, t string, v array<double>"), "id", "t", "v", [3], (3, 3), dimensions=3)
    found = {r.topic: r for r in topics.collect()}
    for r in docs.collect():
        assert words[r.id % 3] in found[r.topic].keywords
    assert sorted(t.n for t in found.values()) == [30, 30, 30]


def test_ranked_search(spark):
    from quarry.operators import search

    docs = spark.createDataFrame([(1, "a house near the forest"), (2, "the forrest and a very large old wooden house"), (3, "houses"), (4, "nothing")], "id int, t string")
    got = {r.id: (r.matched, r.typos, r.proximity) for r in search.ranked(search.positions_index(docs, "id", "t"), "id", ["house", "forest"]).collect()}
    assert got == {1: (2, 0, 3), 2: (2, 1, 7), 3: (1, 1, 8)}


def test_gold_keywords_and_buckets(spark):
    from quarry.operators import reports

    rows = [(i, "Ｊ　One" if i % 2 else "J One", f"Quantum <i>dots</i> in films {i}", "QC") for i in range(6)] + [(9, "Pediatrics", "Children", "RC")]
    t = reports.gold_template(spark.createDataFrame(rows, "id int, j string, t string, c string"), "j", "t", "c", "id", samples=2)
    got = {r.journal: r for r in t.collect()}
    assert got["J One"].n_papers == 6 and got["J One"].model_purity == 1.0 and "quantum dots" in got["J One"].top_keywords
    assert got["J One"].sample_titles == "Quantum dots in films 0 | Quantum dots in films 1"
    codes = spark.createDataFrame([("J One", "QP")], "journal string, code string")
    b = {r.journal: (r.gold_lcc_sub, r.gold_lcc_main) for r in reports.gold_buckets(t, codes).collect()}
    assert b == {"J One": ("QH|QP|RC", "Q|R"), "Pediatrics": ("RC", "R")}


def test_detected_languages(spark):
    from quarry.functions.language import detect_language

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = d.where("n_chars > 300").select("lang", detect_language(F.col("text")).alias("found"))
    assert r.agg(F.avg((F.col("lang") == F.col("found")).cast("int"))).first()[0] > 0.9


def test_embedding_of_texts(spark):
    from quarry.operators.embed import Hashed, embed, hashed

    df = spark.createDataFrame([(1, "red fox, red"), (2, None), (3, " "), (4, "RED FOX red")], "id int, t string").repartition(2)
    got = {r.id: r.embeddings for r in hashed(df, "t", 16).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert np.allclose(got[1], Hashed(16)(["red red fox"])[0])
    lengths = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r.id: r.v for r in embed(df, "t", lengths, 2, "v", chunk=1).collect()}[1] == [12.0, 1.0]


def test_empty_tables(spark):
    from quarry.operators import reports, search

    e = spark.createDataFrame([], "id int, g string, c string, t string, x double, v array<double>")
    assert V.silhouettes(e, "id", "c", "v").count() == V.class_quality(e, "id", "c", "v").count() == 0
    assert V.nearest(e, ["id"], "v", V.centroids(e, "c", "v"), "c").count() == 0
    assert V.nearest_rows(e, "id", "v", e, "c").count() == 0
    assert stats.reliability(e.withColumn("ok", F.lit(1)), "x", "ok").count() == 0
    assert sampling.stratified_sample(e, "g", "id", 5, 2).count() == sampling.sample_over_shards(e, "g", "id", 5).count() == 0
    assert tfidf.keywords(e, "id", "t", "g", 5, most=2).count() == tfidf.class_tfidf(e, "t", "g", 5).count() == 0
    assert search.ranked(search.positions_index(e, "id", "t"), "id", ["house", "water"]).count() == 0
    assert reports.group_validation(e, "g", "c", "x").where("n > 0").count() == 0
    assert reports.classification_report(e.withColumn("s", F.col("c")).withColumn("d", F.col("c")), "c", "s", "d", "x", "t", "t", "id").where("n > 0").count() == 0
    assert reports.gold_template(e, "g", "t", "c", "id").count() == 0
    assert stats.size_figures(e, "g", 10).first().groups == 0


def test_calls_are_tried_again(spark):
    from quarry.functions import text as T
    from quarry.operators.remote import ask, replies

    waits, calls = [], []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise OSError("busy")
        return [p.upper() for p in prompts]

    assert replies(flaky, ["a", "b"], 2, 1.0, waits.append) == (["A", "B"], None) and waits == [1.0, 2.0]
    assert replies(lambda p: p[:1], ["a", "b"], 0, 1.0) == ([None, None], "ValueError: 1 replies to 2 prompts")

    def make():
        def client(prompts):
            if any("bad" in p for p in prompts):
                raise OSError("no")
            return ['x {"lcc": "%s", "confidence": 4}' % p[:2] for p in prompts]

        return client

    df = spark.createDataFrame([(1, "qd chemistry"), (2, None), (3, " "), (4, "qd chemistry")], "id int, p string")
    r = {x.id: x for x in ask(df, "p", make).select("id", "error", T.llm_reply(F.col("reply")).alias("r")).collect()}
    assert r[1].r.code == r[4].r.code == "QD" and r[1].r.confidence == 4 and r[2].error is None
    bad = ask(df.withColumn("p", F.lit("bad")), "p", make, retries=0).first()
    assert bad.reply is None and bad.error == "OSError: no"


def test_largest_rows_without_ranking_all(spark):
    from quarry.operators.stats import largest

    rows = [(f"t{i:04d}", i * i % 37) for i in range(2000)] + [("none", 0)]
    df = spark.createDataFrame(rows, "t string, n long").repartition(5)
    for size in (0, 1, 60, 777, 2000, 2001, 5000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
        if size:
            assert sorted(map(tuple, largest(df, "n", "t", size, keep=8).collect())) == sorted(want)
    assert largest(df.limit(0), "n", "t", 3).count() == 0
