"""What the findings of round 3 were about: results against SQL on rows that sf0.01 lacks, and batches of bounded size."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import density, hierarchy, languages, search, search_index, tfidf
from quarry.operators import neighbours as N
from quarry.operators import vectors as V
from quarry.plans.all import ORACLE_SQL, QUERIES


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def sql(path, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall()


def test_low_confidence_orders_by_the_rounded_figure(spark, tmp_path):
    """Forty papers of nearly the same confidence, the lower ones under the larger ids."""
    documents = [(i, f"text {i}", "en", "src0", 6) for i in range(40)]
    vectors = [(i, [0.025 - i * 1e-8, 0.1], i % 10) for i in range(40)]
    path = written(spark, tmp_path, documents=(documents, "doc_id long, text string, lang string, source string, n_chars long"), embeddings=(vectors, "vec_id long, embedding array<float>, label int"))
    got = [tuple(r) for r in QUERIES["g5_low_confidence"](spark, path).collect()]
    assert got == sql(path, "g5_low_confidence", "documents", "embeddings")
    assert [r[0] for r in got] == list(range(20))


def peak_of(monkeypatch, made, batches, name="run"):
    """(MB at most, rows of a batch at most) of the first function `name` that `made()` hands to mapInArrow, run here over some
    batches."""
    import tracemalloc

    from pyspark.sql.classic.dataframe import DataFrame

    found, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *a, **b: (run.__name__ == name and found.append(run)) or real(self, run, *a, **b))
    made()
    tracemalloc.start()
    try:
        rows = max(b.num_rows for b in found[0](iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_held_out_rows_meet_blocks_of_rows(spark, monkeypatch):
    """4,000 held-out rows and a batch of 10,000: their products (320 MB) are never there at once, and ties go to the least key."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(10_000, 4))
    x[7000] = x[20] = [30, 0, 0, 0]
    held = spark.createDataFrame([(i, "a", [1.0, float(i) / 4000, 0.0, 0.0]) for i in range(4000)], "id long, label string, v array<double>")
    schema = "id long, label string, v array<double>"
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))[::-1], "label": ["b"] * 10_000, "v": x.tolist()})
    df = spark.createDataFrame([], schema)
    most, _ = peak_of(monkeypatch, lambda: V.nearest_rows(df, "id", "v", held, "label"), [batch])
    assert most < 80
    rows = spark.createDataFrame([(i, "b", v) for i, v in zip(range(9_999, -1, -1), x.tolist())], schema)
    got = V.nearest_rows(rows, "id", "v", held.where("id = 0"), "label").first()
    assert (got.near_key, got.sim) == (2999, 30.0)


def test_rows_meet_many_classes_in_slices(spark, monkeypatch):
    classes = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(2000)], "c int, centroid array<double>")
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000)), "v": [[1.0, -1.0]] * 10_000})
    most, _ = peak_of(monkeypatch, lambda: V.nearest(spark.createDataFrame([], "id long, v array<double>"), ["id"], "v", classes, "c"), [batch])
    assert most < 60


def test_queries_go_out_to_groups_of_tiles(spark, monkeypatch):
    """Vectors without groups, so that every query meets all of some 40 tiles; it goes out twice (the first time to its nearest
    tile), in batches of a bounded size."""
    monkeypatch.setattr(N, "FEWEST", 1 << 16)
    x = np.random.default_rng(5).normal(size=(1600, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    members, tiles = N.tiled(df, "id", "v")
    batch = pa.RecordBatch.from_pydict({"key": list(range(1600)), "comp": list(range(1600)), "core": [0.0] * 1600, "bound": [100.0] * 1600, "seen": pa.nulls(1600, pa.list_(pa.int32())), "vector": x.tolist()})
    asked = members.select("key", F.col("key").alias("comp"), F.lit(0.0).alias("core"), F.lit(100.0).alias("bound"), F.lit(None).cast("array<int>").alias("seen"), "vector")
    own = members.withColumn("comp", F.col("key")).withColumn("core", F.lit(0.0))
    _, rows = peak_of(monkeypatch, lambda: N.met(own, asked, tiles, 3, lambda least, bound, count: least <= bound[:, None]), [batch], "sent")
    assert len(tiles.cell) > 20 and rows <= 2048


def test_neighbours_over_several_groups_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_NUMBERS", 300)
    monkeypatch.setattr(N, "QUERIES", 50)
    monkeypatch.setattr(N, "FEWEST", 10)
    x = np.round(np.random.default_rng(6).normal(size=(400, 3)) * 10)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = {r.key: [(f.near, f.cost) for f in r.found] for r in N.neighbours(*N.tiled(df, "id", "v"), 5).collect()}
    for i in range(400):
        gap = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((c, j) for j, c in enumerate(gap.tolist()) if j != i)[:5]
        assert [j for j, _ in got[i]] == [j for _, j in want]
        assert np.allclose([c for _, c in got[i]], [c for c, _ in want], atol=1e-12)


def test_rare_terms_are_dropped_before_terms_meet(spark, monkeypatch):
    """Terms t0 to t1999, t0 the most frequent, with ties; most of them can't be among the first 20."""
    monkeypatch.setattr(tfidf, "BUCKETS", 512)
    counts = spark.createDataFrame([(f"t{i}", g, 2000 // (i + 1)) for i in range(2000) for g in "ab"], "term string, g string, tf long")
    kept = tfidf.frequent(counts, 20)
    assert kept.count() < 0.5 * counts.count()
    order = lambda df: sorted(map(tuple, tfidf.vocabulary(df, 20).collect()))
    assert order(kept) == order(counts)
    few = spark.createDataFrame([("a", "g", 1), ("b", "g", 1)], counts.schema)
    assert tfidf.frequent(few, 20).count() == 2 and tfidf.frequent(counts.limit(0), 20).count() == 0


def test_a_search_without_an_index_makes_postings_of_its_own_terms_only(spark, monkeypatch):
    d = spark.createDataFrame([(1, "House of erth, hause; erth"), (2, "vereinst house"), (3, None), (4, "nothing"), (4, "erth nothing house")], "k long, t string")
    words = ["house", "vereinst", "erth"]
    whole = search.ranked(search.positions_index(d, "k", "t"), "k", words)
    seen, real = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda index, *a, **b: seen.append(index) or real(index, *a, **b))
    assert sorted(map(tuple, search.ranked_texts(d, "k", "t", words).collect())) == sorted(map(tuple, whole.collect()))
    assert {r.term for r in seen[0].collect()} == {"house", "hause", "erth", "vereinst"}


def test_words_and_trigrams_are_counted_some_at_a_time(spark, monkeypatch):
    """2,000 rows of 500 words, about 5 MB of text."""
    draw = np.random.default_rng(4)
    words = [[f"w{x}" for x in row] for row in draw.integers(0, 50_000, (2000, 500)).tolist()]
    empty = spark.createDataFrame([], "k long, t string, lang string")
    batch = pa.RecordBatch.from_pydict({"k": list(range(2000)), "_words": words})
    most, _ = peak_of(monkeypatch, lambda: tfidf.term_counts(empty, ["k"], tfidf.tokens(F.col("t")), 2), [batch])
    print("term_counts", most)
    assert most < 40
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"] * 1000, "text": [" ".join(x) for x in words]})
    monkeypatch.undo()
    most, _ = peak_of(monkeypatch, lambda: languages.learn(empty, "t", "lang"), [batch])
    print("trigrams", most)
    assert most < 60


def counted(df, total):
    """The rows of df, each counted whenever it is made."""

    def run(batches):
        for batch in batches:
            total.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_outliers_are_cut_into_words_once(spark, monkeypatch):
    """Eight topics of some 25 terms: in parts of two their texts are read as often as in one part."""
    schema = "id int, topic int, t string"
    known = spark.createDataFrame([(10 * k + j, k, f"reef own{k}a tide own{k}b shore own{k}c") for k in range(8) for j in range(3)], schema)
    rest, read = spark.createDataFrame([(100 + i, -1, f"own{i}a reef own{i}c lost") for i in range(8)], schema), []
    for numbers in (1 << 20, 60):
        monkeypatch.setattr(hierarchy, "BROADCAST_NUMBERS", numbers)
        total = spark.sparkContext.accumulator(0)
        got = hierarchy.reassigned(known.unionByName(counted(rest, total)), "id", "topic", "t", 0.05, most=1, least_df=1).collect()
        assert {r.id - 100: r.topic for r in got} == {i: i for i in range(8)}
        read.append(total.value)
    assert read[0] == read[1]


def test_topics_are_weighed_and_vectors_made_once(spark, monkeypatch):
    draw, total, made, real = np.random.default_rng(7), spark.sparkContext.accumulator(0), [], hierarchy.unit_weights
    rows = [(20 * k + j, f"own{k}a own{k}b reef", (np.eye(6)[k] * 4 + draw.normal(0, 0.05, 6)).tolist()) for k in range(4) for j in range(20)]
    df = counted(spark.createDataFrame(rows, "id long, t string, v array<double>"), total)
    monkeypatch.setattr(hierarchy, "unit_weights", lambda *a, **b: made.append(a) or real(*a, **b))
    documents, levels = hierarchy.density_topics(df, "id", "t", "v", 8, 3, [0.4], most=1, share=1.0, least_df=1)
    assert documents.count() == 80 and levels.count() == 4
    assert len(made) == 1 and total.value <= 4 * len(rows)


def test_settings_of_a_grid_share_a_trees_edges(spark, monkeypatch):
    """A path of 40 points, two settings of one tree: its edges and points come to the driver once."""
    from pyspark.sql.classic.dataframe import DataFrame

    tree = spark.createDataFrame([(i, i + 1, 9.0 if i == 19 else 1.0 + i / 100) for i in range(39)], "a long, b long, w double")
    weights = spark.createDataFrame([(i, 1, 1.0) for i in range(40)], "key long, weight long, core double")
    p = density.Points(weights.select(F.col("key").alias("id"), "key"), None, None, None, 8, 40)
    x = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "id long, v array<double>")
    monkeypatch.setattr(density, "points", lambda *a: p)
    monkeypatch.setattr(density, "cores", lambda *a: weights)
    monkeypatch.setattr(density, "spanning_tree", lambda *a: tree)
    fetched, real = [], DataFrame.toArrow

    def counting(self):
        out = real(self)
        if out.column_names in (["a", "b", "w"], ["comp", "n"], ["key", "weight"]):
            fetched.append(out.num_rows)
        return out

    monkeypatch.setattr(DataFrame, "toArrow", counting)
    results, _ = density.tuned(x, "id", "v", (2, 60), [(5, 2), (10, 2)])
    assert [r["clusters"] for r in results] == [2, 2]
    assert sum(fetched) == 39 + 40


def weights_of(docs, size=None):
    """{(key, group): {term: weight}} by plain Python: rows of one key and group are one vector of all their terms."""
    from collections import Counter, defaultdict
    from math import log, sqrt

    rows = []
    for key, group, text in docs:
        words = [] if text is None else text.split()
        rows.append((key, group, Counter(words + [" ".join(p) for p in zip(words, words[1:])])))
    df, total = Counter(t for *_, c in rows for t in c), Counter()
    for *_, c in rows:
        total.update(c)
    known = {t for t, n in df.items() if n >= 2} & set(sorted(total, key=lambda t: (-total[t], t))[:size])
    found = defaultdict(list)
    for key, group, c in rows:
        found[key, group] += [(t, (1 + log(n)) * (log((1 + len(docs)) / (1 + df[t])) + 1)) for t, n in c.items() if t in known]
    return {k: sorted((t, round(w / sqrt(sum(x * x for _, x in v)), 9)) for t, w in v) for k, v in found.items() if v}


def drawn_texts(repeated):
    draw = np.random.default_rng(8)
    docs = [(i, f"g{i % 3}", " ".join(f"w{x}" for x in draw.zipf(1.4, 1 + i % 40) % 300)) for i in range(120)] + [(200, "g0", None), (201, None, "w1 w1 w2"), (202, "g1", "")]
    return docs + [(3, "g0", "w1 w2 w9"), (3, "g1", "w1"), (None, "g1", "w2 w3"), (None, "g1", "w3 w1")] * repeated


def weighed(spark, docs, **how):
    from collections import defaultdict

    df = spark.createDataFrame(docs, "id long, g string, t string")
    made, got = tfidf.tfidf(df, "id", "t", most=2, keep=("g",), **how), defaultdict(list)
    for r in made.collect():
        got[r.id, r.g].append((r.term, round(r.weight, 9)))
    return {k: sorted(v) for k, v in got.items()}, made._jdf.queryExecution().executedPlan().toString()


def test_a_vocabulary_goes_to_the_texts(spark):
    """Documents with one row each aren't shuffled; rows that share a key meet, but their terms don't go there one by one."""
    for repeated in (0, 1):
        docs = drawn_texts(repeated)
        got, plan = weighed(spark, docs, size=60)
        assert got == weights_of(docs, 60)
        assert ("Exchange" in plan) == bool(repeated) and "collect_list" not in plan


def test_chunks_ask_for_the_numbers_of_their_terms(spark, monkeypatch):
    """Some ten chunks and buckets: what is shuffled is texts, and a row for a chunk and bucket, not one for a term."""
    monkeypatch.setattr(tfidf, "CHUNK_CHARS", 800)
    monkeypatch.setattr(tfidf, "BUCKET_CHARS", 1000)
    for repeated in (0, 1):
        docs = drawn_texts(repeated)
        got, plan = weighed(spark, docs)
        assert got == weights_of(docs)
        assert "hashpartitioning(term" not in plan and "collect_list" not in plan
    df = spark.createDataFrame(docs, "id long, g string, t string").select((F.coalesce("id", F.lit(0)) % 7).cast("int").alias("chunk"), F.split("t", " ").alias("_words"))
    asked = tfidf.rows_with_terms(df, 2, 9)
    assert 7 < asked.count() <= 7 * 9


def test_sums_are_not_dealt_by_group(spark):
    """Groups' sizes go to the sums, however large these are thought to be; of a group only its first terms meet."""
    df = spark.createDataFrame(drawn_texts(0), "id long, g string, t string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tfidf.keywords(df, "id", "t", "g", 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and plan.index("hashpartitioning(g") < plan.index("WindowGroupLimit [g", plan.index("hashpartitioning(g"))


def edited(draw, word, times):
    """The word after some edits, each of which takes out, puts in or replaces a letter."""
    for _ in range(times):
        at, kind = int(draw.integers(0, len(word) + 1)), draw.integers(0, 3)
        word = word[:at] + "abcde"[draw.integers(0, 5)] * int(kind > 0) + word[at + int(kind != 1) :]
    return word


def test_near_terms_share_a_piece_of_few(spark):
    """Every term that a search of all terms finds has a piece that is looked up; a term leaves five rows at most (variants: up to 37)."""
    draw = np.random.default_rng(9)
    words = ["".join("abc"[x] for x in draw.integers(0, 3, 1 + i % 16)) for i in range(300)] + ["日本語éab", "vereinsten"]
    terms = sorted({edited(draw, w, times) for w in words for times in (0, 1, 1, 2, 2, 2)})
    rows = spark.createDataFrame([(t,) for t in terms], "term string").coalesce(1)
    own = {r.term: set(r.p) for r in rows.select("term", search_index.pieces(F.col("term")).alias("p")).collect()}
    assert max(map(len, own.values())) == 5
    near, missed, looked = 0, [], 0
    for r in search.matching_terms(rows, words[:60] + words[-2:]).collect():
        word = (words[:60] + words[-2:])[r.i]
        most = search.allowed_typos(word)
        near += r.typos > 0
        if most and not own[r.term] & search_index.pieces_of(word, most):
            missed.append((word, r.term))
    assert near > 100 and not missed
    for letters in range(1, 40):  # lengths of words that allow typos, and of their terms
        most = search.allowed_typos("x" * letters)
        if most:
            fewest, longest = search_index.LETTERS[most]
            assert fewest <= letters - most and letters + most <= (longest or 99) and fewest > most


def test_an_index_with_variants_is_searched_and_compacted(spark, tmp_path):
    """Batch 0 as earlier versions wrote it, batch 1 with pieces."""
    path, words = str(tmp_path / "index"), ["house", "wooden", "vereinsten"]
    frame = lambda d: spark.createDataFrame(d, "id long, t string")
    first, second = [(1, "hause wodden vereisten"), (2, "houses"), (3, "nothing")], [(3, "vereinten woodn"), (4, "hose")]
    search_index.upsert(frame(first), path, "id", "t", 0, 4)
    terms = search_index.stored(spark, path, [0], "postings").select("term").distinct()
    old = terms.select("term", F.explode(search_index.variants(F.col("term"))).alias("variant")).withColumn("bucket", search_index.bucket(F.col("variant"), 4))
    old.write.partitionBy("bucket").parquet(f"{path}/variants/batch=0")
    (tmp_path / "index" / "pieces" / "batch=0").rename(tmp_path / "taken")
    search_index.upsert(frame(second), path, "id", "t", 1, 4)
    want = sorted(map(tuple, search.ranked(search.positions_index(frame(first[:2] + second), "id", "t"), "id", words).collect()))
    got = lambda: sorted(map(tuple, search_index.search(spark, path, words, buckets=4).collect()))
    assert got() == want and len(want) == 4
    search_index.compact(spark, path, 2)
    assert got() == want


def test_vectors_of_a_batch_are_copied_a_block_at_a_time():
    """10,000 vectors of 128 numbers are 10 MB as a matrix; what else is there at once is smaller than that."""
    import tracemalloc

    numbers = np.random.default_rng(2).normal(size=(10_000, 128))
    numbers[5000, 3] = np.nan
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 10_000 * 128 + 1, 128), pa.int32()), pa.array(numbers.ravel()))
    tracemalloc.start()
    x, fits = V.batch_matrix(lists, 128)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 18 and fits.all() and np.array_equal(x, np.nan_to_num(numbers))
    mixed = pa.array([[1.0, 2.0], None, [1.0], [3.0, 4.0]] * 1500, pa.list_(pa.float64()))
    x, fits = V.batch_matrix(mixed, 2)
    assert fits.tolist() == [True, False, False, True] * 1500 and np.array_equal(x, np.array([[1, 2], [0, 0], [0, 0], [3, 4]] * 1500))


def test_an_encoder_remembers_some_words_only():
    import tracemalloc

    from quarry.operators.embed import Hashed

    encoder, words = Hashed(16), [f"word{i}" for i in range(150_000)]
    tracemalloc.start()
    first = encoder([" ".join(words[i : i + 1000]) for i in range(0, 150_000, 1000)])
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 16 and np.array_equal(first[-1:], Hashed(16)([" ".join(words[-1000:])]))
