"""The stored index against the search without one."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators import search_index as S

WORD = st.text("abc", min_size=0, max_size=12)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(WORD, st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "a", "b", "c", "d"]), st.booleans()), max_size=2))
@settings(max_examples=500, deadline=None)
def test_near_words_share_a_variant(word, changes):
    other = word
    for at, letter, replace in changes:
        at = min(at, len(other))
        other = other[:at] + letter + other[at + (replace or not letter) :]
    for typos in (1, 2):
        if edits(word, other) <= typos:
            assert S.variants_of(word, typos) & S.variants_of(other, 2)


def test_variants_in_spark(spark):
    words = ["a", "ab", "aab", "house", "vereinsten", "日本語é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.variants(F.col("w")).alias("v"), S.bucket(F.col("w"), 7).alias("b")).collect()
    for r in rows:
        assert set(r.v) == S.variants_of(r.w) and len(r.v) == len(set(r.v)) and r.b == S.bucket_of(r.w, 7)


def text(seed, n=30):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice("house houses hause forest forrest tree near the of mouse wooden woodden".split(), n))


WORDS = ["house", "forest", "wooden", "of"]


def found(df):
    return sorted((r[0], r.matched, r.typos, r.proximity) for r in df.collect())


def test_search_and_upserts(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = {i: text(i, 3 + i % 9) for i in range(40)} | {100: None, 101: "", 102: "nothing"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, t string")
    expected = lambda: found(search.ranked(search.positions_index(frame(docs), "id", "t"), "id", WORDS))
    got = lambda: found(S.search(spark, path, WORDS, buckets=8))
    assert S.committed(spark, path) == []
    S.upsert(frame(docs).unionByName(spark.createDataFrame([(None, "house"), (3, docs[3])], "id long, t string")), path, "id", "t", 0, 8)
    assert got() == expected() != []
    change = {1: "a wooden house", 2: None, 200: text(200), 102: "forest"}
    docs |= change
    for _ in range(2):  # the same batch again, as after a crash
        S.upsert(frame(change), path, "id", "t", 1, 8)
        assert got() == expected()
    (tmp_path / "index" / "changes" / "batch=2").mkdir()  # a batch that broke off
    assert S.committed(spark, path) == [0, 1] and got() == expected()
    S.compact(spark, path, 3)
    assert S.committed(spark, path) == [3] and got() == expected()
    docs |= {200: "house", 5: None}
    S.upsert(frame({200: "house", 5: None}), path, "id", "t", 4, 8)
    assert S.committed(spark, path) == [3, 4] and got() == expected()


def test_one_bucket_for_a_term(spark, tmp_path):
    path = str(tmp_path / "index")
    S.upsert(spark.createDataFrame([(i, text(i)) for i in range(30)], "id long, t string"), path, "id", "t", 0, 64)
    plan = S.search(spark, path, ["tree", "near"], buckets=64)._jdf.queryExecution().executedPlan().toString()
    wanted = {S.bucket_of("tree", 64), S.bucket_of("near", 64)}
    filters = re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]
    assert all(str(b) in filters for b in wanted) and "term" in re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "MOST_TERMS", 0)
        with pytest.raises(ValueError):
            S.search(spark, path, ["tree"], buckets=64)


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert S.search(spark, path, WORDS).count() == 0
    S.upsert(spark.createDataFrame([], "id long, t string"), path, "id", "t", 0)
    assert S.committed(spark, path) == [0] and S.search(spark, path, WORDS).count() == 0
