import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from quarry.llm.components import components
from quarry.llm import induced
from quarry.llm.induced import Figures, Lanes, Text, repeated_windows, sorted_suffixes
from quarry.llm.simhash_dedup import fingerprint, links, near_duplicates, small_tile_links, tile_links
from quarry.llm.suffix_dedup import remove_repeats, repeat_digest


@given(st.lists(st.integers(1, 3), max_size=80), st.sampled_from([0, 40, 4096]), st.sampled_from([1, 4, 8192]), st.sampled_from([1, 2, 5, 200]))
@settings(max_examples=200, deadline=None)
def test_suffixes_and_common_prefixes(symbols, memory, lane, depth):
    symbols = [*symbols, 0]
    text = Text(len(symbols), 300, memory)
    text.coded[: len(symbols)] = symbols
    text.set_types()
    before, induced.LANE = induced.LANE, lane
    try:
        parts = list(sorted_suffixes(text, depth)) if len(symbols) > 1 else [([0], [0])]
    finally:
        induced.LANE = before
    order = [int(x) for p, _ in parts for x in p][::-1]
    shared = [int(x) for _, c in parts for x in c]
    head = lambda i: symbols[i : i + depth]
    assert sorted(order) == list(range(len(symbols)))
    assert all(head(a) <= head(b) for a, b in zip(order, order[1:]))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(head(a), head(b))) if x != y), min(len(head(a)), len(head(b))))
    assert shared[1:] == [common(a, b) for a, b in zip(order[::-1], order[::-1][1:])]


def test_lanes_come_back_in_order_of_arrival():
    lanes = Lanes(3, 16)
    for k in range(5):
        lanes.push(1, np.array([k, k + 20], np.int32), np.array([k, 9], np.uint8))
        lanes.push(2, np.array([k + 10], np.int32), np.array([1], np.uint8))
    position, common = lanes.take(1)
    assert position.tolist() == [x for k in range(5) for x in (k, k + 20)] and common.tolist() == [x for k in range(5) for x in (k, 9)]
    assert lanes.take(2)[0].tolist() == [10, 11, 12, 13, 14] and lanes.take(1)[0].tolist() == [] and lanes.spilled > 0
    lanes.close()


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=40), st.integers(0, 3)), max_size=12), st.sampled_from([0, 64, 1 << 22]))
@settings(max_examples=150, deadline=None)
def test_repeated_windows(rows, memory):
    rows = [(bytes(b % 3 for b in s), o) for s, o in rows]
    w = 8
    least = {}
    for s, o in rows:
        for i in range(len(s) - w + 1):
            least[s[i : i + w]] = min(o, least.get(s[i : i + w], o))
    expected = [i + w <= len(s) and least[s[i : i + w]] < o for s, o in rows for i in range(len(s))]
    got = repeated_windows(b"".join(s for s, _ in rows), np.array([len(s) for s, _ in rows], dtype=np.int64), np.array([o for _, o in rows]), w, memory)
    assert got.tolist() == expected


def test_large_shards_go_to_disk_and_recurse():
    draw = np.random.default_rng(4)
    base = draw.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    rows = [(base[int(a) : int(a) + 75], int(o)) for a, o in zip(draw.integers(0, 2900, 4000), draw.integers(0, 9, 4000))]
    text, sizes, owners = b"".join(s for s, _ in rows), np.array([len(s) for s, _ in rows]), np.array([o for _, o in rows])
    figures, memory = Figures(), 16 << 10  # a twentieth of the text, which alone has 300 KB
    found = repeated_windows(text, sizes, owners, 50, memory, figures)
    least = {}
    for s, o in rows:
        for i in range(26):
            least[s[i : i + 50]] = min(o, least.get(s[i : i + 50], o))
    assert found.tolist() == [i < 26 and least[s[i : i + 50]] < o for s, o in rows for i in range(75)]
    assert figures.spilled > 4 * len(text) and figures.levels > 2


def cut_brute(rows, window=50):
    least = {}
    for i, t in rows:
        for k in range(len(t) - window + 1):
            least[t[k : k + window]] = min(i, least.get(t[k : k + window], i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - window + 1):
            if least[t[k : k + window]] < i:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(out)


def test_suffix_dedup(spark):
    draw = np.random.default_rng(3)
    prose = lambda n: "".join(draw.choice(list("abcdé "), n))
    shared, line = prose(90), prose(60)
    rows = [(0, None), (1, ""), (2, "short"), (3, prose(200))]
    rows += [(10 + k, prose(int(draw.integers(0, 80))) + shared[k:] + prose(30) + line) for k in range(12)]
    rows += [(40, rows[4][1]), (41, rows[4][1]), (41, rows[4][1]), (42, "a" * 300), (43, "a" * 120), (44, "x" + "a" * 49), (45, shared[:50]), (5, shared[:49])]
    rows += [(60 + k, rows[6][1][: 100 + k] + "!" + rows[6][1][100 + k :]) for k in range(5)]
    df = spark.createDataFrame([(i, t, f"s{i}", 1) for i, t in rows], "doc_id long, text string, source string, split int")
    expected = cut_brute([(i, (t or "").encode()) for i, t in rows])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(df).collect())
    assert got == [e[:5] for e in expected] and sum(e[2] for e in expected) > 1000
    whole = remove_repeats(df)
    assert whole.columns == df.columns
    assert sorted((r.doc_id, r.text, r.source, r.split) for r in whole.collect()) == sorted((e[0], e[5], f"s{e[0]}", 1) for e in expected)
    assert repeat_digest(df.limit(0)).count() == 0
    # The same with small splits and shards, hot anchors, and queues on disk.
    for hot in (2, 8):
        small = repeat_digest(df, split_bytes=700, shard_bytes=300, hot_runs=hot, memory=100)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in small.collect()) == got


def test_suffix_dedup_of_null_ids_and_very_long_texts(spark):
    draw = np.random.default_rng(5)
    long = "".join(draw.choice(list("abcdef ghi"), 400_000))
    rows = [(None, long[100:400]), (7, long), (None, long[100:400]), (3, long[200_000:200_100]), (None, "own " * 30)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, row int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in repeat_digest(df).collect()), key=repr)
    assert got == sorted([(False, 3, 100, 0), (False, 7, 400_000, 100), (True, None, 300, 300), (True, None, 300, 300), (True, None, 120, 0)], key=repr)
    assert sorted(len(r.text) for r in remove_repeats(df).select("text", "row").collect()) == [0, 0, 100, 120, 399_900]


def test_fingerprint():
    def brute(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in ("", "  ", "One", "one two", "A b c", "a b c d É\x0bf", "x y " * 500):
        assert fingerprint(t) == brute(t)


def groups_brute(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(seed, n):
    draw = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        p = int(draw.integers(0, 1 << 63)) * 2
        for _ in range(int(draw.integers(1, 12))):
            q = p
            for b in draw.choice(64, int(draw.integers(0, 6)), replace=False):
                q ^= 1 << int(b)
            out.append(q)
    return out[:n]


@pytest.mark.parametrize(("tile", "blocks"), [(2, 1), (4096, 1), (4096, 2), (2, 3), (4096, 4)])
def test_links_lose_none(spark, tile, blocks):
    fps = sorted(set(clustered(1, 100) + [1 << k for k in range(12)] + [0]))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = links(df, tile=tile, blocks=blocks).distinct()
    roots = {r.node: r.root for r in components(found).collect()}
    label = [roots.get(int(np.uint64(x).astype(np.int64)), int(np.uint64(x).astype(np.int64))) for x in fps]
    expected = groups_brute(fps)
    assert len(set(zip(label, expected))) == len(set(label)) == len(set(expected))


def test_tiles_agree():
    fps = np.unique(np.array(clustered(2, 300), dtype=np.uint64))
    a = tile_links(fps, fps)
    b = small_tile_links(np.zeros(len(fps), dtype=np.int64), fps)
    names = {x: i for i, x in enumerate(fps.tolist())}
    expected = groups_brute(fps.tolist())
    for x, y in (a, b):
        parent = list(range(len(fps)))

        def find(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for p, q in zip(x.tolist(), y.tolist()):
            p, q = find(names[p]), find(names[q])
            parent[max(p, q)] = min(p, q)
        assert [find(k) for k in range(len(fps))] == expected


def test_blocks_follow_the_number_of_fingerprints():
    from quarry.llm.simhash_dedup import band_masks, blocks_for

    assert [blocks_for(n) for n in (0, 10**8, 10**9, 10**12, 10**14)] == [1, 1, 2, 3, 4]
    assert [len(band_masks(k)) for k in (1, 2, 3, 4)] == [4, 10, 20, 35] and sum(band_masks(1)) == -1


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base + " extra"), (1, None), (7, ""), (8, "other words here"), (8, "other words here")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    fps = [fingerprint(t or "") for _, t in rows]
    group = groups_brute(fps)
    ids = [min(r[0] for r, g in zip(rows, group) if g == k) for k in group]
    assert got == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, ids))
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(900, 800), (800, 850), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[900] == got[850] == got[800] == 800
