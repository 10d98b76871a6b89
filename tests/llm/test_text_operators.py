import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_rules, url_filters
from quarry.llm.decontamination import RADIUS, Benchmark, Items, contaminated, simhash
from quarry.llm.language_id import fit as fit_languages
from quarry.llm.language_id import held_out
from quarry.llm.language_id import predict as predict_language
from quarry.llm.lm_scoring import MU, Automaton, Split, lm_scores
from quarry.llm import quality_classifier
from quarry.llm.quality_classifier import BUCKETS, FACTORS, PENALTY, STEP, STRUCTURE, Machine, features, quality_scores, sample, train

SF = "/root/testdata/sf0.001"
WORDS = "the of tion and er thand ing reat is on or est al nd".split()


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS, n)) + "."


def same_rows(spark, df, con, sql):
    cols = sorted(df.columns)
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    form = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    mine = sorted((tuple(form(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert mine == sorted((tuple(form(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


ODD = [None, "", " \n\t ", "one", "a b a b a b", "x\ny\nx\n\n \nx", "the #1 | <b>", "é　ß\x0bz\x85q", "a " * 200, prose(1, 80), prose(1, 80)]


def test_quality_rules(spark):
    df = spark.createDataFrame([(i, t, "row", 0) for i, t in enumerate(ODD)], "doc_id long, text string, words string, n_words long")
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"text": object}))
    con.execute("create table d as select doc_id, text from documents")
    con.unregister("documents")
    con.execute("alter table d rename to documents")
    same_rows(spark, quality_rules.quality_rules(df), con, quality_rules.oracle())
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert (got[4].n_words, got[4].n_repeat_words, got[5].n_dup_lines, got[6].n_symbols) == (6, 6, 2, 4)
    assert got[0].n_words == got[1].n_words == 0 and got[0].base_failed and not got[8].kept
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_filters_on_figures_copy_nothing(spark):
    df = spark.createDataFrame([(i, prose(i, 2000)) for i in range(4)], "doc_id long, text string")
    for judged in (quality_rules.quality_rules(df).where("kept"), quality_rules.text_figures(df).where("n_repeat_words > 3 and n_words > 7"), quality_rules.keep_good(df)):
        plan = judged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sort_array(transform(sequence") == 1
    assert quality_rules.quality_rules(df).where("n_repeat_words > 3").count() == 4


def test_very_long_texts(spark):
    """Texts of 200,000 words and more, through the operators that read them whole."""
    long = prose(77, 200_000)
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, prose(78, 60))], "doc_id long, text string")
    r = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    assert r[1].n_words == 200_000 and r[1].base_failed
    from quarry.llm.simhash_dedup import near_duplicates

    groups = {x.doc_id: x.component_id for x in near_duplicates(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    model = fit_languages(df.withColumn("lang", F.lit("en")))
    assert {x.lang_pred for x in predict_language(df, model).collect()} == {"en"}
    scores = {x.doc_id: x.score for x in quality_scores(df, Machine()).collect()}
    assert scores[1] == 0.5
    urls = spark.createDataFrame([(1, "http://example.com/en/7" + "a" * 500_000), (2, "x" * 500_000)], "page_id long, url string")
    assert {x.page_id: x.rule for x in url_filters.url_filter(urls).collect()} == {1: "example.com/en/7", 2: None}


def test_url_filters(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "http://example.com/en/8", "http://a.b.com/en/", "https://x.org/es/1#t",
        "ftp://h.net", "http://h.net/de/8/../", "http://example.net/de/81", "http://q.example.net/de/9", "://", "http://?/en/", "http://notcom/en/1",
    ]
    rows = list(enumerate(urls)) + [(100 + i, f"http://spam.example.com/en/{i + 80}") for i in range(9)] + [(200, "http://spam.example.com/de/1")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    same_rows(spark, url_filters.url_filter(df), con, url_filters.oracle())
    got = {r.page_id: r for r in url_filters.url_filter(df).collect()}
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[5].rule == "com/en/" and got[13].rule is None and (got[0].host, got[2].path) == ("", "")
    assert got[9].rule == "example.net/de/8" and got[10].rule == "net/de/" and got[200].verdict == "block"
    assert url_filters.url_filter(df.limit(0)).count() == 0


def test_language_id(spark):
    de = "der die das und nicht mit auf haus wasser ".split()
    rows = [(i, " ".join(np.random.default_rng(i).choice(WORDS if i % 2 else de, 30)), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, "unknown", None), (101, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(df)
    new = spark.createDataFrame([(1, "Der Wasserhaus!"), (2, "thationing"), (3, None), (4, "12 !"), (5, ""), (5, "the")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in predict_language(new, model).collect())
    assert got == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "en"), (5, "und")]
    assert all(0 <= r.score <= 1 for r in predict_language(new, model).collect())
    assert predict_language(new, fit_languages(df.limit(0))).select("lang_pred").distinct().first()[0] == "und"
    assert [r.h for r in df.where("doc_id < 5").select(held_out(F.col("doc_id"), 4, 2).alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(5)]


def languages_brute(train, new):
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({x for _, t, x in train if x is not None and letters(t)})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    cut = lambda w: [f"<{w}>"[i : i + k] for k in range(1, 6) for i in range(len(w) + 3 - k)]
    for _, t, x in train:
        for w in letters(t) if x is not None else []:
            words[x][w] += 1
            grams[x].update(cut(w))
    n_words, n_grams = len(set().union(*words.values())), len(set().union(*grams.values()))
    log = lambda c, n, key: np.array([np.log((c[x][key] + 0.1) / (c[x].total() + 0.1 * (n + 1))) for x in langs])
    out = []
    for i, t in new:
        total = np.zeros(len(langs))
        for w in letters(t):
            if any(words[x][w] for x in langs):
                total += log(words, n_words, w)
                continue
            padded, at = f"<{w}>", 0
            while at < len(padded):
                size = next((k for k in range(min(5, len(padded) - at), 0, -1) if any(grams[x][padded[at : at + k]] for x in langs)), 0)
                total += log(grams, n_grams, padded[at : at + size]) if size else 0
                at += size or 1
        weight = np.exp(total - total.max())
        out.append((i, langs[int(weight.argmax())], weight.max() / weight.sum()) if any(map(str.isalpha, t or "")) else (i, "und", 0.0))
    return sorted(out, key=repr)


def language_rows(spark, train, new):
    model = fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = predict_language(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    return sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=repr)


def test_language_id_keeps_all_languages_and_long_words(spark):
    train = [(i, " ".join(np.random.default_rng(i).choice(WORDS, 5)) + f" {'xyz'[i % 3] * (45 + i // 3)} {chr(0x4E00 + i) * 2}", f"l{i:02}") for i in range(70)]
    new = [(i, f"{'xyz'[i % 3] * (45 + i // 3)} unseen{chr(0x4E00 + i)}") for i in range(70)]
    new += [(300 + i, "xyz"[i % 3] * (45 + i // 3)) for i in range(70)]
    new += [(None, "the of"), (200, None), (201, "12 !"), (202, "½"), (203, "reat-ing reating"), (203, "\U0001F600 \u05D0"), (204, "")]
    got, expected = language_rows(spark, train, new), languages_brute(train, new)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected])
    assert {(300 + i, f"l{i:02}") for i in range(70)} <= {g[:2] for g in got}


def test_language_id_keeps_rare_words_and_grams(spark):
    frequent = [chr(0x4E00 + a) + chr(0x4E00 + b) for a in range(250) for b in range(250)]
    train = [(1, " ".join(frequent * 2), "a"), (2, "zzyx", "b"), (3, "qqv", "c")]
    got = language_rows(spark, train, [(1, "zzyx"), (2, "zzyxx"), (3, "qqv"), (4, frequent[0])])
    assert [g[:2] for g in got] == [(1, "b"), (2, "b"), (3, "c"), (4, "a")]


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(d.where(~held_out(d.doc_id, 4, 2)))
    r = predict_language(d.where(held_out(d.doc_id, 4, 2)), model).join(d, "doc_id")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_factorisation_identity():
    draw = np.random.default_rng(0)
    size = BUCKETS + STRUCTURE
    m = Machine(0.3, draw.normal(size=size), draw.normal(size=(size, FACTORS)))
    ids, x = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    z, _, _ = m.raw(ids, x, np.array([0]))
    assert z[0] == pytest.approx(0.3 + m.w[ids] @ x + pairs)


def test_quality_classifier(spark):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).replace(" ", "$$$ ")) for i in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(500, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(df, train(df, labels)).collect()}
    assert all(got[i].predicted == i % 2 for i in range(80)) and all(0 <= r.score <= 1 for r in got.values()) and 90 in got
    assert quality_scores(df, train(df, labels.limit(0))).select("score").distinct().first()[0] == 0.5
    assert quality_scores(df.limit(0), Machine()).count() == 0


def test_classifier_features():
    text = "Good GOOD day! 12 #\nsame line\n\nsame line"
    ids, x = features(text, 50)
    words = text.split()
    expected = Counter(zlib.crc32(w.lower().encode()) % BUCKETS for w in words)
    n, size = len(words), len(text)
    assert dict(zip(ids[:-STRUCTURE].tolist(), x[:-STRUCTURE].tolist())) == pytest.approx({b: math.sqrt(c / n) for b, c in expected.items()})
    assert ids[-STRUCTURE:].tolist() == list(range(BUCKETS, BUCKETS + STRUCTURE))
    figures = [1 / n, 1 / n, 1 / n, 1 - 7 / n, 1 - 2 / 3, size / n / 20, math.log1p(n) / 12, 2 / size, 4 / 100, 3 / n, math.log1p(50) / 14, (50 - size) / size]
    assert x[-STRUCTURE:].tolist() == pytest.approx(figures, rel=1e-5)
    assert features("", None)[1].tolist() == pytest.approx([0] * 5 + [1 / 20] + [0] * 6) and len(features("x " * 300_000)[0]) == 1 + STRUCTURE


def test_classifier_step(monkeypatch):
    """One step of the fit against the formula of the whole pairwise sum, feature by feature."""
    rows, y = [features(prose(i, 12), 40 + i) for i in range(6)], np.array([1, 0, 1, 1, 0, 0.0])
    monkeypatch.setattr(quality_classifier, "EPOCHS", 0)
    before = quality_classifier.fit(rows, y)
    monkeypatch.setattr(quality_classifier, "EPOCHS", 1)
    after = quality_classifier.fit(rows, y)
    dw, dv, d0 = np.zeros(len(before.w)), np.zeros(before.v.shape), 0.0
    for (ids, x), label in zip(rows, y):
        pairs = sum(before.v[i] @ before.v[j] * a * b for k, (i, a) in enumerate(zip(ids, x)) for j, b in zip(ids[:k], x[:k]))
        error = 1 / (1 + math.exp(-(before.w0 + before.w[ids] @ x + pairs))) - label
        d0 += error / 6
        for i, a in zip(ids, x):
            dw[i] += error * a / 6
            dv[i] += error * a / 6 * sum(before.v[j] * b for j, b in zip(ids, x) if j != i)
    used = np.unique(np.concatenate([r[0] for r in rows]))
    dv[used] += PENALTY * before.v[used]
    assert np.allclose(after.w, before.w - STEP * dw / np.sqrt(1e-2 + dw**2), atol=1e-5)
    assert np.allclose(after.v, before.v - STEP * dv / np.sqrt(1e-2 + dv**2), atol=1e-5)
    assert after.w0 == pytest.approx(-STEP * d0 / math.sqrt(1e-2 + d0**2), rel=1e-4)


def test_classifier_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(2000)] + [(7, 1)] * 3000, "id long, y int")
    found = sample(rows, 300)
    assert 200 < found.count() <= 300 and found.where("id = 7").count() == 0
    assert sample(rows, 5000).count() == 5000


def lm_brute(rows, training):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [" "]
    c, b, d = Counter(), Counter(), Counter()
    for (_, t), held in zip(rows, training):
        if held:
            w = ["  ", *tok(t)]
            c.update(w[1:])
            b.update(zip(w, w[1:]))
            d.update(zip(w, w[1:], w[2:]))
    n, v = sum(c.values()), len(c)
    h = dict(c) | {"  ": c[" "]}
    one = lambda x: (c[x] + 1) / (n + v + 1)
    two = lambda p, x: (b[p, x] + MU * one(x)) / (h.get(p, 0) + MU)
    three = lambda o, p, x: (d[o, p, x] + MU * two(p, x)) / (b[o, p] + MU)
    out = []
    for i, t in rows:
        w = ["  ", *tok(t)]
        base = sum(math.log10(one(x)) for x in w[1:])
        score = math.log10(two(*w[:2])) + sum(math.log10(three(*x)) for x in zip(w, w[1:], w[2:]))
        out.append((i, len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("training", ["doc_id % 3 > 0", "doc_id < 0"])
def test_lm_scores(spark, training):
    rows = [(i, prose(i, 3 + i)) for i in range(30)] + [(40, None), (41, ""), (42, "A b É"), (1, "twice"), (1, "twice"), (43, prose(7, 5000))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(df, F.expr(training)).collect())
    held = [i % 3 > 0 if "%" in training else False for i, _ in rows]
    expected = lm_brute(rows, held)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:] for g in got], [e[4:] for e in expected], atol=2e-6)
    assert lm_scores(df.limit(0), F.lit(True)).count() == 0


def automaton(texts):
    """The automaton of some texts, all for training, and their split."""
    split = Split(texts, np.ones(len(texts), bool))
    pairs = np.bincount(split.triple_pair, weights=split.triple_counts, minlength=len(split.pairs)).astype(np.int64)
    words = split.word_counts()
    return split, Automaton(split, words, pairs, split.triple_counts, int(words.sum()), int((words > 0).sum()))


def test_lm_states_sum_to_one():
    split, a = automaton([prose(i, 40) for i in range(5)])
    unknown = 1 / (split.lengths.sum() + len(np.unique(split.word)) + 1)
    # Whatever the state, the weights of all tokens and of an unknown one are a distribution.
    known = np.unique(split.word).astype(np.int32)
    for state in [0, a.start, *range(1, len(a.failure))]:
        if 0 < state < a.first_pair and a.root_target[state - 1] == 0 and state != a.start:
            continue  # no history
        if state >= a.first_pair and split.pairs[state - a.first_pair] % split.words == split.end:
            continue  # nothing follows an end
        weight, _ = a.step(np.full(len(known), state, np.int32), known)
        rest, at = unknown, state
        while at:
            rest, at = rest * 10 ** a.failure[at], a.shorter[at]
        assert (10**weight).sum() + rest == pytest.approx(1)


def test_lm_walk_in_pieces():
    split, a = automaton([prose(i, 30 * i) for i in range(8)] + ["", "x"])
    whole = a.walk(split, piece=10_000)
    for piece in (2, 3, 50):
        assert np.allclose(a.walk(split, piece), whole)


def leaks_brute(docs, items):
    words = lambda t: (t or "").encode().lower().split()
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    for i, t in docs:
        w = words(t)
        for item, s in items:
            x = words(s)
            if len(x) >= 5 and not bag(x).keys() & bag(w).keys():
                continue  # without a common shingle no window is similar
            for k in range(len(w) - len(x) + 1 if x else 0):
                a, b = bag(w[k : k + len(x)]), bag(x)
                common = sum((a & b).values())
                if common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
                    out.add((i, item))
    return out


def test_decontamination(spark):
    items = [(i, prose(i, 12 + 3 * i)) for i in range(12)] + [(50, "only three words"), (51, None), (52, ""), (53, prose(3, 21))]
    docs = [(0, None), (1, ""), (2, prose(99, 300)), (3, "Only THREE words"), (4, "x only three words y")]
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        docs.append((10 + k, prose(k + 200, 40) + " " + t + " " + prose(k + 300, 15)))
        docs.append((30 + k, prose(k + 400, 9) + " " + " ".join(w[1:]) + " tail " + prose(k, 2)))
        docs.append((60 + k, " ".join(w[: len(w) // 2] + ["edit"] + w[len(w) // 2 :])))
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in contaminated(df, bench).collect()}
    assert got == leaks_brute(docs, items) and {(10, 0), (3, 50), (4, 50)} <= got
    assert contaminated(df, bench.limit(0)).count() == contaminated(df.limit(0), bench).count() == 0


def test_decontamination_of_texts_shorter_than_the_item(spark):
    items = [(i, prose(i, 12 + 4 * i)) for i in range(12)] + [(50, "only three words"), (None, prose(77, 30))]
    docs = [(100 * k + cut, " ".join(t.split()[cut // 2 : len(t.split()) - cut + cut // 2])) for k, (_, t) in enumerate(items) for cut in range(15)]
    docs += [(5000, "only three"), (5001, prose(500, 20) + " " + items[-1][1]), (5002, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    expected = leaks_brute(docs, items)
    for i, t in docs:
        for item, s in items:
            w, x = t.lower().split(), s.lower().split()
            if w and len(w) < len(x):
                a, b = bag(w), bag(x)
                common = (a & b).total()
                if common / (a.total() + b.total() - common) >= 0.8:
                    expected.add((i, item))
    rows = contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and {(1102, 11), (1300, None), (1302, None), (5001, None)} <= expected
    words = {i: len(t.split()) for i, t in docs}
    assert all(r.first_word + r.n_words <= words[r.doc_id] for r in rows)


def test_index_finds_all_within_the_radius():
    draw = np.random.default_rng(5)
    bags = [draw.integers(0, 1 << 63, 30).astype(np.uint64) for _ in range(2000)]
    items = Items(list(range(2000)), bags)
    share = []
    for p in items.prints[:60]:
        q = np.unpackbits(p.view(np.uint8), bitorder="little")
        q[draw.choice(128, RADIUS, replace=False)] ^= 1
        q = np.packbits(q, bitorder="little").view("<u2")
        far = np.bitwise_count(items.prints ^ q).sum(axis=1)
        assert set(items.near(q).tolist()) == set(np.nonzero(far <= RADIUS)[0].tolist())
        share.append(len(items.candidates(q)) / 2000)
    assert np.mean(share) < 0.05
    assert Benchmark([(1, prose(1, 30))]).matches(prose(1, 30))[0][:2] == (1, 1.0)


def test_radius_holds_similar_windows():
    """Of windows just as similar as is asked for, one in a hundred at most lies beyond the radius."""
    draw = np.random.default_rng(6)
    beyond = total = 0
    for size in (9, 18, 27, 54, 90):
        changed = size // 9  # 8/9 in common: a similarity of 0.8
        for _ in range(300):
            a = draw.integers(0, 1 << 63, size + changed).astype(np.uint64)
            beyond += int(np.bitwise_count(simhash(a[:size]) ^ simhash(a[changed:])).sum()) > RADIUS
            total += 1
    assert beyond / total < 0.01


def test_decontamination_of_very_long_texts_and_null_ids(spark):
    item = prose(31, 40)
    docs = [(1, prose(32, 60_000) + " " + item + " " + prose(33, 10)), (None, "x " + item), (2, prose(34, 60_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = contaminated(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.similarity, r.first_word) for r in rows), key=repr) == sorted([(1, 1.0, 60_000), (None, 1.0, 1)], key=repr)
