"""Vectors (V), keywords, search and facets (R), inference, diagnostics (G5, G14, G21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search, tfidf
from ..operators import vectors as V
from ..sources.io import table
from .base import PAPERS_SQL, papers
from .registry import query

_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_E = f"(SELECT vec_id, label, {_D} AS v, list_transform({_D}, lambda x: x / sqrt(list_sum(list_transform({_D}, lambda y: y * y)))) AS u FROM embeddings)"
_CENTROIDS = f"""c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM {_E}) GROUP BY 1, 2) GROUP BY label),
cu AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM c)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalise(F.col("embedding")).alias("u"), "embedding")


def _classes(spark, sf_dir):
    return V.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", unit=True).select(F.col("label").alias("c"), "centroid")


@query("v1_normalise", f"SELECT vec_id, round(list_sum(u), 4) AS total FROM {_E}")
def v1_normalise(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("a13_centroids", f"WITH {_CENTROIDS} SELECT label, unnest(generate_series(1, len(m))) - 1 AS i, round(unnest(m), 5) AS x FROM c")
def a13_centroids(spark, sf_dir):
    c = V.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


_HASHED = """(WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents)
SELECT doc_id, ('0x' || md5(w)[1:8])::BIGINT % 32 AS i, sum(CASE WHEN ('0x' || md5(w)[9:9])::BIGINT < 8 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2)"""


@query("v22_hashed_vectors", f"SELECT doc_id, max(abs(v))::BIGINT AS most, sum(v * (i + 1))::BIGINT AS total, sum(v * v)::BIGINT AS square, true AS unit FROM {_HASHED} GROUP BY doc_id HAVING sum(v * v) > 0")
def v22_hashed_vectors(spark, sf_dir):
    """The signed counts as they are, and whether the vector made of them points the same way with length 1."""
    from ..operators.embed import hashed

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = hashed(hashed(d, "text", 32, "n", unit=False), "text", 32).where("n is not null").select("doc_id", F.transform("n", lambda x: x.cast("long")).alias("n"), "embeddings")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    square = total(F.transform("n", lambda x: x * x))
    along = V.dot(F.col("embeddings"), F.col("n")) / F.sqrt(square)
    unit = (F.abs(V.norm(F.col("embeddings")) - 1) < 1e-5) & (F.abs(along - 1) < 1e-5)
    return e.select("doc_id", F.array_max(F.transform("n", F.abs)).alias("most"), total(F.transform("n", lambda x, i: x * (i + 1))).alias("total"), square.alias("square"), unit.alias("unit")).where("square > 0")


@query("o6_embedding_report", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing, 32::INT AS least_size, 32::INT AS most_size FROM documents")
def o6_embedding_report(spark, sf_dir):
    from ..operators.embed import hashed, validation

    return validation(hashed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 32)).select("n", "missing", "least_size", "most_size")


@query("v2_own_similarity", f"WITH {_CENTROIDS} SELECT vec_id, round(list_inner_product(u, m), 4) AS sim FROM {_E} JOIN cu USING (label)")
def v2_own_similarity(spark, sf_dir):
    joined = _vectors(spark, sf_dir).join(_classes(spark, sf_dir), F.col("label") == F.col("c"))
    return joined.select("vec_id", F.round(V.dot(F.col("u"), F.col("centroid")), 4).alias("sim"))


@query("v3_j8_j9_nearest", f"WITH {_CENTROIDS}, s AS (SELECT vec_id, cu.label AS c, list_inner_product(u, m) AS sim FROM {_E} e, cu) SELECT vec_id, c, round(sim, 4) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c) AS k FROM s) WHERE k = 1")
def v3_j8_j9_nearest(spark, sf_dir):
    return V.nearest(_vectors(spark, sf_dir), ["vec_id"], "u", _classes(spark, sf_dir), "c").withColumn("sim", F.round("sim", 4))


@query("v4_v5_leakage", f"""WITH a AS (SELECT * FROM {_E} WHERE vec_id % 50 = 0), b AS (SELECT * FROM {_E} WHERE vec_id % 50 <> 0),
s AS (SELECT a.vec_id, a.label AS own, b.label, list_inner_product(a.u, b.u) AS sim, b.vec_id AS other FROM a, b),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS k FROM s)
SELECT count(*) AS n, round(avg((own = label)::INT), 6) AS accuracy, round(avg((sim >= 0.95)::INT), 6) AS near, round(median(sim), 4) AS middle FROM t WHERE k = 1""")
def v4_v5_leakage(spark, sf_dir):
    """1-NN of the held-out vectors (every fiftieth) among the others."""
    from ..operators.stats import quantiles

    v = _vectors(spark, sf_dir)
    held = v.where("vec_id % 50 = 0")
    best = V.nearest_rows(v.where("vec_id % 50 <> 0"), "vec_id", "u", held, "label").select("label", "near_label", "sim")
    middle = (quantiles(best, "sim", [0.5]) or [None])[0]
    return best.agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("label") == F.col("near_label")).cast("int")), 6).alias("accuracy"),
        F.round(F.avg((F.col("sim") >= 0.95).cast("int")), 6).alias("near"),
        F.round(F.lit(middle).cast("double"), 4).alias("middle"),
    )


@query("v5_leakage_levels", f"""WITH a AS (SELECT * FROM {_E} WHERE vec_id % 50 = 0), b AS (SELECT * FROM {_E} WHERE vec_id % 50 <> 0),
t AS (SELECT a.vec_id, max(list_inner_product(a.u, b.u)) AS sim FROM a, b GROUP BY 1), l AS (SELECT unnest([0.3, 0.95, 0.99, 0.999])::DOUBLE AS level)
SELECT level, round(avg((sim >= level)::INT), 6) AS share FROM t, l GROUP BY level""")
def v5_leakage_levels(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    best = V.nearest_rows(v.where("vec_id % 50 <> 0"), "vec_id", "u", v.where("vec_id % 50 = 0"), "label")
    levels = best.select("sim", F.explode(F.array(*(F.lit(x) for x in (0.3, 0.95, 0.99, 0.999)))).alias("level"))
    return levels.groupBy("level").agg(F.round(F.avg((F.col("sim") >= F.col("level")).cast("int")), 6).alias("share"))


@query("v6_soft_tags", f"WITH {_CENTROIDS} SELECT vec_id, string_agg(cu.label, ',' ORDER BY cu.label) AS tags FROM {_E} e, cu WHERE list_inner_product(u, m) >= 0.25 GROUP BY vec_id")
def v6_soft_tags(spark, sf_dir):
    scores, labels = V.class_scores(_vectors(spark, sf_dir), ["vec_id"], "u", _classes(spark, sf_dir), "c")
    near = F.zip_with("scores", F.array(*(F.lit(str(x)) for x in labels)), lambda s, name: F.when(s >= 0.25, name))
    return scores.select("vec_id", F.array_compact(near).alias("near")).where(F.size("near") > 0).select("vec_id", F.array_join("near", ",").alias("tags"))


@query("v7_cohesion", f"SELECT a.label, round(avg(list_inner_product(a.u, b.u)), 5) AS cohesion FROM {_E} a JOIN {_E} b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def v7_cohesion(spark, sf_dir):
    return V.cohesion(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.round("cohesion", 5).alias("cohesion"))


@query("v8_separation", f"WITH {_CENTROIDS} SELECT a.label, round(1 - avg(list_inner_product(a.m, b.m)), 5) AS separation FROM cu a JOIN cu b ON a.label <> b.label GROUP BY 1")
def v8_separation(spark, sf_dir):
    return V.separation(_classes(spark, sf_dir), "c").select(F.col("c").alias("label"), F.round("separation", 5).alias("separation"))


@query("v16_soft_outliers", f"WITH {_CENTROIDS}, s AS (SELECT vec_id, max(list_inner_product(u, m)) AS sim FROM {_E} e, cu GROUP BY vec_id), q AS (SELECT sqrt(greatest(2 - 2 * sim, 0)) AS d FROM s) SELECT t AS threshold, count(*) FILTER (WHERE exp(-d / (2 * m)) >= t) AS kept FROM q, (SELECT median(d) AS m FROM q), (SELECT unnest([0.5, 0.6, 0.7])::DOUBLE AS t) GROUP BY t")
def v16_soft_outliers(spark, sf_dir):
    from ..operators.stats import quantiles

    near = V.nearest(_vectors(spark, sf_dir), ["vec_id"], "u", _classes(spark, sf_dir), "c")
    d = near.select(F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))).alias("d"))
    middle = (quantiles(d, "d", [0.5]) or [None])[0]
    p = d.select(F.exp(-F.col("d") / (2 * F.lit(middle).cast("double"))).alias("p"))
    t = p.select("p", F.explode(F.array(F.lit(0.5), F.lit(0.6), F.lit(0.7))).alias("threshold"))
    return t.groupBy("threshold").agg(F.count(F.when(F.col("p") >= F.col("threshold"), 1)).alias("kept"))


@query("v20_masked_choice", f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, cu.label AS d, cu.label // 2 AS s, list_inner_product(u, m) AS z FROM {_E} e, cu),
b AS (SELECT vec_id, s FROM (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY max(z) DESC, s) AS k FROM s GROUP BY 1, 2) WHERE k = 1),
r AS (SELECT s.*, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, d) AS k FROM s JOIN b USING (vec_id, s))
SELECT vec_id, s::BIGINT AS sub, max(CASE WHEN k = 1 THEN d END)::BIGINT AS div, round(exp(max(z)) / sum(exp(z)), 4) AS conf FROM r GROUP BY 1, 2""")
def v20_masked_choice(spark, sf_dir):
    scores, divs = V.class_scores(_vectors(spark, sf_dir), ["vec_id"], "u", _classes(spark, sf_dir), "c")
    subs = sorted({d // 2 for d in divs})
    # A sub's score is that of its best div.
    best = F.array(*(F.array_max(F.array(*(F.get("scores", F.lit(i)) for i, d in enumerate(divs) if d // 2 == s))) for s in subs))
    chosen = V.choice_in_row(best, subs, F.col("scores"), divs, {(d // 2, d) for d in divs})
    out = scores.select("vec_id", chosen.alias("c"))
    return out.select("vec_id", F.col("c.sub").cast("long").alias("sub"), F.col("c.div").cast("long").alias("div"), F.round("c.conf", 4).alias("conf"))


_TOK = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS) + "))"
_TFIDF = f"""WITH d AS (SELECT doc_id, source, text FROM documents), x AS (SELECT doc_id, unnest({_TOK}) AS term FROM d), c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY 1, 2),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
s AS (SELECT source, term, sum(w / l) AS s FROM w JOIN l USING (doc_id) JOIN d USING (doc_id) GROUP BY 1, 2),
g AS (SELECT source, count(*) AS n FROM d GROUP BY 1), r AS (SELECT source, term, s / n AS score, row_number() OVER (PARTITION BY source ORDER BY round(s / n, 9) DESC, term) AS rank FROM s JOIN g USING (source))"""


@query("v17_keywords", _TFIDF + " SELECT source, term, round(score, 6) AS score FROM r WHERE rank <= 10")
def v17_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return tfidf.keywords(d, "doc_id", "text", "source", 10).select("source", "term", F.round("score", 6).alias("score"))


@query(
    "v18_class_keywords",
    f"""WITH x AS (SELECT source, unnest({_TOK}) AS term FROM documents), c AS (SELECT source, term, count(*) AS tf FROM x GROUP BY 1, 2), k AS (SELECT count(DISTINCT source) AS k FROM documents),
v AS (SELECT term FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20000), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
q AS (SELECT c.*, df, k FROM c JOIN f USING (term) JOIN v USING (term), k WHERE df >= 2 AND df <= 0.85 * k), a AS (SELECT source, sum(tf) AS a FROM q GROUP BY 1),
r AS (SELECT source, term, tf / a * ln(1 + k / (1 + df)) AS score, row_number() OVER (PARTITION BY source ORDER BY round(tf / a * ln(1 + k / (1 + df)), 12) DESC, term) AS rank FROM q JOIN a USING (source))
SELECT source, term, round(score, 9) AS score FROM r WHERE rank <= 15""",
)
def v18_class_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "text")
    return tfidf.class_tfidf(d, "text", "source", 15, most=1).select("source", "term", F.round("score", 9).alias("score"))


_TFIDF_PAIRS = _TFIDF.replace(f"unnest({_TOK}) AS term FROM d)", f"unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT doc_id, {_TOK} AS t FROM d)), x0 AS (SELECT 1)").replace(
    "i AS (SELECT term, ln(", "voc AS (SELECT term FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 15000),\ni AS (SELECT term, ln("
).replace("FROM c GROUP BY term HAVING count(*) >= 2)", "FROM c WHERE term IN (SELECT term FROM voc) GROUP BY term HAVING count(*) >= 2)")


@query("v17_bigrams", _TFIDF_PAIRS + " SELECT source, term, round(score, 6) AS score FROM r WHERE rank <= 10")
def v17_bigrams(spark, sf_dir):
    """Word pairs after stop words are gone, and a vocabulary of bounded size."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return tfidf.keywords(d, "doc_id", "text", "source", 10, most=2, size=15_000).select("source", "term", F.round("score", 6).alias("score"))


_FACETS = f"(SELECT main AS lvl0, main || ' > ' || sub AS lvl1, main || ' > ' || sub || ' > ' || div AS lvl2, journal, sim FROM {PAPERS_SQL})"


@query("r1_search_documents", f"SELECT doc_id AS id, CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(text[1:600], '(?s) [^ ]*$', '') || '…' END AS abstract, main || ' > ' || sub || ' > ' || div AS path FROM {PAPERS_SQL} WHERE trim(journal) <> ''")
def r1_search_documents(spark, sf_dir):
    from ..operators.taxonomy import facet_levels

    p = papers(spark, sf_dir).withColumn("title", F.col("journal"))
    docs = search.search_documents(p, "doc_id", "title", "text")
    path = facet_levels(F.col("pred_main"), F.col("pred_sub"), F.col("pred_div"), {"-": ""})["lvl2"]
    return docs.select("id", "abstract", path.alias("path"))


@query("r2_bm25", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, len(w) AS words, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN ('the', 'von', 'erth') GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean))), 6) AS score FROM p JOIN f USING (term), s GROUP BY doc_id ORDER BY count(*) DESC, 3 DESC, doc_id LIMIT 12""")
def r2_bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    index = search.inverted_index(d, "doc_id", "text", ["the", "von", "erth"])
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    stats = d.agg(F.count("*").alias("n"), F.avg(words).alias("mean"))
    found = search.bm25(index, stats, "doc_id", ["the", "von", "erth"]).withColumn("score", F.round("score", 6))
    return search.page(found, 0, 12, F.desc("matched"), F.desc("score"), F.col("doc_id"))


@query("r3_facets", f"SELECT level, path, count(*) AS n FROM (SELECT unnest([0, 1, 2])::INT AS level, unnest([lvl0, lvl1, lvl2]) AS path FROM {_FACETS}) GROUP BY 1, 2")
def r3_facets(spark, sf_dir):
    p = papers(spark, sf_dir)
    levels = p.select(F.col("main").alias("lvl0"), F.concat_ws(" > ", "main", "sub").alias("lvl1"), F.concat_ws(" > ", "main", "sub", "div").alias("lvl2"))
    return search.facet_counts(levels, ["lvl0", "lvl1", "lvl2"])


@query("r4_r5_refinements", f"SELECT journal, count(*) AS n FROM {PAPERS_SQL} WHERE main = 'M0' AND sim BETWEEN 0.1 AND 0.8 GROUP BY journal ORDER BY n DESC, journal LIMIT 8")
def r4_r5_refinements(spark, sf_dir):
    p = papers(spark, sf_dir).where(F.col("sim").between(0.1, 0.8))
    return search.refinements(p, "journal", {"main": ["M0"], "journal": ["src0"]}, 8)


@query("r6_r7_page", "SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:55], ' ') AS snippet FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12 OFFSET 12")
def r6_r7_page(spark, sf_dir):
    found = search.page(table(spark, sf_dir, "documents"), 1, 12, F.desc("n_chars"), F.col("doc_id"))
    return found.select("doc_id", search.snippet(F.col("text")).alias("snippet"))


@query("p18_facet_paths", "SELECT main, sub, main || ' > ' || sub AS lvl1 FROM (SELECT DISTINCT main, sub FROM " + PAPERS_SQL + ")")
def p18_facet_paths(spark, sf_dir):
    from ..operators.taxonomy import facet_levels

    p = papers(spark, sf_dir).select("main", "sub").distinct()
    return p.select("main", "sub", facet_levels(F.col("main"), F.col("sub"), F.lit(""), {"-": ""})["lvl1"].alias("lvl1"))


@query("g5_low_confidence", f"SELECT doc_id, round(conf, 4) AS conf, text[1:80] AS start FROM {PAPERS_SQL} WHERE conf < 0.3 ORDER BY conf, doc_id LIMIT 20")
def g5_low_confidence(spark, sf_dir):
    """In the order of the rounded confidence, which the SQL's ORDER BY takes; so equal ones go by id."""
    p = papers(spark, sf_dir).where("conf < 0.3").select("doc_id", F.round("conf", 4).alias("conf"), F.substring("text", 1, 80).alias("start"))
    return p.orderBy("conf", "doc_id").limit(20)


@query("g14_histogram", f"SELECT floor(sim * 40)::INT AS bin, count(*) AS n FROM {PAPERS_SQL} GROUP BY 1")
def g14_histogram(spark, sf_dir):
    return papers(spark, sf_dir).groupBy(F.floor(F.col("sim") * 40).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("g21_overconfidence", f"SELECT count(*) AS n, round(avg((conf > 0.9)::INT), 6) AS sure FROM {PAPERS_SQL} WHERE sim < 0.4")
def g21_overconfidence(spark, sf_dir):
    p = papers(spark, sf_dir).where("sim < 0.4")
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("conf") > 0.9).cast("int")), 6).alias("sure"))


_GAPS = f"(SELECT a.vec_id, b.vec_id AS near, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id)"


@query("v4_j9_neighbours", f"SELECT vec_id, rank, near FROM (SELECT vec_id, near, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS rank FROM {_GAPS}) WHERE rank <= 3")
def v4_j9_neighbours(spark, sf_dir):
    """The three nearest others of every vector, exactly, past the tiles of the index that can't hold them."""
    from ..operators.neighbours import neighbours, tiled

    near = neighbours(*tiled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 3)
    return near.select(F.col("key").alias("vec_id"), F.posexplode("found").alias("i", "f")).select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("f.near").alias("near"))


@query("v13_core_distances", f"SELECT vec_id, round(d, 4) AS core FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS rank FROM {_GAPS}) WHERE rank = 5")
def v13_core_distances(spark, sf_dir):
    from ..operators.density import cores, points

    p = points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    return p.keys.join(cores(p, 5), "key").select(F.col("id").alias("vec_id"), F.round("core", 4).alias("core"))


@query("v13_g18_density_grid")
def v13_g18_density_grid(spark, sf_dir):
    """Density clusters of the vectors' principal components over a grid of settings, with outlier rates and silhouettes, and
    which setting is chosen. No SQL, as a spanning tree is grown; tests hold it against brute force."""
    from ..operators.cluster import reduce_dimensions
    from ..operators.density import tuned

    e = reduce_dimensions(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 5)
    results, _ = tuned(e, "vec_id", "reduced", (2, 60), [(m, s) for m in (5, 10, 20) for s in (3, 5)])
    made = spark.createDataFrame([(r["least"], r["samples"], r["clusters"], r["outlier_rate"], r["score"]) for r in results], "least int, samples int, clusters long, outlier_rate double, score double")
    best = made.where("score > 0").agg(F.max(F.struct("score", -F.col("least"), -F.col("samples"))).alias("b"))
    return made.crossJoin(F.broadcast(best)).select("least", "samples", "clusters", "outlier_rate", "score", F.coalesce((F.col("score") == F.col("b.score")) & (F.col("least") == -F.col("b.col2")) & (F.col("samples") == -F.col("b.col3")), F.lit(False)).alias("chosen"))


@query("v12_spectral_layout")
def v12_spectral_layout(spark, sf_dir):
    """The vectors by the graph of their neighbours, in two dimensions; tests hold it against numpy's eigenvectors."""
    from ..operators.layout import projected

    p = projected(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return p.select("vec_id", F.round(F.col("layout")[0], 6).alias("x"), F.round(F.col("layout")[1], 6).alias("y"))


@query("v12_v13_cluster_grid")
def v12_v13_cluster_grid(spark, sf_dir):
    """Principal components, then k-means over a grid: the labels depend on the algorithm, so no SQL."""
    from ..operators.cluster import grid_search, reduce_dimensions

    e = reduce_dimensions(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 10)
    _, found = grid_search(e, "reduced", [4, 8, 12], (6, 12))
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("v11_merge_classes")
def v11_merge_classes(spark, sf_dir, most=5000):
    """Average linkage over class centroids (k rows on the driver; `most` is checked): (label, merged)."""
    import numpy as np

    from ..operators.cluster import average_linkage, tune_threshold

    rows = _classes(spark, sf_dir).orderBy("c").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    m = np.array([r.centroid for r in rows])
    distance = np.maximum(1 - m @ m.T, 0)
    labels = average_linkage(distance, tune_threshold(distance))
    return spark.createDataFrame([(r.c, int(x)) for r, x in zip(rows, labels, strict=True)], "label int, merged int")


@query("v14_selection_scores", "SELECT label, round(0.4 - greatest(0.0, n / 1000.0 - 0.5) * 2 - 0.4 * CASE WHEN n < 150 THEN (150.0 - n) / 150 WHEN n > 220 THEN (n - 220.0) / 220 ELSE 0.0 END, 6) AS score FROM (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY label)")
def v14_selection_scores(spark, sf_dir):
    from ..operators.cluster import silhouette_score

    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").cast("double").alias("n"))
    return c.select("label", F.round(silhouette_score(F.lit(0.4), F.col("n") / 1000.0, F.col("n")), 6).alias("score"))


@query("v19_trained_accuracy")
def v19_trained_accuracy(spark, sf_dir):
    """Both classifiers, trained on hashed vectors of the documents to tell their languages (div) and language groups (sub),
    and nearest centroids beside them: accuracy on a held-out fifth. No SQL, as weights are fitted; a test has the floor."""
    from ..operators.embed import hashed
    from ..operators.predict import classify
    from ..operators.stats import balanced_accuracy
    from ..operators.train import train

    d = hashed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", 128).where("embeddings is not null and lang is not null")
    rows = d.select("doc_id", "embeddings", F.col("lang").alias("div"), F.when(F.col("lang").isin("de", "en"), "G").otherwise("R").alias("sub"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held")).persist()
    held, out = rows.where("held"), None
    for name, sub in (("flat", None), ("two heads", "sub")):
        model, _ = train(rows, "embeddings", "div", "held", sub, hidden=(64, 32), epochs=12, rate=3e-3, batch=64, stop_after=6)
        found = classify(held, model, "embeddings", ["div"]).select("div", F.col("pred_div").alias("predicted"), F.lit(name).alias("model"))
        out = found if out is None else out.unionByName(found)
    near = V.nearest(held, ["div"], "embeddings", V.centroids(rows.where("not held"), "div", "embeddings", unit=True).withColumnRenamed("div", "predicted"), "predicted")
    out = out.unionByName(near.select("div", "predicted", F.lit("nearest centroid").alias("model")))
    by = None
    for name in ("flat", "two heads", "nearest centroid"):
        part = out.where(F.col("model") == name)
        figures = balanced_accuracy(part, "div", "predicted").select(F.round("accuracy", 4).alias("accuracy"), F.round("balanced", 4).alias("balanced"))
        one = part.agg(F.count("*").alias("n")).crossJoin(F.broadcast(figures)).withColumn("model", F.lit(name))  # a row each
        by = one if by is None else by.unionByName(one)
    return by


@query("v19_v21_classify")
def v19_v21_classify(spark, sf_dir):
    """Two-head forward pass with fixed weights in Arrow batches; a test holds it against numpy."""
    import numpy as np

    from ..operators.predict import TwoHead, classify

    draw = np.random.default_rng(1)
    divs = [f"D{i}" for i in range(10)]
    model = TwoHead(
        [(draw.normal(size=(64, 16)), np.zeros(16))], (draw.normal(size=(16, 5)), np.zeros(5)), (draw.normal(size=(16, 10)), np.zeros(10)),
        [f"S{i}" for i in range(5)], divs, {(f"S{i // 2}", d) for i, d in enumerate(divs)},
    )
    return classify(table(spark, sf_dir, "embeddings"), model, "embedding", ["vec_id"])
