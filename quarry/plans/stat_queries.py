"""Aggregates (A), joins (J), windows and samples (W), set operations (U), validation and gold reports (G8-G16)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trust_tier
from ..operators import sampling as S
from ..operators import stats
from ..operators import taxonomy as X
from ..sources.io import table
from .base import PAPERS_SQL, papers
from .registry import query


def _rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def purity_sql(source: str, group: str, label: str, least: int) -> str:
    return f"""WITH cells AS (SELECT {group} AS g, {label} AS l, count(*) AS c FROM {source} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, l) AS k, sum(c) OVER (PARTITION BY g) AS t FROM cells)
SELECT g AS {group}, sum(c)::BIGINT AS n, max(CASE WHEN k = 1 THEN l END) AS dominant, round(max(c)::DOUBLE / sum(c), 6) AS purity, count(*) AS n_labels,
 round(CASE WHEN count(*) > 1 THEN greatest(-sum(c / t * ln(c / t)) / ln(count(*)), 0.0) ELSE 0.0 END, 6) AS norm_entropy FROM r GROUP BY g HAVING sum(c) >= {least}"""


@query("journal_purity", purity_sql("documents", "source", "lang", 10))
def journal_purity(spark, sf_dir):
    return _rounded(stats.purity(table(spark, sf_dir, "documents"), "source", "lang", 10), "purity", "norm_entropy")


@query("g8_journal_classes", purity_sql(PAPERS_SQL, "journal", "sub", 5))
def g8_journal_classes(spark, sf_dir):
    return _rounded(stats.purity(papers(spark, sf_dir), "journal", "sub", 5), "purity", "norm_entropy")


@query("a1_value_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a1_value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "documents"), "lang")


@query("a3_class_shares", f"SELECT div, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {PAPERS_SQL} GROUP BY div")
def a3_class_shares(spark, sf_dir):
    return _rounded(stats.shares(papers(spark, sf_dir), ["div"], F.avg("conf").alias("mean_conf")), "mean_conf", "share")


@query("a2_a4_order_totals", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a2_a4_order_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("a5_a32_rollup", f"SELECT main, sub, div, count(*) AS n, count(DISTINCT journal) AS journals FROM {PAPERS_SQL} GROUP BY ROLLUP (main, sub, div)")
def a5_a32_rollup(spark, sf_dir):
    return papers(spark, sf_dir).rollup("main", "sub", "div").agg(F.count("*").alias("n"), F.countDistinct("journal").alias("journals"))


@query("a6_distinct", f"SELECT count(DISTINCT div) AS divs, count(DISTINCT sub) AS subs, count(DISTINCT journal) AS journals FROM {PAPERS_SQL}")
def a6_distinct(spark, sf_dir):
    return papers(spark, sf_dir).agg(F.countDistinct("div").alias("divs"), F.countDistinct("sub").alias("subs"), F.countDistinct("journal").alias("journals"))


@query("a7_mode", "SELECT source, mode AS lang FROM (SELECT source, lang AS mode, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) WHERE k = 1")
def a7_mode(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.mode("lang", True).alias("lang"))


_LIFT = """WITH cells AS (SELECT {g} AS g, {l} AS l, count(*) AS c FROM {s} GROUP BY 1, 2),
p AS (SELECT l, sum(c)::DOUBLE / (SELECT sum(c) FROM cells) AS p FROM cells GROUP BY l),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, l) AS k, sum(c) OVER (PARTITION BY g) AS t FROM cells)"""


@query("a10_a11_lift", _LIFT.format(g="source", l="lang", s="documents") + " SELECT round(sum(c / p)::DOUBLE / sum(t), 6) AS lift FROM r JOIN p USING (l) WHERE k = 1")
def a10_a11_lift(spark, sf_dir):
    return _rounded(stats.lift(table(spark, sf_dir, "documents"), "source", "lang"), "lift")


_MI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {s} GROUP BY 1, 2), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS cb FROM c GROUP BY b)
SELECT (SELECT t FROM t)::BIGINT AS n, (SELECT round(-sum(ra / t * ln(ra / t)), 6) FROM ra, t) AS h_a, (SELECT round(-sum(cb / t * ln(cb / t)), 6) FROM cb, t) AS h_b,
 (SELECT round(sum(n / t * ln(n * t / (ra * cb))), 6) FROM c JOIN ra USING (a) JOIN cb USING (b), t) AS mi"""


@query("a12_mutual_information", _MI.format(a="source", b="lang", s="documents"))
def a12_mutual_information(spark, sf_dir):
    return _rounded(stats.mutual_information(table(spark, sf_dir, "documents"), "source", "lang"), "h_a", "h_b", "mi")


@query("a12_adjusted_mutual_information")
def a12_adjusted_mutual_information(spark, sf_dir):
    """The expected part is a sum over class sizes; tests hold it against literal cases."""
    ami = stats.adjusted_mutual_information(papers(spark, sf_dir), "journal", "sub")
    return spark.range(1).select(F.lit(round(ami, 9)).alias("ami"))


@query(
    "v15_adjusted_rand",
    f"""WITH c AS (SELECT sub AS a, lang AS b, count(*) AS n FROM {PAPERS_SQL} GROUP BY 1, 2),
f AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c)::DOUBLE AS pn, (SELECT sum(n) FROM c)::DOUBLE AS n,
 (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY a))::DOUBLE AS pa, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY b))::DOUBLE AS pb)
SELECT round((pn - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM f""",
)
def v15_adjusted_rand(spark, sf_dir):
    return _rounded(stats.adjusted_rand(papers(spark, sf_dir), "sub", "lang"), "ari")


@query("a14_w6_crosstab", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def a14_w6_crosstab(spark, sf_dir):
    return _rounded(stats.crosstab_share(table(spark, sf_dir, "documents"), "lang", "source"), "share")


@query("a14_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a14_pivot(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return t.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("a16_missing", "SELECT unnest(['text', 'lang', 'n_chars']) AS \"column\", unnest([avg((text IS NULL OR text = '')::INT), avg((lang IS NULL OR lang = '')::INT), avg((n_chars IS NULL)::INT)]) AS missing FROM documents")
def a16_missing(spark, sf_dir):
    return stats.missing_rates(table(spark, sf_dir, "documents"), ["text", "lang", "n_chars"])


@query("a18_a19_collect", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def a18_a19_collect(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("turns"))


@query(
    "a20_vote",
    f"""WITH c AS (SELECT journal, sub, div, count(*) AS c, sum(conf) AS s FROM {PAPERS_SQL} GROUP BY 1, 2, 3),
d AS (SELECT *, row_number() OVER (PARTITION BY journal, sub ORDER BY c DESC, div) AS k FROM c),
u AS (SELECT journal, sub, sum(c) AS c, sum(s) AS s, max(CASE WHEN k = 1 THEN div END) AS div FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY c DESC, sub) AS k FROM u)
SELECT journal, sum(c)::BIGINT AS n, max(CASE WHEN k = 1 THEN sub END) AS sub, max(CASE WHEN k = 1 THEN div END) AS div,
 round(max(c)::DOUBLE / sum(c), 6) AS agreement, round(sum(s) / sum(c), 6) AS mean_conf FROM r GROUP BY journal""",
)
def a20_vote(spark, sf_dir):
    return _rounded(X.vote(papers(spark, sf_dir), "journal", "sub", "div", "conf"), "agreement", "mean_conf")


@query("a21_agreement", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agree, round(avg((quality = toxic)::INT), 6) AS rate, count(*) FILTER (WHERE toxic IS NULL) AS unknown FROM labels")
def a21_agreement(spark, sf_dir):
    same = F.col("quality") == F.col("toxic")
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("agree"), F.round(F.avg(same.cast("int")), 6).alias("rate"), F.count(F.when(F.col("toxic").isNull(), 1)).alias("unknown"))


_REPORT = f"""WITH x AS (SELECT lang AS t, CASE WHEN conf < 0.3 THEN 'en' ELSE lang END AS p FROM {PAPERS_SQL}),
s AS (SELECT t AS label, count(*) AS support, count(*) FILTER (WHERE t = p) AS tp FROM x GROUP BY t), g AS (SELECT p AS label, count(*) AS guessed FROM x GROUP BY p),
r AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, CASE WHEN guessed > 0 THEN coalesce(tp, 0)::DOUBLE / guessed ELSE 0.0 END AS precision,
 CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall FROM s FULL JOIN g USING (label))"""


def _guess(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("lang").alias("t"), F.when(F.col("conf") < 0.3, "en").otherwise(F.col("lang")).alias("p"))


@query("a24_class_report", _REPORT + " SELECT label, support, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM r")
def a24_class_report(spark, sf_dir):
    return _rounded(stats.accuracy_report(_guess(spark, sf_dir), "t", "p"), "precision", "recall", "f1")


@query("a24_balanced_accuracy", _REPORT + " SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(recall), 6) AS balanced FROM r WHERE support > 0")
def a24_balanced_accuracy(spark, sf_dir):
    return _rounded(stats.balanced_accuracy(_guess(spark, sf_dir), "t", "p"), "accuracy", "balanced")


@query("a25_class_weights", "SELECT lang, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang")
def a25_class_weights(spark, sf_dir):
    return _rounded(stats.class_weights(table(spark, sf_dir, "documents"), "lang"), "weight")


@query("a26_calibration", f"SELECT floor(conf * 10)::INT AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg((sub = 'S1')::INT), 6) AS accuracy FROM {PAPERS_SQL} WHERE conf < 1 GROUP BY 1")
def a26_calibration(spark, sf_dir):
    """Ten bins of one width; a confidence of exactly 1 lies beyond the last bin and drops out."""
    p = papers(spark, sf_dir).where("conf < 1").withColumn("bin", F.floor(F.col("conf") * 10).cast("int"))
    right = (F.col("sub") == "S1").cast("int")
    return p.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"), F.round(F.avg(right), 6).alias("accuracy"))


_EDGES = ", ".join(f"quantile_cont(n_chars, {i / 10})" for i in range(11))


@query(
    "a27_w4_deciles",
    f"""WITH e AS (SELECT list_sort(list_distinct([{_EDGES}])) AS e FROM documents)
SELECT bin, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT n_chars,
 greatest(len(list_filter(e, lambda x: x < n_chars)) - 1, 0)::INT AS bin FROM documents, e) GROUP BY bin""",
)
def a27_w4_deciles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("n_chars"))
    binned = d.withColumn("bin", stats.quantile_bin(F.col("n_chars"), stats.edges(d, "n_chars", 10)))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a28_density", f"SELECT floor(conf * 20)::INT AS x, floor(sim * 20)::INT AS y, count(*) AS n, round(ln(1 + count(*)), 6) AS logn FROM {PAPERS_SQL} GROUP BY 1, 2")
def a28_density(spark, sf_dir):
    p = papers(spark, sf_dir).select(F.floor(F.col("conf") * 20).cast("int").alias("x"), F.floor(F.col("sim") * 20).cast("int").alias("y"))
    return p.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("logn", F.round(F.log1p("n"), 6))


@query("a29_confused_pairs", f"SELECT t, p, n, round(n / s, 6) AS rate FROM (SELECT lang AS t, sub AS p, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS s FROM {PAPERS_SQL} GROUP BY 1, 2) ORDER BY n DESC, t, p LIMIT 10")
def a29_confused_pairs(spark, sf_dir):
    c = stats.crosstab_share(papers(spark, sf_dir).select(F.col("lang").alias("t"), F.col("sub").alias("p")), "t", "p")
    return c.orderBy(F.desc("n"), "t", "p").limit(10).select("t", "p", "n", F.round("share", 6).alias("rate"))


@query("a30_g17_cluster_sizes", "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rank, round(n / sum(n) OVER (), 6) AS share FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def a30_g17_cluster_sizes(spark, sf_dir):
    c = stats.shares(table(spark, sf_dir, "embeddings"), ["label"])
    return _rounded(c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label")).cast("long")), "share")


@query("a31_hierarchy", f"SELECT DISTINCT main, sub, div FROM {PAPERS_SQL}")
def a31_hierarchy(spark, sf_dir):
    return papers(spark, sf_dir).select("main", "sub", "div").distinct()


@query("w1_top_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def w1_top_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(12)


@query("w2_top_per_group", "SELECT source, doc_id, k::INT AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 8")
def w2_top_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return S.top_per_group(d, "source", 8, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "rank")


@query("w3_quartiles", "SELECT CASE WHEN n_chars <= q1 THEN 'low' ELSE 'high' END AS side, count(*) AS n FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents) WHERE n_chars <= q1 OR n_chars >= q3 GROUP BY 1")
def w3_quartiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("n_chars")
    q1, q3 = stats.quantiles(d, "n_chars", [0.25, 0.75])
    sides = d.where((F.col("n_chars") <= q1) | (F.col("n_chars") >= q3))
    return sides.groupBy(F.when(F.col("n_chars") <= q1, "low").otherwise("high").alias("side")).agg(F.count("*").alias("n"))


@query(
    "w5_elbow",
    "WITH c AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY label), g AS (SELECT k, n - lag(n) OVER (ORDER BY k) AS gain FROM c) SELECT k, gain, coalesce(abs(gain) < 0.1 * (SELECT max(abs(gain)) FROM g), false) AS flat FROM g",
)
def w5_elbow(spark, sf_dir):
    from ..operators.cluster import elbow

    c = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n"))
    return elbow(c, "k", "n")


@query("w7_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def w7_sample(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("w8_w11_sample_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5")
def w8_w11_sample_per_group(spark, sf_dir):
    return S.sample_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query(
    "w9_stratified",
    """WITH c AS (SELECT lang, greatest(20, round(120 * count(*) / (SELECT count(*) FROM documents)))::INT AS wanted FROM documents GROUP BY lang),
r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents)
SELECT lang, doc_id FROM r JOIN c USING (lang) WHERE k <= wanted ORDER BY md5('trim' || doc_id), doc_id LIMIT 120""",
)
def w9_stratified(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 120, 20)


@query("w10_split", "SELECT lang, held, count(*) AS n, min(doc_id) AS first FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= ceil(count(*) OVER (PARTITION BY lang) * 0.2) AS held FROM documents) GROUP BY 1, 2")
def w10_split(spark, sf_dir):
    s = S.split_80_20(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")
    return s.groupBy("lang", F.col("held_out").alias("held")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("w13_folds", "SELECT ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 5 AS fold, count(*) AS n FROM documents GROUP BY 1")
def w13_folds(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(S.folds("doc_id", 5).alias("fold")).agg(F.count("*").alias("n"))


@query("u1_u3_union", "SELECT DISTINCT nationkey FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def u1_u3_union(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey")).unionByName(s.select(F.col("s_nationkey").alias("nationkey"))).distinct()


@query("u4_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u4_difference(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


#: Gold codes of the journals, as a stand-in: source k has code K[k % 4], or none.
_CODES = ("QC", "TK", "QE", "")


def gold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("journal")).distinct()
    k = F.pmod(F.regexp_extract("journal", "([0-9]+)$", 1).cast("int"), F.lit(4))
    return d.withColumn("code", F.element_at(F.array(*map(F.lit, _CODES)), k + 1)).withColumn("gold", X.bucket(F.col("code")))


_GOLD = "(SELECT journal, ['QC', 'TK', 'QE', ''][k + 1] AS code, ['QC|TK', 'QA|TA|TK', 'GB|QC|QE', ''][k + 1] AS gold FROM (SELECT DISTINCT source AS journal, regexp_extract(source, '([0-9]+)$', 1)::INT % 4 AS k FROM documents))"


@query("g11_u5_gold_buckets", f"SELECT journal, code, gold FROM {_GOLD}")
def g11_u5_gold_buckets(spark, sf_dir):
    return gold(spark, sf_dir)


_PRED = "['QC', 'TK', 'TA', 'GB', 'QA'][(doc_id % 5 + 1)::INT]"


def _scored(spark, sf_dir):
    p = papers(spark, sf_dir)
    pred = F.element_at(F.array(*map(F.lit, ("QC", "TK", "TA", "GB", "QA"))), (F.col("doc_id") % 5 + 1).cast("int"))
    g = gold(spark, sf_dir).where("gold <> ''")
    return p.withColumn("pred", pred).join(g, "journal").withColumn("ok", X.in_bucket(F.col("gold"), F.col("pred")).cast("int"))


_SCORED = f"(SELECT p.*, {_PRED} AS pred, g.gold, g.code, list_contains(string_split(g.gold, '|'), {_PRED})::INT AS ok FROM {PAPERS_SQL} p JOIN {_GOLD} g USING (journal) WHERE g.gold <> '')"


@query("g10_gold_by_journal", f"SELECT journal, gold, count(*) AS n, round(avg(ok), 6) AS accuracy FROM {_SCORED} GROUP BY 1, 2")
def g10_gold_by_journal(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("journal", "gold").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("j10_a22_gold_by_tier", "SELECT tier, count(*) AS n, round(avg(ok), 6) AS accuracy, round(count(*) / sum(count(*)) OVER (), 6) AS share_of_matched FROM (SELECT *, CASE WHEN sim IS NULL THEN 'unknown' WHEN sim < 0.40 THEN 'reject' WHEN sim < 0.57 THEN 'low' WHEN sim < 0.67 THEN 'medium' ELSE 'trust' END AS tier FROM " + _SCORED + ") GROUP BY tier")
def j10_a22_gold_by_tier(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("tier", trust_tier(F.col("sim")))
    return _rounded(stats.shares(s, ["tier"], F.avg("ok").alias("accuracy")).withColumnRenamed("share", "share_of_matched"), "accuracy", "share_of_matched")


@query("g15_gold_confusion", f"SELECT code, pred, count(*) AS n FROM {_SCORED} WHERE ok = 0 GROUP BY 1, 2")
def g15_gold_confusion(spark, sf_dir):
    return _scored(spark, sf_dir).where("ok = 0").groupBy("code", "pred").agg(F.count("*").alias("n"))


@query("v27_vocabulary_gaps", f"SELECT code FROM {_SCORED} GROUP BY code HAVING avg((pred = code)::INT) < 0.1")
def v27_vocabulary_gaps(spark, sf_dir):
    s = _scored(spark, sf_dir).groupBy("code").agg(F.avg((F.col("pred") == F.col("code")).cast("int")).alias("hit"))
    return s.where("hit < 0.1").select("code")


@query("j1_j2_mapped", "SELECT n.n_name AS nation, r.r_name AS region, count(*) AS customers FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def j1_j2_mapped(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("customers"))


@query("j4_j6_last_wins", "SELECT c_custkey, coalesce((SELECT max_by(o_orderpriority, o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey), 'MISSING') AS last FROM customer c")
def j4_j6_last_wins(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("last"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return c.withColumn("last", F.coalesce("last", F.lit("MISSING")))


@query("j5_array_membership", "SELECT r.r_name, count(*) AS n FROM customer c JOIN (SELECT r_name, unnest(keys) AS k FROM (SELECT r_regionkey, r_name, list(n_nationkey) AS keys FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)) r ON r.k = c.c_nationkey GROUP BY 1")
def j5_array_membership(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    held = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.collect_list("n_nationkey").alias("keys"))
    return c.join(held.select("r_name", F.explode("keys").alias("c_nationkey")), "c_nationkey").groupBy("r_name").agg(F.count("*").alias("n"))


@query("g12_g13_timeline", "SELECT year, kind, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT year(o_orderdate)::INT AS year, CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) THEN o_orderpriority ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2)")
def g12_g13_timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = stats.value_counts(o, "o_orderpriority").orderBy(F.desc("n"), "o_orderpriority").limit(2).select(F.col("o_orderpriority").alias("kind"))
    named = o.join(F.broadcast(top), o.o_orderpriority == top.kind, "left").select(F.year("o_orderdate").alias("year"), F.coalesce("kind", F.lit("other")).alias("kind"))
    return _rounded(stats.crosstab_share(named, "year", "kind"), "share")


@query("g6_cluster_overview", f"SELECT main, count(*) AS clusters, sum(n)::BIGINT AS papers, max(n) AS largest FROM (SELECT main, div, count(*) AS n FROM {PAPERS_SQL} GROUP BY 1, 2) GROUP BY main")
def g6_cluster_overview(spark, sf_dir):
    c = papers(spark, sf_dir).groupBy("main", "div").agg(F.count("*").alias("n"))
    return c.groupBy("main").agg(F.count("*").alias("clusters"), F.sum("n").alias("papers"), F.max("n").alias("largest"))


@query("s6_row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s6_row_counts(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("documents").unionByName(one("lineitem"))


@query("event_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
