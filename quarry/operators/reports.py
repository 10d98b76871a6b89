"""Composed reports as tables in long form: classification, validation by journals, gold templates and variants.

A report's rows are (section, item, n, share, value, text); what a section has no use for is null. All parts are
aggregates or top-k over the classified table; medians, edges and agreement come from `stats`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import sampling, stats, tfidf
from .taxonomy import ADJACENT, bucket

# Journals whose own class is outside the vocabulary, and the classes that count as right for them.
JOURNAL_BUCKET = {
    "Journal of the American Ceramic Society": ["QD", "TA", "TN"],
    "Journal of the Ceramic Society of Japan": ["QD", "TA", "TN"],
    "JOURNAL OF CHEMICAL ENGINEERING OF JAPAN": ["QD", "TA"],
    "AIChE Journal": ["QD", "TA"],
    "Biotechnology and Bioengineering": ["QD", "QP"],
    "Journal of Food Science": ["QD", "QP"],
    "Journal of the American Oil Chemists' Society": ["QD", "QP"],
    "Sen'i Gakkaishi": ["QD", "TA"],
    "Journal of Veterinary Medical Science": ["QR", "RC", "S"],
    "Pediatrics": ["RC"],
    "Journal of the Society of Naval Architects of Japan": ["TA"],
    "PROCEEDINGS OF HYDRAULIC ENGINEERING": ["GB", "TA"],
    "Journal of Geophysical Research: Oceans": ["GB", "QE", "QH"],
}


def rows(df: DataFrame, section: str, item: Column, n: Column | None = None, share: Column | None = None, value: Column | None = None, text: Column | None = None) -> DataFrame:
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return df.select(
        F.lit(section).alias("section"), item.cast("string").alias("item"), none(n, "long").alias("n"),
        none(share, "double").alias("share"), none(value, "double").alias("value"), none(text, "string").alias("text"),
    )


def figures(df: DataFrame, section: str, found: list[tuple[str, Column | None, Column | None]]) -> DataFrame:
    """One row of aggregates as report rows: (item, n, value) each."""
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    made = [F.struct(F.lit(name).alias("item"), none(n, "long").alias("n"), none(v, "double").alias("value")) for name, n, v in found]
    one = df.agg(F.array(*made).alias("all")).select(F.explode("all").alias("f"))
    return rows(one, section, F.col("f.item"), F.col("f.n"), None, F.col("f.value"))


def overview(df: DataFrame, classes: list[str], conf: str) -> DataFrame:
    """Documents, distinct classes of each level, and confidence: mean, median, deviation, low shares."""
    middle = (stats.quantiles(df, conf, [0.5]) or [None])[0]
    low = lambda bound: F.avg((F.col(conf) < bound).cast("int"))
    return figures(
        df,
        "overview",
        [
            ("documents", F.count("*"), None),
            *((f"distinct {c}", F.countDistinct(c), None) for c in classes),
            ("mean confidence", None, F.avg(conf)),
            ("median confidence", None, F.lit(middle)),
            ("deviation of confidence", None, F.stddev_samp(conf)),
            ("confidence below 0.5", F.count(F.when(F.col(conf) < 0.5, 1)), low(0.5)),
            ("confidence below 0.3", F.count(F.when(F.col(conf) < 0.3, 1)), low(0.3)),
        ],
    )


def class_table(df: DataFrame, col: str, conf: str, section: str, top: int | None = None) -> DataFrame:
    """Size, share and mean confidence of classes; the `top` largest (ties: by name)."""
    found = stats.shares(df.where(F.col(col).isNotNull()), [col], F.avg(conf).alias("mean_conf"))
    if top is not None:
        found = found.orderBy(F.desc("n"), col).limit(top)
    return rows(found, section, F.col(col), F.col("n"), F.col("share"), F.col("mean_conf"))


def sample_titles(df: DataFrame, col: str, title: str, key: str, size: int) -> DataFrame:
    """`size` titles of each class in hash order: of those in Latin script if there are so many, else of all."""
    known = df.where(F.col(title).isNotNull()).select(col, key, F.col(title).alias("title"), T.is_latin(F.col(title)).alias("latin"))
    enough = known.groupBy(col).agg(F.count(F.when(F.col("latin"), 1)).alias("latins"))
    pool = known.join(enough, col).where(F.col("latin") | (F.col("latins") < size))
    drawn = sampling.top_per_group(pool, col, size, sampling.hash_order(key), F.col(key))
    return rows(drawn, "samples", F.col(col), F.col("rank"), text=F.substring(T.collapse(T.strip_tags(F.col("title"))), 1, 120))


def low_confidence(df: DataFrame, path: Column, title: str, conf: str, key: str, size: int = 10, bound: float = 0.3) -> DataFrame:
    found = df.where(F.col(conf) < bound).orderBy(conf, key).limit(size)
    ranked = found.withColumn("rank", F.row_number().over(W.orderBy(conf, key)))  # `size` rows
    return rows(ranked, "low confidence", path, F.col("rank"), None, F.col(conf), F.substring(T.collapse(T.strip_tags(F.col(title))), 1, 120))


def class_terms(df: DataFrame, col: str, text: str, key: str, size: int, per_class: int | None = None) -> DataFrame:
    """TF-IDF terms (words and pairs) of each class, over all its documents or a sample of `per_class` in hash order."""
    texts = df.where(F.col(text).isNotNull()).select(key, col, text)
    if per_class is not None:
        texts = sampling.sample_per_group(texts, col, key, per_class)
    found = tfidf.keywords(texts, key, text, col, size, most=2)
    return rows(found, "terms", F.col(col), F.col("rank"), None, F.col("score"), F.col("term"))


def classification_report(df: DataFrame, main: str, sub: str, div: str, conf: str, title: str, text: str, key: str, top: int = 20, terms: int = 15, samples: int = 5) -> DataFrame:
    """All seven parts in one table."""
    path = F.concat_ws("→", main, sub, div)
    parts = [
        overview(df, [main, sub, div], conf),
        class_table(df, main, conf, "main classes"),
        class_table(df, sub, conf, "subclasses", top),
        class_table(df, div, conf, "divisions", top),
        class_terms(df, main, text, key, terms),
        sample_titles(df, main, title, key, samples),
        low_confidence(df, path, title, conf, key),
    ]
    return reduce(DataFrame.unionByName, parts)


def _coherence(df: DataFrame, group: str, label: str, least: int) -> DataFrame:
    return stats.purity(df, group, label, least)


def group_validation(df: DataFrame, group: str, label: str, sim: str, least: int = 20, worst: int = 12, bins: int = 10) -> DataFrame:
    """How far classes follow a grouping that they weren't made from (journals, publishers): coverage, purity, entropy,
    lift, adjusted mutual information, the same for the quarters with most and least similarity, purity by bins of
    similarity, and the large groups of least purity. Groups of fewer than `least` rows don't count. The three columns
    are written once, as two dozen aggregates read them."""
    from ..sources.io import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    every = df.select(F.nullif(F.trim(F.col(group)), F.lit("")).alias(group), label, sim).checkpoint()
    total, known = every.count(), every.where(F.col(group).isNotNull())
    found = _coherence(known, group, label, least).checkpoint()
    mean = lambda c: stats.weighted_mean(F.col(c), F.col("n"))
    middle = (stats.quantiles(found, "purity", [0.5]) or [None])[0]
    pure = F.col("purity") >= 0.8
    parts = [
        figures(known, "coverage", [("rows with a group", F.count("*"), F.count("*") / F.lit(float(max(total, 1)))), ("distinct groups", F.countDistinct(group), None)]),
        figures(
            found,
            "coherence",
            [
                ("groups", F.count("*"), None),
                ("rows in them", F.sum("n"), F.sum("n") / F.lit(float(max(total, 1)))),
                ("purity", None, mean("purity")),
                ("median purity", None, F.lit(middle)),
                ("entropy", None, mean("norm_entropy")),
                ("groups of purity 0.8", F.count(F.when(pure, 1)), F.avg(pure.cast("int"))),
                ("rows of purity 0.8", F.sum(F.when(pure, F.col("n"))), F.sum(F.when(pure, F.col("n")).otherwise(0)) / F.sum("n")),
            ],
        ),
        rows(stats.lift(known, group, label, least), "coherence", F.lit("lift"), value=F.col("lift")),
    ]
    one = df.sparkSession.range(1)
    ami = lambda d: F.lit(stats.adjusted_mutual_information(d, group, label))
    parts.append(rows(one, "coherence", F.lit("adjusted mutual information"), value=ami(known)))
    marks = stats.quantiles(known, sim, [0.25, 0.75, *(i / bins for i in range(bins + 1))])
    quarters, cuts = marks[:2], sorted(set(marks[2:]))
    if quarters:
        for name, side in (("low similarity", known.where(F.col(sim) <= quarters[0])), ("high similarity", known.where(F.col(sim) >= quarters[1]))):
            inside = _coherence(side, group, label, max(5, least // 2))
            parts.append(rows(one, name, F.lit("adjusted mutual information"), value=ami(side)))
            parts.append(figures(inside, name, [("purity", F.sum("n"), mean("purity"))]))
        binned = known.withColumn("bin", stats.quantile_bin(F.col(sim), cuts))
        # One pass for all bins: a group within a bin is a group of its own.
        cells = binned.withColumn("cell", F.struct("bin", group))
        inside = _coherence(cells, "cell", label, 5).groupBy(F.col("cell.bin").alias("bin")).agg(mean("purity").alias("purity"), F.sum("n").alias("n"))
        parts.append(rows(inside, "bins of similarity", F.col("bin"), F.col("n"), None, F.col("purity")))
    large = found.where(F.col("n") >= max(least, 100)).orderBy("purity", group).limit(worst)
    parts.append(rows(large, "least coherent", F.col(group), F.col("n"), None, F.col("purity"), F.col("dominant")))
    return reduce(DataFrame.unionByName, parts)


def gold_template(df: DataFrame, journal: str, title: str, label: str, key: str, top: int = 200, samples: int = 8, keywords: int = 12, stop: tuple[str, ...] = (), fold=T.nfkc) -> DataFrame:
    """The largest journals with what helps to label them by hand: sample titles (the first different ones by key),
    keywords of the titles, and the dominant class, which is no more than a hint; empty columns to be filled."""
    clean = lambda c: T.collapse(T.strip_tags(fold(c), " "))
    rows_ = df.select(key, clean(F.col(journal)).alias("journal"), clean(F.col(title)).alias("title"), F.col(label).alias("label"))
    rows_ = rows_.where(F.coalesce(F.col("journal"), F.lit("")) != "")
    largest = stats.value_counts(rows_, "journal").orderBy(F.desc("n"), "journal").limit(top)
    kept = rows_.join(F.broadcast(largest.select("journal")), "journal")  # `top` rows
    hints = stats.purity(kept, "journal", "label").select("journal", F.col("dominant").alias("model_guess"), F.round("purity", 3).alias("model_purity"))
    first = kept.where(F.coalesce(F.col("title"), F.lit("")) != "").groupBy("journal", "title").agg(F.min(key).alias("first"))
    shown = sampling.top_per_group(first, "journal", samples, F.col("first"))
    titles = shown.groupBy("journal").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("title", 1, 90).alias("t")))).alias("s"))
    titles = titles.select("journal", F.array_join(F.transform("s", lambda s: s["t"]), " | ").alias("sample_titles"))
    words = tfidf.keywords(kept.where(F.col("title") != ""), key, "title", "journal", keywords, most=2, stop=[*tfidf.STOP_WORDS, *stop])
    terms = words.groupBy("journal").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("s"))
    terms = terms.select("journal", F.array_join(F.transform("s", lambda s: s["term"]), ", ").alias("top_keywords"))
    out = largest.join(hints, "journal", "left").join(titles, "journal", "left").join(terms, "journal", "left")
    empty = [F.lit("").alias(c) for c in ("gold_lcc_main", "gold_lcc_sub", "gold_lcc_div", "notes")]
    return out.select("journal", F.col("n").alias("n_papers"), F.coalesce("top_keywords", F.lit("")).alias("top_keywords"), F.coalesce("sample_titles", F.lit("")).alias("sample_titles"), "model_guess", "model_purity", *empty)


def gold_variant(template: DataFrame, codes: DataFrame, applied: list[str], applied_code: str) -> DataFrame:
    """The template with codes (journal, code); journals of `applied` get one code together. No code: ''."""
    code = F.when(F.col("journal").isin(applied), F.lit(applied_code)).otherwise(F.coalesce("code", F.lit("")))
    made = template.drop("gold_lcc_main", "gold_lcc_sub", "gold_lcc_div").join(codes, "journal", "left")
    out = made.withColumn("gold_lcc_sub", code).drop("code")
    return out.withColumn("gold_lcc_main", F.substring("gold_lcc_sub", 1, 1)).withColumn("gold_lcc_div", F.lit(""))


def gold_buckets(template: DataFrame, codes: DataFrame, journals: dict[str, list[str]] = JOURNAL_BUCKET, adjacent: dict[str, list[str]] = ADJACENT) -> DataFrame:
    """The template with buckets: the journal's own if it has one, else its code and the codes next to it."""
    own = F.lit(None).cast("string")
    for name, found in journals.items():
        own = F.when(F.col("journal") == name, F.lit("|".join(sorted(found)))).otherwise(own)
    made = template.drop("gold_lcc_main", "gold_lcc_sub", "gold_lcc_div").join(codes, "journal", "left")
    out = made.withColumn("gold_lcc_sub", F.coalesce(own, bucket(F.coalesce("code", F.lit("")), adjacent))).drop("code")
    mains = F.array_sort(F.array_distinct(F.transform(F.split("gold_lcc_sub", r"\|"), lambda c: F.substring(c, 1, 1))))
    return out.withColumn("gold_lcc_main", F.array_join(mains, "|")).withColumn("gold_lcc_div", F.lit(""))


def assembled(df: DataFrame, cluster: str, names: DataFrame, merged: DataFrame, mains: DataFrame, keep: list[str]) -> DataFrame:
    """The final dataset: kept columns, main_topic_name, main_topic_id, subtopic_name, subtopic_id. `names`:
    cluster and name; `merged`: name and main topic; `mains`: main topic and its name."""
    sub = names.select(F.col(names.columns[0]).alias("subtopic_id"), F.col(names.columns[1]).alias("subtopic_name"))
    up = merged.select(F.col(merged.columns[0]).alias("subtopic_name"), F.col(merged.columns[1]).cast("long").alias("main_topic_id"))
    top = mains.select(F.col(mains.columns[0]).cast("long").alias("main_topic_id"), T.topic_name(F.col(mains.columns[1])).alias("main_topic_name"))
    out = df.withColumn("subtopic_id", F.col(cluster).cast("long")).join(sub, "subtopic_id", "left").join(up, "subtopic_name", "left").join(top, "main_topic_id", "left")
    return out.select(*keep, "main_topic_name", "main_topic_id", "subtopic_name", "subtopic_id")


def diagnostics(df: DataFrame, key: str, vector: str, truth: str, predicted: str, conf: str, held: Column, outlier: Column, levels: tuple[float, ...] = (0.999, 0.99, 0.95), weakest: int = 15) -> DataFrame:
    """Whether held-out figures of a classifier can be believed. On the held-out rows: its accuracy, that of nearest
    centroids and of the nearest training row (if they match, the labels were in the vectors already), the share of rows
    with a near copy in training, and the classes of least F1. Over all rows: how many no figure covers, and how sure the
    classifier is of outliers, which no class holds. Rows are known by `key`; outliers and rows without a class are in no split."""
    from ..sources.io import ensure_checkpoint_dir
    from . import vectors as V

    ensure_checkpoint_dir(df.sparkSession)
    no = lambda c: F.coalesce(c, F.lit(False))
    all_ = df.select(key, truth, predicted, conf, V.normalise(F.col(vector)).alias("_u"), no(held).alias("_held"), no(outlier).alias("_out")).checkpoint()  # many passes
    used = all_.where(~F.col("_out") & F.col(truth).isNotNull())
    seen, asked = used.where("not _held"), used.where("_held")
    means = V.centroids(seen, truth, "_u", unit=True).withColumnRenamed(truth, "_class")
    near = V.nearest(asked, [key, truth], "_u", means, "_class")
    rows_ = V.nearest_rows(seen, key, "_u", asked, truth).checkpoint()
    middle = (stats.quantiles(rows_, "sim", [0.5]) or [None])[0]
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))
    report = stats.accuracy_report(asked, truth, predicted).where("support > 0")
    least = report.orderBy(F.round("f1", 9), "label").limit(weakest)
    inside, out = F.col("_held") & ~F.col("_out") & F.col(truth).isNotNull(), F.col("_out")
    use = ~F.col("_out") & F.col(truth).isNotNull()
    share = lambda c: F.avg(c.cast("int"))
    parts = [
        figures(report, "model", [("accuracy", F.sum("support"), F.sum("tp") / F.sum("support")), ("balanced accuracy", F.count("*"), F.avg("recall"))]),
        figures(near, "controls", [("nearest centroid", F.count("*"), same(truth, "_class"))]),
        figures(rows_, "controls", [("nearest row", F.count("*"), same(truth, "near_label"))]),
        figures(rows_, "leakage", [*((f"similarity {x}", F.count(F.when(F.col("sim") >= x, 1)), share(F.col("sim") >= x)) for x in levels), ("median similarity", None, F.lit(middle))]),
        figures(all_, "coverage", [("rows", F.count("*"), None), ("outliers", F.count(F.when(out, 1)), share(out)), ("used", F.count(F.when(use, 1)), share(use)), ("excluded", F.count(F.when(~use, 1)), share(~use))]),
        figures(all_, "confidence", [("held out", F.count(F.when(inside, 1)), F.avg(F.when(inside, F.col(conf)))), ("outliers", F.count(F.when(out, 1)), F.avg(F.when(out, F.col(conf)))), ("outliers above 0.9", F.count(F.when(out & (F.col(conf) > 0.9), 1)), F.avg(F.when(out, (F.col(conf) > 0.9).cast("int"))))]),
        rows(least, "weakest classes", F.col("label"), F.col("support"), None, F.col("f1")),
    ]
    return reduce(DataFrame.unionByName, parts)


def selected_setting(results: DataFrame, count: str, score: str, low: int, high: int) -> DataFrame:
    """The rows of a grid search with `selected`: the best score among those with a count in the window, or, if there is
    none, among all; ties take the least count."""
    inside = F.col(count).between(low, high)
    place = F.row_number().over(W.orderBy(F.desc(inside), F.desc(score), count))  # one row a setting: few
    return results.withColumn("selected", place == 1)
