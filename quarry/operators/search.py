"""Search over documents: projection, inverted index with BM25 and typos, facets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .taxonomy import facet_levels

K1, B = 1.2, 0.75


def search_documents(df: DataFrame, key: str, title: str, abstract: str, abstract_chars: int = 600) -> DataFrame:
    """One document per row with a title: truncated abstract, year, classes, facet paths, trust tier."""
    c = lambda x: F.col(x) if x in df.columns else F.lit(None).cast("string")
    kept = df.where(F.trim(F.coalesce(F.col(title), F.lit(""))) != "")
    return kept.select(
        F.col(key).alias("id"),
        F.col(title).alias("title"),
        T.truncate_words(F.col(abstract), abstract_chars).alias("abstract"),
        c("journal").alias("journal"),
        T.year_loose(c("publication_date")).alias("year"),
        c("main").alias("pred_main"),
        c("sub").alias("pred_sub"),
        c("div").alias("pred_div"),
        F.bround("conf", 4).alias("conf_div"),
        F.bround("sim", 4).alias("pred_centroid_sim"),
        T.trust_tier(F.col("sim")).alias("trust_tier"),
        facet_levels(c("main"), c("sub"), c("div")).alias("facet"),
    )


def inverted_index(df: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """(term, key, tf, words): postings; write them partitioned or bucketed by term for repeated use. With `terms`, for
    one search of texts without an index, only theirs: other words are dropped within their row."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    flat = df.select(key, words.alias("w"))
    chosen = F.filter("w", lambda x: x.isin(terms)) if terms else F.col("w")
    flat = flat.select(key, F.size("w").alias("words"), F.explode(chosen).alias("term"))
    return flat.groupBy("term", key, "words").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, stats: DataFrame, key: str, terms: list[str], typos: int = 0) -> DataFrame:
    """(key, matched, score) of the documents with any of the terms. `stats`: one row n, mean (words)."""
    queried = F.array(*map(F.lit, terms))
    if typos:
        hit = F.filter(queried, lambda q: F.levenshtein(F.col("term"), q) <= typos)
    else:
        hit = F.filter(queried, lambda q: F.col("term") == q)
    postings = index.where(F.col("term").isin(terms)) if not typos else index
    postings = postings.select("*", F.explode(hit).alias("q"))
    found = postings.groupBy("term").agg(F.countDistinct(key).alias("df"))
    joined = postings.join(found, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.col("mean")))
    return joined.groupBy(key).agg(F.countDistinct("q").alias("matched"), F.sum(part).alias("score"))


def placed_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, term): all words of the texts with their places (from 0)."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))).alias("pos", "term"))


def positions_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, positions): postings with places (from 0), one row for each term of a document."""
    return placed_words(df, key, text).groupBy("term", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def ranked_texts(df: DataFrame, key: str, text: str, words: list[str], far: int = 8) -> DataFrame:
    """`ranked` for one search of texts without an index: only postings of the terms that the words stand for are made."""
    every = placed_words(df, key, text)
    hits = matching_terms(every, words)
    found = every.join(F.broadcast(hits.select("term").distinct()), "term")  # spellings of the query's words
    return ranked(found.groupBy("term", key).agg(F.sort_array(F.collect_list("pos")).alias("positions")), key, words, far, hits)


def allowed_typos(word: str) -> int:
    """None in words of up to 4 letters, one in up to 8, then two."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def matching_terms(index: DataFrame, words: list[str]) -> DataFrame:
    """(term, i, typos): the distinct terms near enough to a query's words. Others are dropped before terms meet."""
    near = [
        F.when((F.abs(F.length("term") - len(w)) <= 2) & (F.levenshtein("term", F.lit(w)) <= allowed_typos(w)), F.struct(F.lit(i).alias("i"), F.levenshtein("term", F.lit(w)).alias("typos")))
        for i, w in enumerate(words)
    ]
    return index.select("term", F.explode(F.array_compact(F.array(*near))).alias("m")).select("term", "m.i", "m.typos").distinct()


def closest(a: Column, b: Column) -> Column:
    """The least distance of a number of one array to one of another: neighbours in the order of both."""
    tag = lambda xs, t: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(t).alias("t")))

    def least(both: Column) -> Column:
        steps = F.zip_with(F.slice(both, 1, F.size(both) - 1), F.slice(both, 2, F.size(both) - 1), lambda p, q: F.when(p["t"] != q["t"], q["x"] - p["x"]))
        return F.array_min(steps)

    return F.transform(F.array(F.array_sort(F.concat(tag(a, 0), tag(b, 1)))), least)[0]


def ranked(index: DataFrame, key: str, words: list[str], far: int = 8, hits: DataFrame | None = None) -> DataFrame:
    """(key, matched, typos, proximity): how many of the words a document has, the typos of the best match of each, and
    the sum over neighbouring words of their least distance, `far` at most (and for words it lacks). Sort by
    matched descending, then typos, then proximity. hits: the terms (term, i, typos) that the words stand for, if known."""
    hits = matching_terms(index, words) if hits is None else hits
    found = index.join(hits, "term").groupBy(key, "i").agg(F.min("typos").alias("typos"), F.flatten(F.collect_list("positions")).alias("positions"))
    docs = found.groupBy(key).agg(F.count("*").alias("matched"), F.sum("typos").alias("typos"), F.map_from_entries(F.collect_list(F.struct("i", "positions"))).alias("at"))
    step = lambda i: F.least(F.lit(far), F.coalesce(closest(F.try_element_at("at", F.lit(i)), F.try_element_at("at", F.lit(i + 1))), F.lit(far)))
    near = F.lit(0)
    for i in range(len(words) - 1):
        near = near + step(i)
    return docs.select(key, "matched", "typos", near.cast("long").alias("proximity"))


def sorted_pages(df: DataFrame, key: str, sorts: dict[str, Column], size: int) -> DataFrame:
    """The first page under each sort: (sort, key, k)."""
    from pyspark.sql import Window as W

    made = []
    for name, order in sorts.items():
        first = page(df, 0, size, order, F.col(key))
        made.append(first.select(F.lit(name).alias("sort"), key, F.row_number().over(W.orderBy(order, key)).cast("long").alias("k")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def facet_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of each path of a hierarchy, all levels in one pass: (level, path, n)."""
    made = F.array(*(F.struct(F.lit(i).alias("level"), F.col(c).alias("path")) for i, c in enumerate(levels)))
    flat = df.select(F.explode(made).alias("f")).select("f.level", "f.path").where("path is not null")
    return flat.groupBy("level", "path").agg(F.count("*").alias("n"))


def refinements(df: DataFrame, facet: str, filters: dict[str, list], size: int) -> DataFrame:
    """Values of a facet with counts under all filters but its own."""
    for col, values in filters.items():
        if col != facet:
            df = df.where(F.col(col).isin(values))
    return df.groupBy(facet).agg(F.count("*").alias("n")).orderBy(F.desc("n"), facet).limit(size)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Rows of a page (from 0) in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def snippet(text: Column, words: int = 55) -> Column:
    return F.array_join(F.slice(F.split(T.collapse(text), " "), 1, words), " ")
