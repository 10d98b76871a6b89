"""Codes with a prefix hierarchy: labels, facet paths, mapping tables, voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the classification's main classes.
MAIN = {
    "A": "General Works", "B": "Philosophy, Psychology, Religion", "C": "Auxiliary Sciences of History",
    "D": "World History", "E": "American History", "F": "Local History of the Americas",
    "G": "Geography, Anthropology, Recreation", "H": "Social Sciences", "J": "Political Science", "K": "Law",
    "L": "Education", "M": "Music", "N": "Fine Arts", "P": "Language and Literature", "Q": "Science",
    "R": "Medicine", "S": "Agriculture", "T": "Technology", "U": "Military Science", "V": "Naval Science",
    "Z": "Bibliography, Library Science",
}
# Classes whose papers also count as right for a journal of the first class.
ADJACENT = {
    "QC": ["TK"], "QP": ["RC", "QH"], "QH": ["QP"], "QR": ["RC"], "QB": ["QC"], "QK": ["QH"], "QL": ["QH"],
    "QE": ["QC", "GB"], "GB": ["QE"], "QA": ["TK"], "RM": ["RC", "QP"], "RD": ["RC"], "RK": ["RC"], "RF": ["RC"],
    "RB": ["RC"], "R": ["RC"], "TA": ["TK", "TN"], "TK": ["TA", "QA"], "TN": ["TA"], "TJ": ["TA"],
}


def as_map(pairs: dict) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), lit(v))))


def coded_label(code: Column, labels: dict[str, str]) -> Column:
    """'code — label', or the code alone if it has none."""
    c = F.trim(F.coalesce(code, F.lit("")))
    name = F.try_element_at(as_map(labels), c)
    return F.when(name.isNotNull(), F.concat(c, F.lit(" — "), name)).otherwise(c)


def facet_levels(main: Column, sub: Column, div: Column, mains: dict[str, str] = MAIN, subs: dict[str, str] | None = None) -> Column:
    """struct(lvl0, lvl1, lvl2), each path with its parents; null without a main class."""
    m, s, d = (F.trim(F.coalesce(c, F.lit(""))) for c in (main, sub, div))
    zero = coded_label(m, mains)
    one = F.when(s != "", F.concat(zero, F.lit(" > "), coded_label(s, subs) if subs else s))
    two = F.when((s != "") & (d != ""), F.concat(one, F.lit(" > "), d))
    return F.when(m != "", F.struct(zero.alias("lvl0"), one.alias("lvl1"), two.alias("lvl2")))


def bucket(code: Column, adjacent: dict[str, list[str]] = ADJACENT) -> Column:
    """The code and its neighbours, in order, joined by '|'; '' for no code."""
    near = F.coalesce(F.try_element_at(as_map(adjacent), code), F.array().cast("array<string>"))
    both = F.array_sort(F.array_union(F.array(code), near))
    return F.when(F.coalesce(code, F.lit("")) != "", F.array_join(both, "|")).otherwise("")


def in_bucket(gold: Column, predicted: Column) -> Column:
    """Whether a prediction is among codes joined by '|'; never for ''."""
    return F.coalesce((gold != "") & F.array_contains(F.split(gold, r"\|"), predicted), F.lit(False))


def resolve_mapping(df: DataFrame, code: str, suggested: str, skip: str) -> DataFrame:
    """Rows not to be skipped, with blank codes replaced by the suggestion, trimmed and in capitals."""
    kept = df.where(F.lower(F.trim(F.coalesce(skip, F.lit("")))) != "yes")
    chosen = F.when(F.trim(F.coalesce(code, F.lit(""))) == "", F.col(suggested)).otherwise(F.col(code))
    return kept.withColumn(code, F.upper(F.trim(chosen)))


def vote(df: DataFrame, group: str, sub: str, div: str, conf: str) -> DataFrame:
    """Per group: the majority sub with its share and mean confidence, and the majority div within it."""
    cells = df.groupBy(group, sub, div).agg(F.count("*").alias("c"), F.sum(conf).alias("s"))
    subs = cells.groupBy(group, sub).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.min(F.struct((-F.col("c")).alias("k"), div)).alias("d"))
    out = subs.groupBy(group).agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.min(F.struct((-F.col("c")).alias("k"), sub, F.col(f"d.{div}").alias(div))).alias("b"))
    n = F.col("n")
    return out.select(group, "n", F.col(f"b.{sub}").alias(sub), F.col(f"b.{div}").alias(div), (-F.col("b.k") / n).alias("agreement"), (F.col("s") / n).alias("mean_conf"))
