"""Operator 4. Quality rules: a table of thresholds compiled into Spark projections, without user functions.

`RULES` is the table. Each row bounds one ratio; `compile_rules` turns the rows into one boolean column. The
figures they use are made from the whole text with built-in functions only, row by row: no shuffle.

Defined results: a null or empty text has no words, so its figures are 0 and it is rejected by the base rule;
very long texts are judged whole, in n log n steps; repeated rows each give a row, equal texts (ties) equal figures;
a null id is kept; an empty table gives an empty table; other columns of the input are not looked at. A ratio whose denominator is 0 is 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words, as a character class.
SPACES = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and a to in is that it with for on was as by this be are at
der die und den von zu das sich mit auf des für im ist nicht dem ein eine als
de la le et les un en du une que est pour qui dans au par sur pas avec
el y los se las del por con no para es al su una
""".split()


class Rule(NamedTuple):
    """`low` <= `over` / `under` <= `high`, where None is no bound."""

    name: str
    over: str
    under: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.05, None),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 0.4),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: whether a row of figures is within all bounds."""
    kept = F.lit(True)
    for r in rules:
        ratio = F.when(F.col(r.under) > 0, F.col(r.over) / F.col(r.under)).otherwise(F.lit(0.0))
        if r.low is not None:
            kept = kept & (ratio >= r.low)
        if r.high is not None:
            kept = kept & (ratio <= r.high)
    return kept


def text_figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and the counts that the rules use, for each row; with `carry` also the input row, as a struct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct("*").alias("row")] if carry else []
    source = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), *row)
    row = ["row"] if carry else []
    bare = F.call_function("btrim", F.col("text"), F.lit(TRIM))
    words = F.when(bare != "", F.split(bare, SPACES)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.call_function("btrim", line, F.lit(TRIM)) != "")
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    first = source.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        *row,
    )
    # The 3-word windows in order of their hashes, with their places: equal windows become neighbours, which takes
    # n log n steps where a comparison of all pairs takes n squared. (Two different windows of a text of a thousand
    # words have one of 2^64 hashes with odds of 1 in 10^13.)
    n = F.size("words")
    w = F.col("words")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i")),
    )
    second = first.select(
        "doc_id",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(windows)).alias("windows"),
        *row,
    )
    v = F.col("windows")
    repeated = F.filter(
        F.sequence(F.lit(0), F.size(v) - 1),
        lambda k: (v[k]["t"] == F.get(v, k + 1)["t"]) | (v[k]["t"] == F.get(v, k - 1)["t"]),
    )
    # Words covered by the windows that start at some places, in order: three for each, less where the next begins.
    starts = F.sort_array(F.transform(repeated, lambda k: v[k]["i"]))
    covered = lambda at: F.when(F.size(at) > 0, 3 + F.aggregate(
        F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda x, y: F.least(F.lit(3), y - x)), F.lit(0), lambda total, x: total + x
    )).otherwise(0)
    n_repeat = F.transform(F.array(starts), covered)[0]
    figures = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.when(v.isNotNull(), n_repeat), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words",
        "n_lines",
    )
    # A filter on figures would be moved below the projections and so write the windows' sort into it once for each
    # place that names them. It can't pass a generator, so the figures are the single output row of one.
    return second.select("doc_id", *row, F.explode(F.array(figures)).alias("f")).select("doc_id", "f.*", *row)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of `df` that the rules keep, unchanged."""
    figures = text_figures(df, id_col, text_col, carry=True)
    return figures.where(~base_failed() & compile_rules(rules)).select("row.*")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The figures of `text_figures` with base_failed and kept."""
    figures = text_figures(df, id_col, text_col)
    judged = figures.withColumn("base_failed", base_failed())
    return judged.select("*", (~F.col("base_failed") & compile_rules(rules)).alias("kept")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines",
    )


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    bounds = []
    for r in rules:
        ratio = f"(CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under} ELSE 0.0 END)"
        bounds += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
figures AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines
  FROM t LEFT JOIN covered ON covered.doc_id = t.doc_id),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM base
"""
