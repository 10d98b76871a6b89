"""The cleaning cascade: cheap built-in predicates first, each row judged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.language import detect_language


def drop_blank(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns all hold more than white space."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    return df


def keep_english(df: DataFrame, lang: str = "abstract_lang", text: str = "clean_abstract") -> tuple[DataFrame, DataFrame]:
    """(English, the others): the language is exactly 'en' and few characters are Chinese or Japanese."""
    english = F.coalesce((F.col(lang) == "en") & (T.cjk_ratio(F.col(text)) < T.CJK_LIMIT), F.lit(False))
    return df.where(english), df.where(~english)


def clean_cascade(df: DataFrame, unescape=T.html_unescape) -> tuple[DataFrame, DataFrame]:
    """(papers, other languages) from title, abstract and, if there is one, lang: not blank, informative, cleaned,
    English, no diagnostic reports. Adds clean_title, clean_abstract, abstract_lang (detected where there is no
    column lang), type."""
    kept = drop_blank(df, "title", "abstract").where(T.is_informative(F.col("abstract")))
    # A generator's single row: filters on what is made here can't be moved below it, so nothing is made twice.
    made = F.struct(
        T.clean_text(F.col("abstract"), unescape).alias("clean_abstract"),
        T.clean_text(F.col("title"), unescape).alias("clean_title"),
        (F.col("lang") if "lang" in df.columns else detect_language(F.col("abstract"))).alias("abstract_lang"),
        T.document_type(F.col("title")).alias("type"),
    )
    cleaned = kept.select("*", F.explode(F.array(made)).alias("made")).select(*kept.columns, "made.*")
    english, other = keep_english(cleaned)
    return english.where(F.col("type") == "scientific_paper"), other
