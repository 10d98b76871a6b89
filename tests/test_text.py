import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, column, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "fn, value, expected",
    [
        (T.decode_abstract, "&lt;b&gt;x", "x"),
        (T.decode_abstract, " <p> ", None),
        (T.clean_text, "&lt;b&gt;x", "<b>x"),
        (T.clean_text, r"<b>A</b> $x$ \textbf{y} \alpha z", "A x y z"),
        (T.clean_text, r"\begin{eq}a\end{eq}", "eqaeq"),
        (T.clean_text, "a　　b", "a b"),
        (T.clean_text, None, ""),
        (T.cjk_ratio, "日本abcあ", 0.5),
        (T.cjk_ratio, "", 0.0),
        (T.is_informative, "Short.", False),
        (T.is_informative, "Article " + "long text, " * 20, False),
        (T.is_informative, "We measure " + "long text, " * 20, True),
        (T.is_informative, "word " * 40, False),
        (T.is_informative, None, False),
        (T.is_boilerplate, "Type: text", True),
        (T.is_boilerplate, "typed text", False),
        (T.document_type, "LHD #12345 shot", "diagnostic_report"),
        (T.document_type, "Steel", "scientific_paper"),
        (T.document_type, None, "unknown"),
        (T.normal_language, "ZH-TW", "zh"),
        (T.normal_language, "xx", None),
        (T.join_key, "ＣＨＥＭＩＣＡＬ　＆", "CHEMICAL &"),
        (T.join_key, None, None),
        (T.year_strict, "19990101", None),
        (T.year_loose, "19990101", 1999),
        (T.year_strict, "2031-01", None),
        (T.year_loose, "2031-01", 2031),
        (T.year_strict, "c1987p", None),
        (T.year_loose, "c1987p", 1987),
        (T.word_count, " a  b\n", 2),
        (T.word_count, None, 0),
        (T.leading_letter, "TK7874", "T"),
        (T.leading_letters, "TK7874", "TK"),
        (T.topic_name, "**Heat** *(of many)*\nmore", "Heat"),
        (lambda c: T.truncate_words(c, 8), "one two three", "one two…"),
        (T.html_unescape, "&eacute;&#233;", "éé"),
    ],
)
def test_scalars(spark, fn, value, expected):
    assert one(spark, fn(F.col("x")), value=value) == expected


def test_tiers_and_authors(spark):
    for value, tier in ((None, "unknown"), (0.39, "reject"), (0.40, "low"), (0.57, "medium"), (0.67, "trust")):
        assert one(spark, T.trust_tier(F.col("x")), "x double", value) == tier
    assert one(spark, T.join_authors(F.col("x")), "x array<string>", ["A", None, "", "B"]) == "A; B"


def test_llm_reply(spark):
    r = one(spark, T.llm_reply(F.col("x")), value='<think>{"lcc":"X"}</think>{"lcc": "tk9", "confidence": 4}')
    assert (r.code, r.confidence, r.reason) == ("TK9", 4, "")
    assert one(spark, T.llm_reply(F.col("x")), value="none").code == ""
    assert one(spark, T.known_code(F.col("x"), ["TK", "Q"]), value="TK9") == "TK"
    assert one(spark, T.known_code(F.col("x"), ["TK", "Q"]), value="") == "UNKNOWN"


def test_references_as_the_standard_library(spark):
    """Every name with and without its end, numbers around all bounds, and what is no reference; no Python in the plan."""
    from html import unescape
    from html.entities import html5

    edges = [0, 1, 8, 9, 10, 11, 12, 13, 14, 31, 32, 126, 127, 128, 129, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 9999999, 10**9, 10**30]
    texts = [f"a&{k}b" for k in html5] + [f"&{k.rstrip(';')};&{k.rstrip(';')}" for k in html5]
    texts += [f"x&#{n};y&#{n}z&#x{n:x};&#X{n:X} &#000{n};&#x000{n:x}g" for n in [*edges, *range(0x80, 0xA0)]]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&NoSuch;", "&" + "a" * 40 + ";", "tail&", "&amp", "日&yen;本&copy", "&lt\n", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", "x", T.html_unescape(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in rows.orderBy("i").collect()] == [(x, x if x is None else unescape(x)) for x in texts]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "str_to_map" not in plan  # the table of names is worked out once
