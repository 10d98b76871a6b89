"""Text expressions over columns; all built-in functions but for `nfkc`, which Spark lacks."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, at either end or in runs.
SPACE = r"(?U)\s+"

# What marks records without an abstract, diagnostic reports and boilerplate.
META_PREFIXES = ("article", "論文", "type:", "identifier:", "application/", "text/", "pdf", "html", "doi", "report")
MIN_INFORMATIVE = 100
SENTENCE_MARKS = (".", "。", "、", ",")
CITATION = r"^.*(pp?\.?\s*[0-9一二三四五六七八九十]+[-‐~〜][0-9一二三四五六七八九十]+).*;?\s*(\d{4})$"
DIAGNOSTIC = r"\blhd\s*(bolometer|flxloop|fpellet|interferometer|cxrs|ece|diagnostic|probe)\b|^lhd\b|\blhd\s*#?\d+"
BOILERPLATE = r"(?i)^(type|application|departmental|bulletin|text|論文|記事|表紙|裏表紙|奥付|目次)\b"
CJK = "[぀-ゟ゠-ヿ一-鿿㐀-䶿]"
CJK_LIMIT = 0.05
LANGUAGES = {
    "ja": "ja", "zh": "zh", "zh-cn": "zh", "zh-tw": "zh", "zh-hk": "zh", "ko": "ko", "fr": "fr", "de": "de",
    "es": "es", "ru": "ru", "it": "it", "pt": "pt", "nl": "nl", "ar": "ar", "hi": "hi", "en": "en",
}
TIERS = ((0.40, "reject"), (0.57, "low"), (0.67, "medium"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return s.map(lambda x: normalize("NFKC", x), na_action="ignore")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is evaluated once however often `use` names it: as a variable of a higher-order function,
    which the optimizer doesn't write out again."""
    return F.transform(F.array(c), use)[0]


def _character(number: Column) -> Column:
    """The character of a numeric reference (`233` or `xe9`): code page 1252 for 80 to 9F, U+FFFD for zero and for what is
    no character, nothing for control codes and those that Unicode sets aside."""
    hexadecimal = number.rlike("^[xX]")
    digits = F.regexp_replace(number, "^[xX]?0*(?=.)", "")
    value = F.when(F.length(digits) > 7, 0x110000).when(hexadecimal, F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))
    windows = F.split(F.lit("\0".join(bytes([x]).decode("cp1252", "replace").replace("\ufffd", chr(x)) for x in range(0x80, 0xA0))), "\0")

    def chosen(n: Column) -> Column:
        away = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        # A byte order mark stands before the character, so that one which is itself asked for stays.
        plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
        none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(none, "\ufffd").when(n.between(0x80, 0x9F), F.get(windows, n - 0x80)).when(away, "").otherwise(plain)

    return once(value, chosen)


def _reference(piece: Column) -> Column:
    """What stands behind one `&`, the character reference at its start decoded; with the `&` again if there is none. A
    name with `;` counts as a whole, else the longest of the old names, which need none."""
    names = F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in html5.items() if k[-1] == ";")), F.lit("\1"), F.lit("\2"))
    short = "^(?:" + "|".join(sorted((k for k in html5 if k[-1] != ";"), key=len, reverse=True)) + ")"
    number = F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
    name, old = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};", 0), F.regexp_extract(piece, short, 0)
    after = lambda found: F.substr(piece, F.length(found) + 1)
    whole = F.when(name != "", F.concat(names[name], after(name)))
    start = F.when(old != "", F.concat(names[F.concat(old, F.lit(";"))], after(old)))
    digits = F.concat(_character(number), F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))
    return F.when(number != "", digits).otherwise(F.coalesce(whole, start, F.concat(F.lit("&"), piece)))


def html_unescape(c: Column) -> Column:
    """All named and numeric character references, as the standard library decodes them: the text is cut at `&`."""

    def decoded(pieces: Column) -> Column:
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _reference), ""))

    return once(c, lambda text: F.when(F.contains(text, F.lit("&")), once(F.split(text, "&"), decoded)).otherwise(text))


def basic_unescape(c: Column) -> Column:
    """The XML entities and the most frequent HTML ones, without leaving the JVM: for texts known to hold no others."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def collapse(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def decode_abstract(c: Column, unescape=html_unescape) -> Column:
    """References first, so that escaped tags go too; null if nothing is left."""
    text = collapse(strip_tags(unescape(c), " "))
    return F.when(text != "", text)


def clean_text(c: Column, unescape=html_unescape) -> Column:
    """Tags, references, TeX and white space; '' for null. References come after tags, so escaped tags stay."""
    text = unescape(strip_tags(c, " "))
    text = F.regexp_replace(text, r'\\"([a-zA-Z])', "$1")
    text = F.regexp_replace(text, r"\\'", "")
    text = F.regexp_replace(text, r"\$(.*?)\$", "$1")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\{(.*?)\}", "$1")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+", "")
    text = F.replace(F.replace(text, F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))
    return F.coalesce(collapse(text), F.lit(""))


def cjk_ratio(c: Column) -> Column:
    def ratio(text: Column) -> Column:
        return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(CJK)) / F.length(text)).otherwise(F.lit(0.0))

    return once(F.coalesce(c, F.lit("")), ratio)


def is_informative(c: Column) -> Column:
    """Long enough, no metadata, no citation, and with a mark between or behind sentences."""

    def judge(t: Column) -> Column:
        meta = t.rlike("^(?:" + "|".join(META_PREFIXES) + ")")
        marked = t.rlike("[" + "".join(SENTENCE_MARKS) + "]")
        return (F.length(t) >= MIN_INFORMATIVE) & ~meta & marked & ~t.rlike(CITATION)

    return F.coalesce(once(F.lower(F.btrim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), judge), F.lit(False))


def is_boilerplate(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(BOILERPLATE)


def document_type(title: Column) -> Column:
    t = F.lower(F.btrim(title))
    return F.when(title.isNull(), "unknown").when(t.rlike(DIAGNOSTIC), "diagnostic_report").otherwise("scientific_paper")


def normal_language(c: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(c))


def join_key(c: Column, fold=nfkc) -> Column:
    """Compatibility form without tags, in one spacing: the key by which names are joined. Null stays null."""
    return collapse(strip_tags(fold(c)))


def is_latin(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9\s\-\.,;:'\"()/&+]+$"), F.lit(False))


def word_count(c: Column) -> Column:
    text = collapse(F.coalesce(c, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def year_strict(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(r"\b(19[5-9]\d|20[012]\d)\b")).cast("int")


def year_loose(c: Column) -> Column:
    return F.regexp_substr(c, F.lit(r"(1[5-9]\d{2}|20\d{2})")).cast("int")


def join_authors(c: Column) -> Column:
    return F.array_join(F.filter(c, lambda x: x != ""), "; ")


def trust_tier(c: Column) -> Column:
    out = F.when(c.isNull(), "unknown")
    for bound, name in TIERS:
        out = out.when(c < bound, name)
    return out.otherwise("trust")


def truncate_words(c: Column, size: int) -> Column:
    """The first `size` characters, back to the last space, with an ellipsis; shorter texts stay."""
    return F.when(F.length(c) <= size, c).otherwise(
        F.concat(F.regexp_replace(F.substring(c, 1, size), r"(?s) [^ ]*$", ""), F.lit("…"))
    )


def leading_letter(c: Column) -> Column:
    return F.substring(c, 1, 1)


def leading_letters(c: Column) -> Column:
    return F.regexp_substr(c, F.lit("^[A-Z]+"))


def llm_reply(c: Column) -> Column:
    """code, confidence, reason from a model's reply: no thoughts, the first flat JSON object, defaults."""
    bare = F.btrim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    found = F.regexp_substr(bare, F.lit(r"(?s)\{[^{}]+\}"))
    get = lambda k: F.get_json_object(found, f"$.{k}")
    return F.struct(
        F.upper(F.btrim(F.coalesce(get("lcc"), F.lit("")))).alias("code"),
        F.coalesce(get("confidence").cast("int"), F.lit(1)).alias("confidence"),
        F.coalesce(get("reason"), F.lit("")).alias("reason"),
    )


def known_code(code: Column, codes: list[str]) -> Column:
    """The code if it is one of `codes`; else the first of them, in their order, that it starts with; else UNKNOWN."""
    out = F.when(code.isin(codes), code)
    for c in codes:
        out = out.when(code.startswith(c), F.lit(c))
    return out.otherwise("UNKNOWN")


def topic_name(c: Column) -> Column:
    """A name from markdown: no bold marks, the first line, no remark in *( )*."""
    line = F.split(F.btrim(F.replace(c, F.lit("**"), F.lit(""))), "\n")[0]
    return F.btrim(F.regexp_replace(line, r"\*\([^)]*\)\*", ""))


def full_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def quality_flags(c: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(c.rlike(r"(?i)</?jats:"), F.lit("jats_tag")),
            F.when(c.rlike(r"<[^>]+>"), F.lit("xml_tag")),
            F.when(word_count(c) < 20, F.lit("short")),
            F.when(F.regexp_count(c, F.lit(r"[^\x00-\x7F]")) > 5, F.lit("non_ascii")),
        )
    )


def valid_codes(sub: Column, div: Column) -> Column:
    return F.coalesce(sub.rlike("^[A-Z]{1,3}$") & div.startswith(sub), F.lit(False))


def row_fingerprint(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *cols), 256)
