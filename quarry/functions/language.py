"""Language of a text from the frequent words of each language: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that hold a language together.
FREQUENT_WORDS = {
    "de": "der die und das von zu mit sich auf für ist im dem nicht ein eine als auch werden bei".split(),
    "en": "the of and to in is that for was with as by this are at from which be an on".split(),
    "es": "el los que y las una con por del se para es al como más su lo sus entre está".split(),
    "fr": "le les des et en du une que est pour qui dans par au sur pas plus avec ce sont".split(),
    "it": "il di che è della nel con dei per una gli sono alla del anche le più si dalla nella".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan door deze werd ook bij".split(),
    "pt": "o que do da em para com não uma os no na por mais dos como mas foi ao das".split(),
}


def detect_language(text: Column, words: dict[str, list[str]] = FREQUENT_WORDS, unknown: str = "unknown") -> Column:
    """The language most of whose frequent words a text has, repeats included (ties: the first by name); `unknown` for
    texts without any."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    langs = sorted(words)

    def share(parts: Column, lang: str) -> Column:
        return F.size(F.filter(parts, lambda w: w.isin(words[lang])))

    def pick(parts: Column) -> Column:
        scores = F.array(*(share(parts, x) for x in langs))
        best = lambda s: F.when(F.array_max(s) > 0, F.get(F.array(*map(F.lit, langs)), (F.array_position(s, F.array_max(s)) - 1).cast("int")))
        return F.coalesce(F.transform(F.array(scores), best)[0], F.lit(unknown))

    return F.transform(F.array(found), pick)[0]
