"""Text functions over documents and pages (P), filters (F), stage reports (G1-G4, G7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.language import FREQUENT_WORDS, detect_language
from ..sources.io import table
from .base import PAPERS_SQL, papers
from .registry import query

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


# The SQL states fixed values by hand, not by the library's constants, so that a wrong one shows.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_PREFIXES = "article 論文 type: identifier: application/ text/ pdf html doi report".split()
_CITED = "^.*(pp?\\.?\\s*[0-9一二三四五六七八九十]+[-‐~〜][0-9一二三四五六七八九十]+).*;?\\s*(\\d{4})$"
_CJK = "[\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff\u3400-\u4dbf]"
_SHOT = r"\blhd\s*(bolometer|flxloop|fpellet|interferometer|cxrs|ece|diagnostic|probe)\b|^lhd\b|\blhd\s*#?\d+"
_CODES = "ja=ja zh=zh zh-cn=zh zh-tw=zh zh-hk=zh ko=ko fr=fr de=de es=es ru=ru it=it pt=pt nl=nl ar=ar hi=hi en=en"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _unescape(x: str) -> str:
    for entity, char in _ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _clean(x: str) -> str:
    x = _unescape(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = rf"""regexp_replace({x}, '\\"([a-zA-Z])', '\1', 'g')"""
    x = rf"""regexp_replace({x}, '\\''', '', 'g')"""
    x = rf"""regexp_replace({x}, '\$(.*?)\$', '\1', 'g')"""
    x = r"regexp_replace(" + x + r", '\\[a-zA-Z]+\{(.*?)\}', '\1', 'g')"
    x = rf"regexp_replace({x}, '\\[a-zA-Z]+', '', 'g')"
    x = f"""replace(replace({x}, '``', '"'), '''''', '"')"""
    return f"coalesce({_collapse(x)}, '')"


@query("p1_decode", f"SELECT page_id, nullif({_collapse(chr(39).join(['regexp_replace(' + _unescape('html') + ', ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}, '') AS abstract FROM pages")
def p1_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.decode_abstract(F.col("html"), T.basic_unescape).alias("abstract"))


@query("p2_clean", f"SELECT page_id, {_clean('html')} AS clean FROM pages")
def p2_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html"), T.basic_unescape).alias("clean"))


#: All references that the pages hold, by hand; a single pass, so that an escaped ampersand makes no new reference.
_ALL = r"""regexp_replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""


@query("p1_decode_all", "SELECT page_id, nullif(" + _collapse("regexp_replace(" + _ALL.format(x="html") + ", '<[^>]+>', ' ', 'g')") + ", '') AS abstract FROM pages")
def p1_decode_all(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.decode_abstract(F.col("html")).alias("abstract"))


@query("p2_clean_all", "SELECT page_id, " + _clean("html").replace(_unescape("regexp_replace(html, '<[^>]+>', ' ', 'g')"), _ALL.format(x="regexp_replace(html, '<[^>]+>', ' ', 'g')")) + " AS clean FROM pages")
def p2_clean_all(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))


_LANGUAGE_WORDS = ", ".join(f"('{lang}', [" + ", ".join(f"'{w}'" for w in words) + "])" for lang, words in sorted(FREQUENT_WORDS.items()))


_CHARS = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g'))"


@query("p7_profile_languages", f"""WITH t AS (SELECT doc_id, lang, doc_id % 4 <> 2 AS training, {_CHARS} AS b FROM documents),
c AS (SELECT *, string_split(' ' || b || ' ', '') AS c FROM t WHERE b <> ''),
g AS (SELECT doc_id, lang, training, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM c),
n AS (SELECT lang, gram, count(*) AS c FROM g WHERE training AND lang IS NOT NULL GROUP BY 1, 2), l AS (SELECT lang, sum(c) AS total FROM n GROUP BY 1),
k AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS r FROM n) WHERE r <= 2000), v AS (SELECT count(*) AS v FROM k),
w AS (SELECT l.lang, k.gram, round(1000 * ln((coalesce(n.c, 0) + 1) / (total + v)))::BIGINT AS w FROM k CROSS JOIN l CROSS JOIN v LEFT JOIN n ON n.lang = l.lang AND n.gram = k.gram),
s AS (SELECT doc_id, w.lang, sum(w) AS s, count(*) AS n FROM g JOIN w ON w.gram = g.gram GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER o AS r, lead(s) OVER o AS next FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY s DESC, lang))
SELECT t.doc_id, coalesce(r.lang, 'unknown') AS lang, round((s - next) / r.n, 3) AS margin FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.r = 1""")
def p7_profile_languages(spark, sf_dir):
    """Profiles learned from three folds of the documents, and the language of all."""
    from ..operators.languages import detect, learn

    d = table(spark, sf_dir, "documents")
    return detect(d, ["doc_id"], "text", learn(d.where("doc_id % 4 <> 2"), "text", "lang"))


@query(
    "p7_detect_language",
    rf"""WITH w AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+') AS w FROM documents),
l AS (SELECT * FROM (VALUES {_LANGUAGE_WORDS}) AS t(lang, words)),
s AS (SELECT doc_id, lang, len(list_filter(w, lambda x: list_contains(words, x))) AS n FROM w, l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS k FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN lang ELSE 'unknown' END AS abstract_lang FROM r WHERE k = 1""",
)
def p7_detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect_language(F.col("text")).alias("abstract_lang"))


@query("p3_cjk_ratio", f"SELECT doc_id, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '{_CJK}'))::DOUBLE / length(text) ELSE 0.0 END AS ratio FROM documents")
def p3_cjk_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cjk_ratio(F.col("text")).alias("ratio"))


_T = f"lower(regexp_replace(text, '^{_WS}|{_WS}$', '', 'g'))"
_INFORMATIVE = (
    f"(length({_T}) >= 100 AND NOT (" + " OR ".join(f"starts_with({_T}, '{p}')" for p in _PREFIXES)
    + rf") AND NOT regexp_matches({_T}, '{_CITED}') AND (" + " OR ".join(f"contains({_T}, '{m}')" for m in (".", "。", "、", ",")) + "))"
)


@query("p4_informative", f"SELECT doc_id, {_INFORMATIVE} AS informative FROM documents")
def p4_informative(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_informative(F.col("text")).alias("informative"))


@query("p5_boilerplate", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)^(type|application|departmental|bulletin|text|論文|記事|表紙|裏表紙|奥付|目次)\\b')")
def p5_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~T.is_boilerplate(F.col("text"))).select("doc_id")


_TYPE = rf"CASE WHEN regexp_matches(lower(trim(p_name)), '{_SHOT}') THEN 'diagnostic_report' ELSE 'scientific_paper' END"


@query("p6_document_type", f"SELECT {_TYPE} AS kind, count(*) AS n FROM part GROUP BY 1")
def p6_document_type(spark, sf_dir):
    kind = T.document_type(F.col("p_name")).alias("kind")
    return table(spark, sf_dir, "part").groupBy(kind).agg(F.count("*").alias("n"))


@query("p8_languages", "SELECT lang, CASE lang " + " ".join("WHEN '{}' THEN '{}'".format(*x.split("=")) for x in _CODES.split()) + " END AS code, count(*) AS n FROM documents GROUP BY 1, 2")
def p8_languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", T.normal_language(F.col("lang")).alias("code")).agg(F.count("*").alias("n"))


@query("p9_join_key")
def p9_join_key(spark, sf_dir):
    """NFKC has no SQL form; a test compares it with the standard library."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.join_key(F.col("s_name")).alias("key"))


@query(
    "p10_to_p14_scalars",
    rf"""SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare, regexp_full_match(url, '[A-Za-z0-9\s\-\.,;:''"()/&+]+') AS latin,
  CASE WHEN {_collapse('html')} = '' THEN 0 ELSE len(string_split({_collapse('html')}, ' ')) END::INT AS words,
  TRY_CAST(nullif(regexp_extract(html, '\b(19[5-9]\d|20[012]\d)\b'), '') AS INT) AS year,
  TRY_CAST(nullif(regexp_extract(html, '(1[5-9]\d{{2}}|20\d{{2}})'), '') AS INT) AS loose_year FROM pages""",
)
def p10_to_p14_scalars(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        T.strip_tags(html).alias("bare"),
        T.is_latin(F.col("url")).alias("latin"),
        T.word_count(html).alias("words"),
        T.year_strict(html).alias("year"),
        T.year_loose(html).alias("loose_year"),
    )


@query("p15_authors", "SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS authors FROM orders GROUP BY 1")
def p15_authors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    people = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("p"))
    return people.select("o_custkey", T.join_authors(F.col("p.o_orderpriority")).alias("authors"))


_TIER = "CASE WHEN sim IS NULL THEN 'unknown' WHEN sim < 0.40 THEN 'reject' WHEN sim < 0.57 THEN 'low' WHEN sim < 0.67 THEN 'medium' ELSE 'trust' END"


@query("p16_trust_tiers", f"SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {_TIER} AS tier FROM {PAPERS_SQL}) GROUP BY tier")
def p16_trust_tiers(spark, sf_dir):
    from ..operators.stats import shares

    p = papers(spark, sf_dir).select(T.trust_tier(F.col("sim")).alias("tier"))
    return shares(p, ["tier"]).withColumn("share", F.round("share", 6))


@query("p17_truncate", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(text[1:120], '(?s) [^ ]*$', '') || '…' END AS snippet FROM documents")
def p17_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 120).alias("snippet"))


@query("p19_main_class", "SELECT p_partkey, p_brand[1:1] AS first, nullif(regexp_extract(p_brand, '^[A-Z]+'), '') AS letters FROM part")
def p19_main_class(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.leading_letter(b).alias("first"), T.leading_letters(b).alias("letters"))


@query(
    "p20_llm_reply",
    """SELECT event_id, code, conf, CASE WHEN code IN ('CLICK', 'VIEW') THEN code WHEN starts_with(code, 'CL') THEN 'CL' ELSE 'UNKNOWN' END AS known
FROM (SELECT event_id, upper(event_type) AS code, (event_id % 5)::INT AS conf FROM events)""",
)
def p20_llm_reply(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lit('<think>{"lcc": "no"}\n</think> Sure: {"lcc": " '), F.lower("event_type"), F.lit('", "confidence": '), (F.col("event_id") % 5).cast("string"), F.lit(', "reason": "x"} done'))
    r = e.select("event_id", T.llm_reply(said).alias("r")).select("event_id", "r.code", F.col("r.confidence").alias("conf"))
    known = F.when(F.col("code").isin("CLICK", "VIEW"), F.col("code")).otherwise(T.known_code(F.col("code"), ["CLICK", "VIEW", "CL"]))
    return r.select("event_id", "code", "conf", known.alias("known"))


@query("p21_topic_name", "SELECT n_nationkey, n_name || ' topic' AS name FROM nation")
def p21_topic_name(spark, sf_dir):
    said = F.concat(F.lit("**"), F.col("n_name"), F.lit(" topic** *(one of many)*\nwhy: none"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.topic_name(said).alias("name"))


@query("p25_ordered_fingerprint", """SELECT count(*) AS n, coalesce(sum(('0x' || substr(md5(pos || ':' || t), 1, 15))::BIGINT), 0)::VARCHAR AS print
FROM (SELECT coalesce(text, '') AS t, row_number() OVER (ORDER BY source, doc_id, coalesce(text, '')) - 1 AS pos FROM documents)""")
def p25_ordered_fingerprint(spark, sf_dir):
    from ..operators.embed import ordered_fingerprint

    return ordered_fingerprint(table(spark, sf_dir, "documents"), "text", "source", "doc_id")


@query("p22_p25_full_text", "SELECT doc_id, sha256(coalesce(source, '') || '. ' || coalesce(text, '')) AS print FROM documents")
def p22_p25_full_text(spark, sf_dir):
    full = T.full_text(F.col("source"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.row_fingerprint(full).alias("print"))


@query(
    "p23_quality_flags",
    f"""SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(html, '(?i)</?jats:') THEN 'jats_tag' END,
  CASE WHEN regexp_matches(html, '<[^>]+>') THEN 'xml_tag' END, CASE WHEN len(string_split({_collapse('html')}, ' ')) < 20 THEN 'short' END,
  CASE WHEN len(regexp_extract_all(html, '[^\\x00-\\x7F]')) > 5 THEN 'non_ascii' END], lambda x: x IS NOT NULL)) AS flag FROM pages) GROUP BY flag""",
)
def p23_quality_flags(spark, sf_dir):
    flags = table(spark, sf_dir, "pages").select(F.explode(T.quality_flags(F.col("html"))).alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("n"))


@query("p24_code_check", f"SELECT DISTINCT sub, div, regexp_full_match(main, '[A-Z]{{1,3}}') AND starts_with(div, main) AS ok FROM {PAPERS_SQL}")
def p24_code_check(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("sub", "div", T.valid_codes(F.col("main"), F.col("div")).alias("ok")).distinct()


_CLEAN_STEP = f"SELECT *, {_INFORMATIVE} AS ok FROM documents WHERE text IS NOT NULL AND trim(text) <> ''"


@query("f1_f4_clean_cascade", f"SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({_CLEAN_STEP}) WHERE ok AND lang = 'en' AND len(regexp_extract_all(text, '{_CJK}'))::DOUBLE / length(text) < 0.05 GROUP BY lang")
def f1_f4_clean_cascade(spark, sf_dir):
    from ..operators.clean import clean_cascade

    d = table(spark, sf_dir, "documents")
    kept, _ = clean_cascade(d.select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), "lang"))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("abstract")).alias("chars"))


@query("f3_u2_other_languages", f"SELECT lang, count(*) AS n FROM ({_CLEAN_STEP}) WHERE ok AND NOT (lang = 'en' AND len(regexp_extract_all(text, '{_CJK}'))::DOUBLE / length(text) < 0.05) GROUP BY lang")
def f3_u2_other_languages(spark, sf_dir):
    from ..operators.clean import clean_cascade

    d = table(spark, sf_dir, "documents")
    _, other = clean_cascade(d.select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), "lang"))
    return other.groupBy("lang").agg(F.count("*").alias("n"))


@query("f5_f7_membership", "SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f5_f7_membership(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").where("lang is not null"), table(spark, sf_dir, "labels")
    kept = d.join(labels.where("quality = 1"), "doc_id", "left_semi").join(labels.where("toxic = 1"), "doc_id", "left_anti")
    return kept.agg(F.count("*").alias("n"))


@query("f6_f8_f9_thresholds", f"SELECT journal, count(*) AS n, count(*) FILTER (WHERE sim < 0.3) AS low, count(*) FILTER (WHERE sim < 0.5) AS weak, count(*) FILTER (WHERE conf >= 0.8) AS sure FROM {PAPERS_SQL} WHERE div <> 'D0' GROUP BY journal HAVING count(*) >= 5")
def f6_f8_f9_thresholds(spark, sf_dir):
    p = papers(spark, sf_dir).where("div <> 'D0'")
    count_if = lambda c, n: F.count(F.when(c, 1)).alias(n)
    out = p.groupBy("journal").agg(F.count("*").alias("n"), count_if(F.col("sim") < 0.3, "low"), count_if(F.col("sim") < 0.5, "weak"), count_if(F.col("conf") >= 0.8, "sure"))
    return out.where("n >= 5")


@query("f10_mapping_fallback", "SELECT n_nationkey, upper(trim(CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'x' || n_regionkey END)) AS code FROM nation WHERE n_nationkey % 5 <> 0")
def f10_mapping_fallback(spark, sf_dir):
    from ..operators.taxonomy import resolve_mapping

    n = table(spark, sf_dir, "nation")
    m = n.select(
        "n_nationkey",
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("x"), "n_regionkey")).alias("code"),
        F.col("n_name").alias("suggested"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit(" Yes")).otherwise(F.lit("")).alias("skip"),
    )
    return resolve_mapping(m, "code", "suggested", "skip").select("n_nationkey", "code")


@query("g1_g2_stage_report", "SELECT count(*) AS n, count(*) FILTER (WHERE trim(text) <> '') AS with_text, count(lang) AS with_lang, count(*) FILTER (WHERE contains(text, '<jats')) AS leaks, count(DISTINCT lang) AS langs FROM documents")
def g1_g2_stage_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.trim("text") != "", 1)).alias("with_text"),
        F.count("lang").alias("with_lang"),
        F.count(F.when(F.col("text").contains("<jats"), 1)).alias("leaks"),
        F.countDistinct("lang").alias("langs"),
    )


@query(
    "g3_embedding_report",
    "SELECT count(*) AS n, min(len(embedding))::INT AS least_dim, max(len(embedding))::INT AS most_dim, round(avg(q), 5) AS mean_norm, round(min(q), 5) AS least_norm FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS q FROM embeddings)",
)
def g3_embedding_report(spark, sf_dir):
    from ..operators.vectors import norm

    e = table(spark, sf_dir, "embeddings").select("embedding", norm(F.col("embedding")).alias("q"))
    return e.agg(
        F.count("*").alias("n"),
        F.min(F.size("embedding")).alias("least_dim"),
        F.max(F.size("embedding")).alias("most_dim"),
        F.round(F.avg("q"), 5).alias("mean_norm"),
        F.round(F.min("q"), 5).alias("least_norm"),
    )


@query(
    "g7_exploration",
    "SELECT count(*) AS n, round(avg(w), 4) AS mean, median(w) AS median, round(stddev_samp(w), 4) AS std, quantile_cont(w, 0.25) AS q25, quantile_cont(w, 0.99) AS q99, count(text) - count(DISTINCT text) AS duplicates FROM (SELECT text, length(text)::DOUBLE AS w FROM documents)",
)
def g7_exploration(spark, sf_dir):
    from ..operators.stats import quantiles

    d = table(spark, sf_dir, "documents").select("text", F.length("text").cast("double").alias("w"))
    median, q25, q99 = (quantiles(d, "w", [0.5, 0.25, 0.99]) or [None] * 3)
    # Equal texts by 96 bits of hashes, so that no text is shuffled.
    prints = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.hash("text")))
    return d.agg(
        F.count("*").alias("n"),
        F.round(F.avg("w"), 4).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.round(F.stddev_samp("w"), 4).alias("std"),
        F.lit(q25).cast("double").alias("q25"),
        F.lit(q99).cast("double").alias("q99"),
        (F.count("text") - F.countDistinct(prints)).alias("duplicates"),
    )


@query("s9_vector_decoder", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def s9_vector_decoder(spark, sf_dir):
    from ..sources.io import vectors_from_text

    e = table(spark, sf_dir, "embeddings")
    as_text = e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.to_json("embedding")).otherwise(F.array_join(F.col("embedding").cast("array<string>"), ",")).alias("t"))
    total = F.aggregate(vectors_from_text(F.col("t")), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return as_text.select("vec_id", F.round(total, 3).alias("total"))


@query("v25_lengths", "SELECT count(*) AS n, round(avg(w), 4) AS mean, " + ", ".join(f"round(avg((w > {k})::INT), 6) AS over_{k}" for k in (256, 512, 768, 1024)) + f" FROM (SELECT CASE WHEN {_collapse('text')} = '' THEN 0 ELSE len(string_split({_collapse('text')}, ' ')) END AS w FROM documents)")
def v25_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.word_count(F.col("text")).alias("w"))
    over = [F.round(F.avg((F.col("w") > k).cast("int")), 6).alias(f"over_{k}") for k in (256, 512, 768, 1024)]
    return d.agg(F.count("*").alias("n"), F.round(F.avg("w"), 4).alias("mean"), *over)


#: Whole texts with characters and marks that the tables lack, more the longer the text is.
_MADE = "(SELECT doc_id, lang, repeat('日本語、', ((doc_id % 30) * (1 + length(text) // 60))::INT) || CASE WHEN doc_id % 5 = 0 THEN '<jats:p>' ELSE '' END || text AS text FROM documents)"


def _made(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tag = F.when(F.col("doc_id") % 5 == 0, "<jats:p>").otherwise("")
    times = (F.col("doc_id") % 30 * (1 + F.floor(F.length("text") / 60))).cast("int")
    return d.select("doc_id", "lang", F.concat(F.repeat(F.lit("日本語、"), times), tag, "text").alias("text"))


@query("p3_p4_f3_japanese", f"SELECT doc_id, round(len(regexp_extract_all(text, '{_CJK}'))::DOUBLE / length(text), 6) AS ratio, {_INFORMATIVE} AS informative, lang = 'en' AND len(regexp_extract_all(text, '{_CJK}'))::DOUBLE / length(text) < 0.05 AS english FROM {_MADE}")
def p3_p4_f3_japanese(spark, sf_dir):
    from ..operators.clean import keep_english

    d = _made(spark, sf_dir)
    english, other = keep_english(d, "lang", "text")
    both = english.withColumn("english", F.lit(True)).unionByName(other.withColumn("english", F.lit(False)))
    return both.select("doc_id", F.round(T.cjk_ratio(F.col("text")), 6).alias("ratio"), T.is_informative(F.col("text")).alias("informative"), "english")


@query("g1_p23_leaks", f"SELECT count(*) AS n, count(*) FILTER (WHERE contains(text, '<jats')) AS leaks, count(*) FILTER (WHERE regexp_matches(text, '<[^>]+>')) AS tags, sum(length({_clean('text')}))::BIGINT AS chars FROM {_MADE}")
def g1_p23_leaks(spark, sf_dir):
    flags = T.quality_flags(F.col("text"))
    d = _made(spark, sf_dir).select("text", F.length(T.clean_text(F.col("text"), T.basic_unescape)).alias("chars"), flags.alias("flags"))
    return d.agg(F.count("*").alias("n"), F.count(F.when(F.array_contains("flags", "jats_tag"), 1)).alias("leaks"), F.count(F.when(F.array_contains("flags", "xml_tag"), 1)).alias("tags"), F.sum("chars").alias("chars"))


@query("u4_without_large_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u4_without_large_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")
