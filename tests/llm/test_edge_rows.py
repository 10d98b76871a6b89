"""Null ids, repeated rows and very long texts through operators whose other tests lack them."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from quarry.llm.bpe_codec import encode_digest
from quarry.llm.lm_scoring import lm_scores
from quarry.llm.quality_classifier import Machine, quality_scores, train
from quarry.llm.quality_rules import quality_rules
from quarry.llm.simhash_dedup import near_duplicates
from quarry.llm.token_counts import token_counts
from quarry.llm.url_filters import url_filter

LONG = " ".join(f"wörd{i % 977} the" for i in range(60_000))
ROWS = [(None, "a text without an id"), (None, None), (1, "twice"), (1, "twice"), (2, LONG)]


def documents(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_tokens_and_codec(spark):
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(documents(spark), public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert got == Counter((i, len((t or "").encode()), len(piece.encode(t or ""))) for i, t in ROWS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    ids = [lib.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digest(documents(spark), path).collect())
    assert got == Counter((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for (i, _), x in zip(ROWS, ids, strict=True))


def test_every_row_gets_one(spark):
    df, ids = documents(spark), Counter(i for i, _ in ROWS)
    for found in (quality_rules(df), near_duplicates(df), quality_scores(df, Machine()), lm_scores(df, F.lit(True))):
        rows = found.collect()
        assert Counter(r.doc_id for r in rows) == ids
        assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    words = {r.doc_id: r.n_tokens for r in lm_scores(df, F.lit(True)).collect() if r.doc_id == 2}
    assert words == {2: 120_001}


def test_repeated_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (4, "http://a.net/de/1"), (4, "http://a.net/de/1"), (5, None)], "page_id long, url string")
    rows = url_filter(pages).collect()
    assert Counter(r.page_id for r in rows) == Counter([None, 4, 4, 5]) and len({tuple(r) for r in rows if r.page_id == 4}) == 1


def test_stated_lengths_that_are_no_numbers(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    odd, none = df.withColumn("n_chars", F.lit("abc")), df.withColumn("n_chars", F.lit(None).cast("long"))
    of = lambda x: Counter((r.doc_id, r.score) for r in quality_scores(x, train(x, labels)).collect())
    assert of(odd) == of(none)
