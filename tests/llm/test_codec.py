import hashlib

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.bpe_codec import Codec, Lexicon, Vocabulary, build_lexicon, encode_decode, encode_digest, frequent_words
from quarry.llm.token_counts import PieceCounter, token_counts

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECE)
LIB = tokenizers.Tokenizer.from_file(BYTE)
COUNTER, VOCABULARY = PieceCounter(PIECE), Vocabulary(BYTE)
ODD = [
    "", " ", "  ", "a  b", "\x00a", "a\tb\n\nc", "▁a", "▁▁ ▁", "<s> x </s><unk>", "日本 é 😀x", "a" * 3000, "é" * 100 + "梦", "a ", " a",
    "a   b", "a\n  b", "a  \nb", "a\n \nb", "a \n b", "x \t", "\x1c b", "<|endoftext|> a <|endoftext|>", "don't  'LL", "\x85 \xa0", "҉ Խ ՘",
    "x​y ᠎ z", "\U00011de0 1", "ab" * 2000,
]
TEXT = st.text(st.one_of(st.sampled_from(" \n\ta'bsé▁<|>1,日"), st.characters(exclude_categories=["Cs"])), max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_piece_counts(text):
    assert COUNTER.count(text) == len(SP.encode(text))


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_byte_ids(text):
    codec = Codec(BYTE)
    ids = codec.encode(text)
    assert ids == LIB.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text) == len(SP.encode(text))
    codec = Codec(BYTE)
    assert codec.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == LIB.decode(codec.encode(text), skip_special_tokens=False)


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), min_size=1, max_size=4).map(tuple), max_size=40))
def test_lexicon_has_its_words_and_no_others(words):
    lexicon = Lexicon(build_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    for w in list(words):
        for other in (w[:-1], w + b"x", b"\xff" + w):
            assert lexicon.get(other) == words.get(other)


def test_lexicon_shares_suffixes():
    def size(words):
        return int.from_bytes(build_lexicon(dict.fromkeys(words, (1,)))[:4], "little")

    assert size([b"xation", b"yation", b"zation"]) == size([b"xation"])


def test_operators(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(99, None, None, None), (1, " ", "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PIECE, limit=20).collect())
    expected = sorted((i, len((t or "").encode()), (n := len(SP.encode(t or ""))), n > 20) for i, t, *_ in rows)
    assert got == expected
    assert all(r.decoded == (t or "") for r in encode_decode(df, BYTE).collect() for i, t, *_ in rows if i == r.doc_id)
    digest = {r.doc_id: r for r in encode_digest(df, BYTE).collect()}
    for i, t, *_ in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (digest[i].n_tokens, digest[i].ids_sha256) == (len(ids), sha)
    empty = df.limit(0)
    assert token_counts(empty, PIECE).count() == encode_digest(empty, BYTE).count() == 0


def test_frequent_words(spark):
    df = spark.createDataFrame([("a b b",), ("b c  c",), (None,)], "text string")
    assert frequent_words(df, BYTE, size=2) == [" b", " c"]
