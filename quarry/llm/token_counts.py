"""Operator 1. Token counts by heap-and-linked-list byte-pair merging.

The symbols of a chunk form a linked list; a heap holds the adjacent pairs that are pieces, lowest rank first
and leftmost among equals. Each pop that is still valid joins two symbols. A chunk's count is the number of
its first symbols, less the merges, plus the extra bytes of symbols that the vocabulary lacks (byte fallback).
No identifiers are made.

Defined results: a null or empty text has 0 bytes and 0 tokens; very long texts are counted whole, in n log n steps;
ties take the leftmost pair; repeated rows each give a row; a null id is kept; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Words kept with their counts in a worker (two generations of this size), and the longest that is kept.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 48
SPACE = "▁"
#: Bits of a symbol's number in a pair's key.
BITS = 20
_counters: dict[str, PieceCounter] = {}


class PieceCounter(dict):
    """Token counts of words by demand; the key is the word without its leading space mark."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        # Words can be counted apart only if no piece holds a space mark after another character.
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("pieces of this model cross the start of a word")
        rank_of = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        names = dict.fromkeys([*score, *sorted({c for p in score for c in p})])
        number = {p: k for k, p in enumerate(names, 1)}  # 0: a character in no piece
        self.letters = {p: k for p, k in number.items() if len(p) == 1}
        self.lacking = {0} | {k for p, k in number.items() if p not in score}
        self.pairs = {
            number[p[:k]] << BITS | number[p[k:]]: rank_of[s] << BITS | number[p]
            for p, s in score.items()
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        }
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self.old: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Tokens of a chunk: its symbols, less the merges, plus further bytes of symbols without a piece."""
        letters, pairs = self.letters.get, self.pairs.get
        symbol = [letters(c, 0) for c in chunk]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # what the pair that starts here has in `pairs`
        heap = []
        for i in range(n - 1):
            if (v := pairs(symbol[i] << BITS | symbol[i + 1])) is not None:
                pair[i] = v
                heap.append((v >> BITS) << 32 | i)
        heapq.heapify(heap)
        lacking = not self.lacking.isdisjoint(symbol)
        merges, mask = 0, (1 << BITS) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            v = pair[i]
            if v < 0 or v >> BITS != top >> 32:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i] = s = v & mask
            j = after[i]
            pair[j], symbol[j] = -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (v := pairs(s << BITS | symbol[k])) is not None:
                    heapq.heappush(heap, (v >> BITS) << 32 | i)
                    pair[i] = v
                else:
                    pair[i] = -1
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                if (v := pairs(symbol[h] << BITS | s)) is not None:
                    heapq.heappush(heap, (v >> BITS) << 32 | h)
                    pair[h] = v
                else:
                    pair[h] = -1
        extra = sum(len(c.encode()) - 1 for c, s in zip(chunk, symbol, strict=True) if s in self.lacking) if lacking else 0
        return n - merges + extra

    def __missing__(self, word: str) -> int:
        count = self.old.get(word)
        if count is None:
            count = self.merged(SPACE + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " ":
            return sum(self[x[1:]] if x[1:2] != SPACE else self.merged(x) for x in self.runs(SPACE + text.replace(" ", SPACE)))
        return sum(map(self.__getitem__, text.split(" ")))


def counter(model_path: str) -> PieceCounter:
    """The worker's counter for a model: kept from task to task, since Spark keeps its Python workers."""
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(model_path)
    return _counters[model_path]


def token_counts(
    df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `df`; map tasks only. The model is read in each
    worker from `model_path`, a file that is installed on every machine with its library."""

    def make():
        pieces = counter(model_path)

        def run(texts: list[str]) -> list[list]:
            tokens = [pieces.count(t) for t in texts]
            return [[len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return run

    return map_texts(df, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)
