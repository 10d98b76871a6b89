"""Operator 9. Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of order three, smoothed by Dirichlet priors:
p(w|h) = (c(hw) + MU p(w|h')) / (c(h) + MU), where h' is h without its first word, down to the add-one
distribution over words (with mass for unknown ones). As an automaton:

- states are the histories of the training texts: pairs of tokens, single tokens, and the root without history;
- an arc leads from a history over a token that followed it, with the smoothed log-probability, to the longest
  history that ends there; the root has an arc for every token;
- each history but the root has a failure arc to the history without its first token, with log10 of
  MU / (c(h) + MU), so that the probabilities of a state sum to one.

A text is walked from left to right once. The walk carries its state: at each token it follows failure arcs,
adding their weights, until the state has an arc for the token, adds its weight and goes to its target. All texts of
a split take a step together; long ones are walked in pieces of PIECE tokens, each of which starts with two tokens
ahead, whose weights don't count, and is then in the same state as the whole walk, as no state is longer.

Nothing of the model is collected or broadcast. Texts are dealt into splits; a split asks the buckets of hashed
histories for the counts of the histories and successors that it holds, with its own training counts, and each bucket
answers with the sums over all splits. So a split gets the whole model restricted to its own states and arcs, and the
data moved grows with the corpus, however large its vocabulary. Requests and answers are packed arrays; a
split and a bucket without a common history exchange nothing, so there are never more rows than histories.

Words are known by 64-bit hashes (XXH64 of their bytes), histories of two by 56 bits of a mixture, and the words
behind such a history by 32 bits.

Defined results: a null or empty text is its end token alone; very long texts are scored whole; repeated rows count
and score each, equal texts (ties) have equal scores; a null id is kept; an empty table gives an empty table; if no row
is for training, N and V are 0 and each token has probability 1; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bucket_bounds, dealt_rows, from_planes, pack, parted, planes, releasing, rows_of_split, unpack

#: Weight of the lower order in each state; bytes of text that a split holds, and that a bucket serves, on average.
MU, SPLIT_BYTES, BUCKET_BYTES = 8.0, 5 << 20, 8 << 20
#: Tokens that one walk takes at most; texts that are cut into words at a time.
PIECE, TEXTS = 1024, 500
#: Not words: a text's end (a token), and its start (a history).
END, START = b" ", b"  "
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


class Split:
    """The tokens of some texts, numbered, and their distinct pairs and triples with the places where they occur.

    A pair is a token and the one before it (or the start); a triple is a pair and the next token, or PAD behind
    the end. `pairs` are `before * words + word`, `triples` are `pair's number * (words + 1) + next`."""

    def __init__(self, texts: list[str], training: np.ndarray) -> None:
        # The end and the start come first, so that they are the numbers 0 and 1.
        found, lengths = [pa.array([END, START], pa.binary())], []
        for at in range(0, len(texts), TEXTS):
            flat: list[bytes] = []
            for text in texts[at : at + TEXTS]:
                words = tokens(text)
                flat += words
                lengths.append(len(words))
            found.append(pa.array(flat, pa.binary()))
            del flat
        coded = pa.chunked_array(found).dictionary_encode().combine_chunks()
        del found
        self.end, self.start = 0, 1
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.word = coded.indices.to_numpy()[2:].astype(np.int32)
        self.words = len(coded.dictionary)
        self.hashes = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=self.words)
        del coded
        self.training = np.repeat(training, self.lengths)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = self.start
        self.pairs, self.pair_at = np.unique(before * np.int64(self.words) + self.word, return_inverse=True)
        del before
        self.pair_at = self.pair_at.astype(np.int32)
        after = np.empty_like(self.word)
        after[:-1] = self.word[1:]
        after[self.starts + self.lengths - 1] = self.words  # PAD
        self.triples, triple_at = np.unique(self.pair_at * np.int64(self.words + 1) + after, return_inverse=True)
        self.triple_counts = np.bincount(triple_at[self.training], minlength=len(self.triples))
        #: The pair's number behind each triple's first token; that of the end is of no use.
        last = np.zeros(len(self.triples), dtype=np.int64)
        last[triple_at] = np.arange(len(triple_at))
        self.next_pair = self.pair_at[np.minimum(last + 1, max(len(self.pair_at) - 1, 0))] if len(last) else self.pair_at
        del last, triple_at
        self.triple_pair = (self.triples // (self.words + 1)).astype(np.int32)
        self.triple_word = (self.triples % (self.words + 1)).astype(np.int32)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.training], minlength=self.words)

    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order in which words, pairs and triples are asked for (by hash), and the pairs' hashes in it."""
        with np.errstate(over="ignore"):
            h = (self.hashes[self.pairs // self.words] * MIX) ^ (self.hashes[self.pairs % self.words] << np.uint64(7)) + self.hashes[self.pairs % self.words]
            h ^= h >> np.uint64(29)
            h *= MIX
            h ^= h >> np.uint64(32)
        h &= ~np.uint64(0xFF)
        by_hash = np.argsort(h, kind="stable")
        rank = np.empty(len(h), dtype=np.int32)
        rank[by_hash] = np.arange(len(h), dtype=np.int32)
        return np.argsort(self.hashes, kind="stable"), by_hash, np.argsort(rank[self.triple_pair], kind="stable"), h[by_hash]


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of 56-bit hashes in order."""
    return planes(np.diff(ordered >> np.uint64(8), prepend=np.uint64(0)))


def _requests(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        split = _split(_in_order(table))
        by_word, by_pair, by_triple, pair_hashes = split.order()
        word_hashes, word_counts = split.hashes[by_word], split.word_counts()[by_word]
        codes = np.append(split.hashes >> np.uint64(32), np.uint64(0)).astype("<u4")[split.triple_word[by_triple]]
        counts = split.triple_counts[by_triple]
        successors = np.bincount(split.triple_pair, minlength=len(by_pair))[by_pair]
        until = np.concatenate(([0], np.cumsum(successors)))
        cut_w, cut_p = bucket_bounds(word_hashes, buckets), bucket_bounds(pair_hashes, buckets)
        full = np.nonzero(np.diff(cut_w) + np.diff(cut_p))[0].tolist()
        data = []
        for k in full:
            w, p = slice(cut_w[k], cut_w[k + 1]), slice(cut_p[k], cut_p[k + 1])
            t = slice(until[p.start], until[p.stop])
            data.append(pack(word_hashes[w], planes(word_counts[w]), steps(pair_hashes[p]), planes(successors[p]), codes[t], planes(counts[t])))
        return pa.table({"bucket": pa.array(full, pa.int32()), "split": pa.array([key[0].as_py()] * len(full), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _split(table: pa.Table) -> Split:
    return Split(table.column("text").to_pylist(), table.column("training").to_numpy(zero_copy_only=False).astype(bool))


def _in_order(table: pa.Table) -> pa.Table:
    """A split's rows in an order that doesn't depend on how they came."""
    return rows_of_split(table).sort_by([("doc_id", "ascending"), ("text", "ascending"), ("training", "ascending")])


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums by key over all parts, for each part in its order, and once."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return [total[x] for x in np.split(at, np.cumsum([len(k) for k in keys])[:-1])], total


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over all splits of a bucket, for each split in the order of its request."""
    words, word_counts, pairs, successors, codes, counts = [], [], [], [], [], []
    for x in table.column("data"):
        w, n, p, s, c, m = unpack(x.as_py(), "<u8", "u1", "u1", "u1", "<u4", "u1")
        words.append(w)
        word_counts.append(from_planes(n).astype(np.float64))
        pairs.append(np.cumsum(from_planes(p), dtype=np.uint64))
        successors.append(from_planes(s).astype(np.int64))
        codes.append(c)
        counts.append(from_planes(m).astype(np.float64))
    of_word, total = _totals(words, word_counts)
    del words, word_counts
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    sizes = [len(p) for p in pairs]
    del pairs
    # A triple's key: its pair's number in the bucket and its code.
    owner = np.repeat(at, np.concatenate(successors))
    of_pair = np.bincount(owner, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)[at]
    of_pair = np.split(of_pair, np.cumsum(sizes)[:-1])
    keys = (owner.astype(np.uint64) << np.uint64(32)) | np.concatenate(codes)
    del owner, distinct, at
    of_triple, _ = _totals(np.split(keys, np.cumsum([len(c) for c in codes])[:-1]), counts)
    figures = np.array([total.sum(), (total > 0).sum()], dtype="<i8")
    data = [pack(figures, planes(a), planes(b), planes(c)) for a, b, c in zip(of_word, of_pair, of_triple)]
    n = len(data)
    return pa.table({"split": table.column("split"), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "data": pa.array(data, pa.binary())})


class Automaton:
    """States, arcs and failure arcs that a split's texts can reach. States: 0 is the root, then the words, then
    the pairs. Arcs lie in order of (state, word), by level of the state."""

    def __init__(self, split: Split, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, mu: float = MU) -> None:
        self.words = split.words
        first, last = split.pairs // split.words, (split.pairs % split.words).astype(np.int32)
        history = words.astype(np.float64)
        history[split.start] = words[split.end]  # as many starts as ends
        root = (words + 1) / (n + v + 1)
        pair = (pairs + mu * root[last]) / (history[first] + mu)
        inner = (triples > 0) & (split.triple_word < split.words)  # the others are no arcs
        triple_pair, triple_word, next_pair = split.triple_pair[inner], split.triple_word[inner], split.next_pair[inner]
        triples = triples[inner]
        triple = (triples + mu * pair[next_pair]) / (pairs[triple_pair] + mu)
        self.first_pair = 1 + split.words
        # Failure arcs, by state: weight and target.
        self.failure = np.concatenate(([0.0], np.log10(mu / (history + mu)), np.log10(mu / (pairs + mu))))
        self.shorter = np.concatenate((np.zeros(1 + split.words, np.int32), 1 + last))
        # Targets: the longest history that ends with the arc.
        to_word = np.where(words > 0, 1 + np.arange(split.words), 0).astype(np.int32)
        to_word[split.end] = 0
        self.root_weight, self.root_target = np.log10(root), to_word
        seen = pairs > 0
        self.pair_key, self.pair_weight = split.pairs[seen], np.log10(pair[seen])
        self.pair_target = (self.first_pair + np.nonzero(seen)[0]).astype(np.int32)
        self.triple_key = triple_pair * np.int64(split.words) + triple_word
        self.triple_weight, self.triple_target = np.log10(triple), (self.first_pair + next_pair).astype(np.int32)
        #: Where each pair's arcs begin.
        self.triple_first = np.concatenate(([0], np.cumsum(np.bincount(triple_pair, minlength=len(pairs))))).astype(np.int32)
        self.triple_word = triple_word
        self.start = 1 + split.start if history[split.start] > 0 else 0

    @staticmethod
    def _arc(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked arcs there are, and where."""
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return keys[at] == asked, at

    def _triple_arc(self, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs' arcs: mostly a pair has one, which is looked at first."""
        if not len(self.triple_key):
            return np.zeros(len(pair), bool), np.zeros(len(pair), np.int64)
        at, n = self.triple_first[pair], self.triple_first[pair + 1] - self.triple_first[pair]
        at = np.minimum(at, len(self.triple_key) - 1).astype(np.int64)
        found = (n > 0) & (self.triple_word[at] == word)
        more = np.nonzero(~found & (n > 1))[0]
        if len(more):
            found[more], at[more] = self._arc(self.triple_key, pair[more] * np.int64(self.words) + word[more])
        return found, at

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token of each walk: the weights on its way, and the states reached."""
        weight, target = np.zeros(len(state)), np.zeros(len(state), dtype=np.int32)
        left = np.nonzero(state >= self.first_pair)[0]
        state = state.copy()
        if len(left):
            found, at = self._triple_arc(state[left] - self.first_pair, word[left])
            hit, miss = left[found], left[~found]
            weight[hit], target[hit] = self.triple_weight[at[found]], self.triple_target[at[found]]
            weight[miss] += self.failure[state[miss]]
            state[miss] = self.shorter[state[miss]]
            state[hit] = -1
        left = np.nonzero(state > 0)[0]
        if len(left):
            found, at = self._arc(self.pair_key, (state[left] - 1) * np.int64(self.words) + word[left])
            hit, miss = left[found], left[~found]
            weight[hit] += self.pair_weight[at[found]]
            target[hit] = self.pair_target[at[found]]
            weight[miss] += self.failure[state[miss]]
            state[miss] = 0
        left = np.nonzero(state == 0)[0]
        weight[left] += self.root_weight[word[left]]
        target[left] = self.root_target[word[left]]
        return weight, target

    def walk(self, split: Split, piece: int = PIECE) -> np.ndarray:
        """The weight of each text."""
        pieces = -(-split.lengths // piece)
        text = np.repeat(np.arange(len(pieces)), pieces)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        size = np.minimum(split.lengths[text] - offset, piece)
        ahead = np.minimum(offset, 2)
        order = np.argsort(-(size + ahead), kind="stable")
        text, offset, size, ahead = text[order], offset[order], size[order], ahead[order]
        at = split.starts[text] + offset - ahead
        total, long = np.zeros(len(text)), size + ahead
        state = np.where(offset == 0, self.start, 0).astype(np.int32)
        active = len(text)
        for k in range(int(long[0]) if len(long) else 0):
            active = int(np.searchsorted(-long, -k, side="left")) if long[active - 1] <= k else active
            weight, reached = self.step(state[:active], split.word[at[:active] + k])
            total[:active] += np.where(ahead[:active] <= k, weight, 0.0)
            state[:active] = reached
        return np.bincount(text, weights=total, minlength=len(split.lengths))


def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    left = _in_order(left)
    split = _split(left)
    left = left.select(["doc_id", "training"])
    by_word, by_pair, by_triple, _ = split.order()
    answers, n, v = ([], [], []), 0, 0
    for x in right.sort_by("bucket").column("data"):
        figures, *counts = unpack(x.as_py(), "<i8", "u1", "u1", "u1")
        for out, c in zip(answers, counts, strict=True):
            c = from_planes(c)
            out.append(c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c)
        n, v = n + int(figures[0]), v + int(figures[1])
    del right
    counts = []
    for order, found in zip((by_word, by_pair, by_triple), answers, strict=True):
        every = np.empty(len(order), dtype=np.int64)
        every[order] = np.concatenate(found) if found else every
        counts.append(every)
        found.clear()
    del answers, by_word, by_pair, by_triple
    words, pairs, triples = counts
    automaton = Automaton(split, words, pairs, triples, n, v)
    add = lambda x: np.add.reduceat(x, split.starts)
    return pa.table(
        {
            "doc_id": left.column("doc_id"),
            "training": left.column("training"),
            "n_tokens": pa.array(split.lengths, pa.int64()),
            "n_known": pa.array(add((words > 0)[split.word].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([n] * len(split.lengths), pa.int64()),
            "base_score": pa.array(add(automaton.root_weight[split.word]), pa.float64()),
            "score": pa.array(automaton.walk(split), pa.float64()),
        }
    )


SCORES = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score for each row; the model is learned
    from the rows for which `training` holds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    size = source.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits, buckets = max(fewest, -(-size // SPLIT_BYTES)), max(fewest, -(-size // BUCKET_BYTES))
    dealt = parted(dealt_rows(source, splits), "split", splits, fewest)
    ask, answer, score = releasing(_requests(buckets)), releasing(_answers), releasing(_scores)
    requests = dealt.groupBy("split").applyInArrow(lambda key, table: ask(key, table), "bucket int, split int, data binary")
    answers = parted(requests, "bucket", buckets, fewest).groupBy("bucket").applyInArrow(lambda key, table: answer(key, table), "split int, bucket int, data binary")
    return dealt.groupBy("split").cogroup(parted(answers, "split", splits, fewest).groupBy("split")).applyInArrow(lambda left, right: score(left, right), SCORES)
