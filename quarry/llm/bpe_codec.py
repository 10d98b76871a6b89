"""Operator 3. BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words (pre-tokens) of the corpus are compiled, with their ids as outputs, into an automaton whose
equal suffixes are shared. Its arcs carry how many words lie behind earlier arcs, so that a walk yields the
word's number, and the number finds the ids. The automaton is one flat file that workers map into memory. A
word that it lacks is merged exactly by the vocabulary's ranks.

Defined results: a null or empty text has no tokens (hashes of the empty string); very long texts are encoded
whole; special strings in a text become their id, as the library does by default; repeated rows each give a row, with
equal results for equal texts (ties); a null id is kept; an empty table gives an empty table; a lexicon of no words gives
the same results; other columns of the input are not looked at.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_texts, text_pieces

#: Words in the lexicon at most, and their longest form: bounds what is broadcast (see `Lexicon`).
LEXICON_WORDS, LEXICON_BYTES = 32_768, 32
#: Words kept with their ids in a worker, the longest that is kept, and distinct words that a counting task holds.
MEMO_ENTRIES, MEMO_CHARS, COUNT_ENTRIES = 400_000, 48, 400_000
#: Bytes of text that are cut and merged together.
CHUNK_BYTES = 4 << 20
NONE = np.int64(1 << 60)
_codecs: dict[str, Codec] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the ranges."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def gathered(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end in order of their words, and how many each word has, from (places of words, ids, how many)."""
    length = np.zeros(size, dtype=np.int64)
    for place, _, n in done:
        length[place] = n
    begin = np.cumsum(length) - length
    out = np.empty(int(length.sum()), dtype=np.int64)
    for place, ids, n in done:
        out[spans(begin[place], n)] = ids
    return out, length


class Vocabulary:
    """Ranks, ids, bytes and word pattern of a byte-level BPE file of the tokenizers library."""

    BITS = 20  # of an id
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        to_bytes = lambda piece: b"".join(byte_of[c] for c in piece)
        ids = {to_bytes(p): i for p, i in spec["model"]["vocab"].items()}
        named = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.pairs = {}
        for rank, (a, b) in enumerate(named):
            a, b = to_bytes(a), to_bytes(b)
            self.pairs.setdefault(ids[a] << self.BITS | ids[b], rank << self.BITS | ids[a + b])
        self.single = [ids[bytes([b])] for b in range(256)]
        self.single_ids = np.array(self.single, dtype=np.int64)
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_values = np.array([self.pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        # The pre-tokenizer's fixed pattern, its white space spelled out as Unicode's White_Space property.
        ws = r"\p{White_Space}"
        self._words = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{ws}\p{{L}}\p{{N}}]+|{ws}+(?!\P{{White_Space}})|{ws}+"
        ).findall
        self._library = None

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text. Code points that this Python's Unicode tables don't know yet are looked
        up in the library itself, whose tables may be of another version than the pattern's."""
        body = text[1:] if text[:1] == " " else text
        if body.isalpha():  # the most frequent forms need no pattern: letters, and letters before a mark
            return [text]
        if body[-1:] in (",", ".") and body[:-1].isalpha():
            return [text[:-1], text[-1]]
        if text.isascii() or all(category(c) != "Cn" for c in text):
            return self._words(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False)
        spans = [span for _, span in self._library.pre_tokenize_str(text)]
        return [text[a:b] for a, b in spans]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word by merging the pair of lowest rank again and again, leftmost first."""
        return tuple(self.merge_many([word])[0].tolist())

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank and id of the merged pairs, as one number; NONE for pairs that don't merge."""
        key = a << self.BITS | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words end to end, and how many each has. Each word takes a merge a round; long ones have a
        way of their own."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places in `words`, ids, how many
        for i in np.nonzero(size > 64)[0].tolist():
            ids = self._merge_long([self.single[b] for b in words[i]])
            done.append((np.array([i]), np.array(ids, dtype=np.int64), np.array([len(ids)])))
        number = np.nonzero((size > 0) & (size <= 64))[0]  # of each word that still merges, its place
        length = size[number]
        raw = b"".join(words if len(number) == len(words) else [words[i] for i in number.tolist()])
        symbol = self.single_ids[np.frombuffer(raw, np.uint8)]
        # Values of the pairs (symbol, next symbol); none behind a word's last symbol.
        value = np.append(self._pair(symbol[:-1], symbol[1:]), NONE)[: len(symbol)]
        value[np.cumsum(length) - 1] = NONE
        mask = (1 << self.BITS) - 1
        while len(number):
            start = np.cumsum(length) - length
            least = np.minimum.reduceat(value, start)
            ready = least == NONE
            if ready.any():
                of = np.repeat(ready, length)
                done.append((number[ready], symbol[of], length[ready]))
                symbol, value, number, length, least = symbol[~of], value[~of], number[~ready], length[~ready], least[~ready]
                if not len(number):
                    break
                start = np.cumsum(length) - length
            # The leftmost pair with its word's least value: hits are in order, so the first of each word.
            owner = np.repeat(np.arange(len(number)), length)
            hit = np.nonzero(value == least[owner])[0]
            whose = owner[hit]
            pair = hit[np.append(True, whose[1:] != whose[:-1])]
            symbol[pair] = least & mask
            gone = np.zeros(len(symbol), bool)
            gone[pair + 1] = True
            last = pair + 1 == start + length - 1  # the merged pair ends its word
            symbol, value = symbol[~gone], value[~gone]
            length = length - 1
            pair = pair - np.arange(len(pair))  # one symbol went from each word before
            start = np.cumsum(length) - length
            after = np.minimum(pair + 1, len(symbol) - 1)
            value[pair] = np.where(last, NONE, self._pair(symbol[pair], symbol[after]))
            inner = pair[pair > start]
            value[inner - 1] = self._pair(symbol[inner - 1], symbol[inner])
        return gathered(done, len(words))

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same for long words in n log n steps: a heap of pairs over a linked list."""
        n, pairs, bits = len(parts), self.pairs.get, self.BITS
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held = [pairs(parts[i] << bits | parts[i + 1], -1) for i in range(n - 1)] + [-1]
        heap = [(v, i) for i, v in enumerate(held) if v >= 0]
        heapq.heapify(heap)
        while heap:
            v, i = heapq.heappop(heap)
            if held[i] != v:
                continue
            j = after[i]
            parts[i], parts[j], held[j] = v & ((1 << bits) - 1), -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0:
                    held[x] = pairs(parts[x] << bits | parts[y], -1) if y < n else -1
                    if held[x] >= 0:
                        heapq.heappush(heap, (held[x], x))
        return tuple(p for p in parts if p >= 0)


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a file, read once by a process."""
    return Vocabulary(path)


#: A space next to other white space: there the text can't be cut at every space.
_MIXED = re.compile(r"[^\S ] ").search
_ALONE = re.compile(r"(?<=\S) (?=\S)").split


def space_cuts(text: str) -> list[str]:
    """Parts of a text, of which each but the first had a space before it. No pre-token crosses these cuts:
    a single space after a character that is no white space always begins one."""
    if "  " in text or _MIXED(text):
        return _ALONE(text)
    return text.split(" ")


def build_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """A flat minimal automaton of `words` (any order): states as runs of arcs, then the ids of each word.

    Incremental construction over sorted words: the states of the last word's tail are replaced by equal ones
    of a register as soon as the next word leaves them."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    tail: list[tuple[int, int, int]] = []  # parent, label, child: not yet registered

    def fold(down_to: int) -> None:
        while len(tail) > down_to:
            parent, label, child = tail.pop()
            key = (final[child], tuple(arcs[child].items()))
            same = register.get(key)
            if same is None:
                register[key] = child
            else:
                arcs[parent][label] = same

    last, order = b"", sorted(words)
    for word in order:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        fold(common)
        state = tail[-1][2] if tail else 0
        for label in word[common:]:
            arcs.append({})
            final.append(False)
            child = len(arcs) - 1
            arcs[state][label] = child
            tail.append((state, label, child))
            state = child
        final[state] = True
        last = word
    fold(0)
    # Number the live states, a child before its parents, and count the words behind each.
    live, seen, stack = [], {0}, [(0, iter(arcs[0].values()))]
    while stack:
        state, rest = stack[-1]
        child = next((c for c in rest if c not in seen), None)
        if child is None:
            live.append(state)
            stack.pop()
        else:
            seen.add(child)
            stack.append((child, iter(arcs[child].values())))
    number = {s: i for i, s in enumerate(live)}
    behind = [0] * len(live)
    first, labels, targets, skips = [], [], [], []
    for i, s in enumerate(live):
        first.append(len(labels))
        total = int(final[s])
        for label, child in arcs[s].items():
            labels.append(label)
            targets.append(number[child])
            skips.append(total)
            total += behind[number[child]]
        behind[i] = total
    first.append(len(labels))
    starts, ids = [0], []
    for word in order:
        ids.extend(words[word])
        starts.append(len(ids))
    finals = [int(final[s]) for s in live]
    head = struct.pack("<6I", len(live), len(labels), len(order), len(ids), number[0], 0)
    ints = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    return head + b"".join(map(ints, (first, finals, targets, skips, starts, ids))) + bytes(labels) + bytes(-len(labels) % 4)


class Lexicon:
    """Read-only view of `build_lexicon`'s bytes, mapped from a file."""

    def __init__(self, data: bytes) -> None:
        fd, name = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            with open(name, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)  # the mapping stays; nothing is left behind
        view = np.frombuffer(self.map, dtype="<u4", count=len(self.map) // 4)
        states, n_arcs, words, n_ids, root, _ = view[:6].tolist()
        at, parts = 6, []
        for size in (states + 1, states, n_arcs, n_arcs, words + 1, n_ids):
            parts.append(view[at : at + size])
            at += size
        self.root, (first, self.final, self.targets, self.skips, self.starts, self.ids) = root, parts
        labels = np.frombuffer(self.map, dtype="u1", count=n_arcs, offset=4 * at)
        #: Arcs by (state, label), in order.
        self.arcs = np.repeat(np.arange(states, dtype=np.uint32), np.diff(first)) << np.uint32(8) | labels

    def get(self, word: bytes) -> tuple[int, ...] | None:
        found, ids, _ = self.get_many([word])
        return tuple(ids.tolist()) if len(found) else None

    def get_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that it has, their outputs end to end, and how many each has. All words take a step
        together."""
        none = np.zeros(0, dtype=np.int64)
        if not words or not len(self.arcs):
            return none, none, none
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state, index = np.full(len(words), self.root, np.uint32), np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        done = [alive[length == 0]]
        alive = alive[length > 0]
        for k in range(int(length.max())):
            key = state[alive] << np.uint32(8) | raw[begin[alive] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[arc] == key
            alive, arc = alive[there], arc[there]
            index[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            ends = length[alive] == k + 1
            done.append(alive[ends])
            alive = alive[~ends]
            if not len(alive):
                break
        found = np.concatenate(done)
        found = found[self.final[state[found]] == 1]
        first = self.starts[index[found]].astype(np.int64)
        n = self.starts[index[found] + 1] - first
        return found, self.ids[spans(first, n)].astype(np.int64), n


class Codec:
    """Encoder and decoder of a worker. A chunk of texts is cut at spaces into parts; the distinct ones are looked up
    among those of the chunks before, the others are cut into words, which are walked through the lexicon all together,
    and what that lacks is merged all together. Of a part (and the space before it) are kept the ids, as decimals with
    commas, and the bytes that these decode to."""

    def __init__(self, path: str, lexicon: bytes | None = None) -> None:
        self.vocabulary = vocabulary_of(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        size = max(self.vocabulary.bytes_of) + 1
        self.decimal = pa.array([str(i) for i in range(size)], pa.string())
        self.pieces = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.piece_array = pa.array(self.pieces, pa.binary())
        self.special = [s for s in self.vocabulary.special if s]
        self.known: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, by the lexicon or else by merging, and how many each has."""
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LEXICON_BYTES] if self.lexicon else []
        found, ids, n = self.lexicon.get_many([words[i] for i in short]) if short else (np.zeros(0, np.int64),) * 3
        place = np.array(short, dtype=np.int64)[found]
        left = np.ones(len(words), bool)
        left[place] = False
        rest = np.nonzero(left)[0]
        more, m = self.vocabulary.merge_many([words[i] for i in rest.tolist()])
        return gathered([(place, ids, n), (rest, more, m)], len(words))

    def shown(self, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[str, bytes]]:
        """(decimals with commas, decoded bytes) of runs of ids."""
        at = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        index = pa.array(ids, pa.int32())
        runs = lambda table: pa.ListArray.from_arrays(at, table.take(index))
        decimals = pa.compute.binary_join(runs(self.decimal), ",").to_pylist()
        return list(zip(decimals, pa.compute.binary_join(runs(self.piece_array), b"").to_pylist(), strict=True))

    def parts(self, parts: list[str], space: str = "") -> list[tuple[str, bytes]]:
        """(decimals, bytes) of parts, each with `space` before it and taken for itself."""
        cut, words, counts = self.vocabulary.words, [], []
        for part in parts:
            if part.isalpha():
                words.append(space + part)
                counts.append(1)
            else:
                found = cut(space + part)
                words += found
                counts.append(len(found))
        ids, lengths = self.ids([w.encode() for w in words])
        upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts, dtype=np.int64))]
        return self.shown(ids, np.diff(upto))

    def both(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """The ids of each text as decimals with commas, and the bytes that they decode to."""
        collects = gc.isenabled()
        gc.disable()  # all that is made here is strings and tuples of strings, which need no collector
        try:
            return self._both(texts)
        finally:
            if collects:
                gc.enable()

    def _both(self, texts: list[str]) -> list[tuple[str, bytes]]:
        out: list[tuple[str, bytes] | None] = [None] * len(texts)
        plain, firsts, flat, counts = [], [], [], []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                ids = self.encode(text)
                out[i] = ",".join(map(str, ids)), self.decode(ids).encode()
                continue
            first, *rest = space_cuts(text)
            plain.append(i)
            firsts.append(first)
            flat += rest
            counts.append(len(rest))
        coded = pa.array(flat, pa.string()).dictionary_encode()
        del flat
        at, distinct = coded.indices.to_numpy().tolist(), coded.dictionary.to_pylist()
        del coded
        known, old = self.known.get, self.old.get
        found = [known(p) or old(p) for p in distinct]
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self.parts([distinct[k] for k in new], " "), strict=True):
            found[k] = x
        self.known.update((p, x) for p, x in zip(distinct, found, strict=True) if len(p) <= MEMO_CHARS)
        if len(self.known) > MEMO_ENTRIES:
            self.old, self.known = self.known, {}
        shown, raw = [x[0] for x in found].__getitem__, [x[1] for x in found].__getitem__
        begin = 0
        for i, first, n in zip(plain, self.parts(firsts), counts, strict=True):
            mine = at[begin : begin + n]
            begin += n
            joined = ",".join(map(shown, mine))
            out[i] = f"{first[0]},{joined}" if first[0] and joined else first[0] or joined, first[1] + b"".join(map(raw, mine))
        return out

    def encode(self, text: str) -> list[int]:
        special = self.vocabulary.special
        out: list[int] = []
        for x in self.vocabulary.split_special(text) if any(s in text for s in self.special) else [text]:
            if x in special:
                out.append(special[x])
            elif x:
                parts = [p if k == 0 else " " + p for k, p in enumerate(space_cuts(x))]
                words = [w for p in parts for w in self.vocabulary.words(p)]
                out.extend(self.ids([w.encode() for w in words])[0].tolist())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def word_counts(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, words up to LEXICON_BYTES bytes. Tasks count the parts between spaces in
    dictionaries of bounded size, cut each part into words once, and pass on sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        words = vocabulary_of(path).words
        counts: dict[str, int] = {}

        def add(parts: list[str], space: str) -> None:
            found = pa.array(parts, pa.string()).value_counts()
            for part, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                part = space + part
                counts[part] = counts.get(part, 0) + n

        def out() -> pa.RecordBatch:
            sums: dict[str, int] = {}
            for part, n in counts.items():
                for word in words(part):
                    sums[word] = sums.get(word, 0) + n
            counts.clear()
            for word in [w for w in sums if len(w.encode()) > LEXICON_BYTES]:
                del sums[word]
            arrays = [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for _, texts in text_pieces(batch, 0):
                firsts, rest = [], []
                for text in texts:
                    first, *others = space_cuts(text)
                    firsts.append(first)
                    rest += others
                add(firsts, "")
                add(rest, " ")
                if len(counts) > COUNT_ENTRIES:
                    yield out()
        if counts:
            yield out()

    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, `size` at most: the lexicon's bound, not a cut in any result. The
    driver reads a histogram of counts (steps of an eighth of a power of two), which gives the least count whose
    words all fit, and then those words."""
    ensure_checkpoint_dir(df.sparkSession)
    counts = word_counts(df, path, text_col).checkpoint()
    step = F.floor(F.log2("n") * 8).cast("int")
    found = dict(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())
    least, words = None, 0
    for k in sorted(found, reverse=True):
        words += found[k]
        if words > size:
            break
        least = k
    if least is None:
        return []
    return sorted(r.word for r in counts.where(step >= least).select("word").collect())


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for each row of `df`."""
    codec_of = _codec_maker(df, path, text_col)

    def make():
        codec = codec_of()

        def run(texts: list[str]) -> list[list]:
            ids = [codec.encode(t) for t in texts]
            return [ids, [codec.decode(x) for x in ids]]

        return run

    return map_texts(df, id_col, text_col, "ids array<int>, decoded string", make)


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode_decode` with ids and text hashed in the worker."""
    codec_of = _codec_maker(df, path, text_col)

    def make():
        codec = codec_of()
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def run(texts: list[str]) -> list[list]:
            counts, id_hashes, text_hashes = [], [], []
            for shown, raw in codec.both(texts):
                counts.append(shown.count(",") + 1 if shown else 0)
                id_hashes.append(sha(shown.encode()))
                text_hashes.append(sha(raw.decode("utf-8", "replace").encode()))
            return [counts, id_hashes, text_hashes]

        return run

    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, CHUNK_BYTES)


def _codec_maker(df: DataFrame, path: str, text_col: str):
    vocabulary = vocabulary_of(path)
    frequent = [w.encode() for w in frequent_words(df, path, text_col)]
    ids, lengths = vocabulary.merge_many(frequent)
    ends = np.cumsum(lengths).tolist()
    words = {w: tuple(ids[b - n : b].tolist()) for w, b, n in zip(frequent, ends, lengths.tolist(), strict=True)}
    # At most LEXICON_WORDS words of LEXICON_BYTES bytes: 12 bytes an arc, 4 an id, so under 20 MB.
    data = build_lexicon(words)
    shared, name = df.sparkSession.sparkContext.broadcast(data), f"{path} {hashlib.sha256(data).hexdigest()}"

    def codec() -> Codec:
        if name not in _codecs:  # kept from task to task, since Spark keeps its Python workers
            _codecs.clear()
            _codecs[name] = Codec(path, shared.value)
        return _codecs[name]

    return codec
