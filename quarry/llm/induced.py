"""External induced sorting of suffixes, with common-prefix values carried along, in numpy batches.

A suffix is S (small) if it is less than the next one, else L. The order of the leftmost S suffixes ("stars")
induces all others in two scans: ascending, each suffix taken from a priority queue pushes its L predecessor;
descending, its S predecessor. What is queued are tuples (position, common prefix with the tuple before it), under
the key (first symbol, time of arrival); as keys of one scan never fall behind the symbol that is being taken,
the queue is a lane of tuples for each range of symbols, appended to and read once. Lanes hold `memory` bytes
together; beyond that they are appended to a file, a run of tuples for each lane.

The stars are ordered by recursion: a first pair of scans from stars in order of their first symbol only sorts the
substrings from star to star; equal ones get one name, and the names, in order of the text, are a text of a third of
the length or less, whose suffixes are sorted in the same way. Recursion ends when all names differ or names span
`depth` symbols, as nothing beyond `depth` is asked for.

Common prefixes: that of two stars is the one that the recursion found, in names, turned into symbols, and what the
first two different names share. In a scan, two tuples pushed into one symbol in turn share one symbol more than the
least of the values between their sources (a range minimum over the batch); the last L and first S suffix of a
symbol share the lesser of their runs of it.

Texts and the queues' lanes are scratch files when they exceed `memory`, in the task's temporary folder, unlinked at once;
they are a task's spill and nothing reads them after it. Arrays as long as the stars (places, names, prefixes) stay in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the lanes of a scan hold before they go to disk; suffixes in a lane of many symbols, on average.
MEMORY, LANE = 4 << 20, 1 << 13
#: Symbols of padding behind a text, so that words can be read across its end.
PAD = 8
TYPES_BLOCK = 1 << 18


def scratch(n: int, dtype, memory: int) -> np.ndarray:
    """Room for n values: in memory if small, else a mapped file."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype=dtype)
    return np.asarray(np.memmap(tempfile.TemporaryFile(prefix="suffixes-"), dtype=dtype, mode="w+", shape=(n,)))


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys of 32 bits at most, by halves of 16 bits, which numpy sorts by radix."""
    if len(keys) < 512 or keys.itemsize == 2:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Lanes:
    """A monotone priority queue of (position, common prefix): a lane for each range of symbols, in order of
    arrival, on disk beyond `memory` bytes."""

    ENTRY = 5

    def __init__(self, lanes: int, memory: int) -> None:
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(lanes)]
        self.on_disk: list[list[tuple[int, int]]] = [[] for _ in range(lanes)]
        self.memory, self.used, self.file, self.spilled = memory, 0, None, 0

    def push(self, lane: int, position: np.ndarray, common: np.ndarray) -> None:
        self.held[lane].append((position, common))
        self.used += self.ENTRY * len(position)
        if self.used > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="lanes-")
        at = self.file.seek(0, 2)
        for lane, parts in enumerate(self.held):
            if parts:
                n = sum(len(p) for p, _ in parts)
                self.on_disk[lane].append((at, n))
                for p, _ in parts:
                    self.file.write(p)
                for _, c in parts:
                    self.file.write(c)
                at += self.ENTRY * n
                parts.clear()
        self.spilled += self.used
        self.used = 0

    def take(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a lane, oldest first; the lane is empty afterwards."""
        parts = []
        for at, n in self.on_disk[lane]:
            self.file.seek(at)
            data = self.file.read(self.ENTRY * n)
            parts.append((np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint8, n, 4 * n)))
        parts += self.held[lane]
        self.used -= self.ENTRY * sum(len(p) for p, _ in self.held[lane])
        self.on_disk[lane], self.held[lane] = [], []
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """Symbols with their types, as 2 * symbol + (1 if S). The last symbol is 0 and found nowhere else."""

    def __init__(self, n: int, symbols: int, memory: int) -> None:
        self.n, self.symbols, self.memory = n, symbols, memory
        kind = np.uint16 if 2 * symbols + 1 < 1 << 16 else np.uint32
        self.coded = scratch(n + PAD, kind, memory)
        self.per_word = 8 // self.coded.itemsize
        shape = (n + PAD - self.per_word + 1,)
        self.words = np.ndarray(shape, "<u8", buffer=self.coded, strides=(self.coded.itemsize,))
        bits = 8 * self.coded.itemsize
        self.no_types = np.uint64(sum(((1 << bits) - 2) << (bits * k) for k in range(self.per_word)))
        #: Masks of the first k symbols of a word.
        self.first = np.array([(1 << (bits * k)) - 1 for k in range(self.per_word + 1)], dtype=np.uint64)
        self.bits = bits

    def set_types(self) -> None:
        """Doubles the symbols in `coded` and adds the types, from the end, a block at a time."""
        x, n = self.coded, self.n
        follower, small = 0, 1
        x[n - 1] = 1
        for b in range(n - 1, 0, -TYPES_BLOCK):
            a = max(b - TYPES_BLOCK, 0)
            now = np.array(x[a:b], dtype=np.int64)
            after = np.append(now[1:], follower)
            less, differs = now < after, now != after
            at = np.where(differs, np.arange(b - a), b - a)
            at = np.minimum.accumulate(at[::-1])[::-1]
            kinds = np.append(less, bool(small))[at]
            x[a:b] = (now << 1) + kinds
            follower, small = int(now[0]), int(kinds[0])

    def stars(self) -> np.ndarray:
        """Positions of leftmost S suffixes, in order of the text."""
        found = []
        for a in range(1, self.n, TYPES_BLOCK):
            small = (self.coded[a - 1 : min(a + TYPES_BLOCK, self.n)] & 1).astype(bool)
            found.append(np.nonzero(small[1:] & ~small[:-1])[0].astype(np.int32) + np.int32(a))
        return np.concatenate(found)

    def runs(self, positions: np.ndarray, most: int) -> np.ndarray:
        """How often the symbol at a position is repeated from there on, `most` at most."""
        symbol = self.coded[positions] >> 1
        out, left, k = np.ones(len(positions), np.uint8), np.arange(len(positions)), 1
        while len(left) and k < most:
            left = left[(self.coded[positions[left] + k] >> 1) == symbol[left]]
            out[left] += 1
            k += 1
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` symbols, and their types, are equal from a and from b."""
        same, left, k = np.ones(len(a), bool), np.arange(len(a)), 0
        while len(left):
            mask = self.first[np.minimum(length[left] - k, self.per_word)]
            differs = (self.words[a[left] + k] ^ self.words[b[left] + k]) & mask != 0
            same[left[differs]] = False
            k += self.per_word
            left = left[~differs & (length[left] > k)]
        return same

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
        """Symbols shared from a and from b, `depth` at most; `known` of them are equal for sure."""
        out = np.minimum(known, depth).astype(np.int64)
        left = np.nonzero(out < depth)[0]
        while len(left):
            x = (self.words[a[left] + out[left]] ^ self.words[b[left] + out[left]]) & self.no_types
            lowest = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1  # the first different bit
            out[left] += np.where(x == 0, self.per_word, lowest // self.bits)
            left = left[(x == 0) & (out[left] < depth)]
        return np.minimum(out, depth).astype(np.uint8)


def pushed(symbol: np.ndarray, source: np.ndarray, common: np.ndarray | None, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pushes by symbol, and the common prefix of each with the one before it in its symbol. `source`:
    their sources' places in a batch, whose values are `common`. The first push of a batch shares the symbol only
    with an earlier one, as sources of another batch begin otherwise."""
    order = stable_order(symbol)
    out = np.ones(len(order), np.uint8)
    if common is None or len(order) < 2:
        return order, out
    s, at = symbol[order], source[order]
    later = np.nonzero(s[1:] == s[:-1])[0] + 1
    if not len(later):
        return order, out
    lo, hi = at[later - 1] + 1, at[later]
    level = np.frexp((hi - lo + 1).astype(np.float32))[1] - 1
    size, levels = len(common), int(level.max()) + 1
    table = np.empty((levels, size), np.uint8)
    table[0] = common
    for k in range(1, levels):
        half = 1 << (k - 1)
        table[k, size - half :] = table[k - 1, size - half :]
        np.minimum(table[k - 1, : size - half], table[k - 1, half:], out=table[k, : size - half])
    flat = table.ravel()
    least = np.minimum(flat[level * size + lo], flat[level * size + hi + 1 - (1 << level)])
    out[later] = np.minimum(least, depth - 1) + 1
    return order, out


class Scans:
    """The two scans over a text, from stars in order."""

    def __init__(self, text: Text, edges: np.ndarray, depth: int, carry: bool) -> None:
        self.text, self.coded, self.edges, self.depth, self.carry = text, text.coded, edges, depth, carry
        self.bounds, self.spilled = edges.astype(text.coded.dtype), 0

    def _before(self, sequence: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: places of those with a predecessor of the type, the predecessors, and their symbols."""
        before = sequence - 1
        coded = self.coded[before]  # of position 0 the padding, which doesn't count
        place = np.nonzero(((coded & 1) == small) & (before >= 0))[0]
        return place, before[place], coded[place] >> 1

    def _send(self, queue: Lanes, symbol: np.ndarray, before: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        if not len(before):
            return
        order, shared = pushed(symbol, place, common if self.carry else None, self.depth)
        before, symbol = before[order], symbol[order]
        cuts = np.searchsorted(symbol, self.bounds)
        for lane in np.nonzero(cuts[1:] > cuts[:-1])[0].tolist():
            queue.push(lane, before[cuts[lane] : cuts[lane + 1]], shared[cuts[lane] : cuts[lane + 1]])

    def _chain(self, position: np.ndarray, common: np.ndarray, symbol: int, small: int) -> tuple[np.ndarray, np.ndarray]:
        """A lane of one symbol with the predecessors of that symbol, which follow in turn: first the suffixes
        with one copy of the symbol in front, then those with two, and so on."""
        parts, copies = [(position, common)], 1
        if len(common):
            common = common.copy()
            common[0] = 0
            parts = [(position, common)]
        while len(position):
            place, before, symbols = self._before(position, small)
            here = symbols == symbol
            place, position = place[here], before[here]
            if not len(position):
                break
            _, common = pushed(np.zeros(len(position), np.uint8), place, common if self.carry else None, self.depth)
            common[0] = min(copies, self.depth)
            parts.append((position, common))
            copies += 1
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def _joined(self, position: np.ndarray, common: np.ndarray, rest: np.ndarray, rest_common: np.ndarray):
        """A lane of one symbol: tuples of the scan's type, then those of the other."""
        if not len(position) or not len(rest):
            return (rest, rest_common) if len(rest) else (position, common)
        rest_common = rest_common.copy()
        if self.carry:
            rest_common[0] = min(int(x) for x in self.text.runs(np.array([position[-1], rest[0]]), self.depth))
        return np.concatenate((position, rest)), np.concatenate((common, rest_common))

    def _settle(self, position: np.ndarray, common: np.ndarray, rest: np.ndarray, rest_common: np.ndarray, lane: int, small: int):
        """A lane of several symbols in scan order: of each symbol what came from other lanes, what comes from
        this lane, and the tuples of the other type. Predecessors within the lane are put in again until nothing
        changes, which takes as many rounds as such predecessors follow each other."""
        lo, hi = np.uint32(self.edges[lane]), np.uint32(self.edges[lane + 1])
        inner, inner_common = position[:0], common[:0]
        while True:
            every = np.concatenate((position, inner, rest))
            part = np.repeat(np.arange(3, dtype=np.uint32), (len(position), len(inner), len(rest)))
            symbol = (self.coded[every] >> 1).astype(np.uint32)
            order = stable_order((hi - symbol if small else symbol - lo) * np.uint32(4) + part)
            every, symbol, part = every[order], symbol[order], part[order]
            shared = np.concatenate((common, inner_common, rest_common))[order]
            if self.carry and len(every):
                new = np.append(True, symbol[1:] != symbol[:-1])
                turn = np.nonzero(~new & (part == 2) & np.append(False, part[1:] != part[:-1]))[0]
                shared[new] = 0
                if len(turn):
                    shared[turn] = np.minimum(self.text.runs(every[turn - 1], self.depth), self.text.runs(every[turn], self.depth))
            place, before, symbols = self._before(every, small)
            here = (symbols >= lo) & (symbols < hi)
            found_order, found_common = pushed(symbols[here], place[here], shared if self.carry else None, self.depth)
            found = before[here][found_order]
            if len(found) == len(inner) and np.array_equal(found, inner) and np.array_equal(found_common, inner_common):
                return every, shared, part != 2, (place[~here], before[~here], symbols[~here])
            inner, inner_common = found, found_common

    def _lane(self, lane: int, queue: Lanes, rest: np.ndarray, rest_common: np.ndarray, small: int):
        """The lane's sequence, its common prefixes, and which are of the scan's type; sends what it induces."""
        position, common = queue.take(lane)
        if not len(position) and not len(rest):
            return position, common, np.zeros(0, bool)
        if self.edges[lane + 1] - self.edges[lane] == 1:
            symbol = int(self.edges[lane])
            position, common = self._chain(position, common, symbol, small)
            own = len(position)
            every, shared = self._joined(position, common, rest, rest_common)
            place, before, symbols = self._before(every, small)
            there = symbols != symbol
            out, mine = (place[there], before[there], symbols[there]), np.arange(len(every)) < own
        else:
            every, shared, mine, out = self._settle(position, common, rest, rest_common, lane, small)
        place, before, symbols = out
        self._send(queue, symbols, before, place, shared)
        return every, shared, mine

    def run(self, stars: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the greatest to the least, lane by lane: positions, and the common prefix with the
        suffix before (0 at the start of a symbol)."""
        edges, text = self.edges, self.text
        lanes = len(edges) - 1
        cuts = np.searchsorted(self.coded[stars] >> 1, edges)
        queue, large = Lanes(lanes, text.memory), Lanes(lanes, text.memory)
        for lane in range(lanes):
            a, b = cuts[lane], cuts[lane + 1]
            every, shared, mine = self._lane(lane, queue, stars[a:b], common[a:b], 0)
            if mine.any():
                large.push(lane, every[mine], shared[mine])
        self.spilled += queue.spilled + large.spilled
        queue.close()
        queue = Lanes(lanes, text.memory)
        queue.push(0, np.array([text.n - 1], np.int32), np.zeros(1, np.uint8))
        for lane in range(lanes - 1, -1, -1):
            every, shared = large.take(lane)
            # Backwards: the value of a suffix is now that with the one that was after it.
            back = np.append(np.uint8(0), shared[:0:-1]) if len(shared) else shared
            every, shared, _ = self._lane(lane, queue, every[::-1], back, 1)
            if len(every):
                yield every, shared
        self.spilled += queue.spilled
        queue.close()
        large.close()


def lane_edges(text: Text) -> np.ndarray:
    """Bounds of the symbols of lanes: one symbol each for bytes, else about LANE suffixes each."""
    if text.symbols <= 258:
        return np.arange(text.symbols + 1)
    counts = np.zeros(text.symbols, np.int64)
    for a in range(0, text.n, TYPES_BLOCK):
        counts += np.bincount(text.coded[a : min(a + TYPES_BLOCK, text.n)] >> 1, minlength=text.symbols)
    upto = np.cumsum(counts)
    edges = np.searchsorted(upto, np.arange(LANE, text.n + LANE, LANE), side="left") + 1
    return np.unique(np.concatenate(([0], edges[edges < text.symbols], [text.symbols])))


class Figures:
    """What a sort did: its levels of recursion and the bytes of tuples that went to disk."""

    def __init__(self) -> None:
        self.levels = self.spilled = 0


def sorted_suffixes(text: Text, depth: int, figures: Figures | None = None, level: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of a text (its types set) in descending order of their first `depth` symbols at least, in
    parts: positions, and symbols shared with the suffix before, `depth` at most."""
    figures = figures or Figures()
    figures.levels = max(figures.levels, level)
    edges, memory = lane_edges(text), text.memory
    stars = text.stars()
    m = len(stars)
    # First pair of scans: stars in order of their substrings.
    first = stars[stable_order(text.coded[stars] >> 1)]
    scans, ordered, at = Scans(text, edges, depth, False), scratch(m, np.int32, memory), m
    for every, _ in scans.run(first, np.zeros(m, np.uint8)):
        coded = text.coded[every] & 1
        # Stars are S with an L before them.
        found = every[(coded == 1) & (every > 0) & ((text.coded[np.maximum(every - 1, 0)] & 1) == 0)]
        ordered[at - len(found) : at] = found[::-1]
        at -= len(found)
    figures.spilled += scans.spilled
    del first
    number = scratch(text.n, np.int32, memory)
    number[stars] = np.arange(m, dtype=np.int32)
    place = number[ordered]
    del number
    length = np.append(np.diff(stars), 0) + 1
    same = (length[place[1:]] == length[place[:-1]]) & (place[1:] != m - 1)
    pairs = np.nonzero(same)[0]
    same[pairs] = text.equal(ordered[pairs], ordered[pairs + 1], length[place[pairs]])
    name = np.append(0, np.cumsum(~same, dtype=np.int64))
    names = int(name[-1]) + 1
    deep = -(-depth // 2)
    if names == m or deep <= 1:
        known = np.append(0, np.where(same, deep, 0))
    else:
        reduced = Text(m, names, memory)
        reduced.coded[place] = name
        del name, same
        reduced.set_types()
        at, known = m, np.zeros(m, np.int64)
        for every, shared in sorted_suffixes(reduced, deep, figures, level + 1):
            # Descending: the value of an entry belongs to its upper neighbour.
            place[at - len(every) : at] = every[::-1]
            upper = np.arange(at - 1, at - 1 - len(every), -1) + 1
            known[upper[upper < m]] = shared[upper < m]
            at -= len(every)
        del reduced
        ordered[:] = stars[place]
    # Names shared become symbols shared, then what the first two different names share is added.
    common = np.zeros(m, np.uint8)
    if m > 1:
        a, b = place[:-1], place[1:]
        k = np.minimum(known[1:], m - 1 - np.maximum(a, b))
        sure = np.where(known[1:] >= deep, depth, stars[a + k] - stars[a])
        common[1:] = text.common(ordered[:-1], ordered[1:], sure, depth)
        # Within a lane only: the first star of a symbol has nothing before it.
    scans = Scans(text, edges, depth, True)
    yield from scans.run(np.asarray(ordered), common)
    figures.spilled += scans.spilled


def byte_text(data: bytes, lengths: np.ndarray, memory: int) -> Text:
    """Strings laid end to end as a text: bytes plus two, a 1 behind every string, and the last 0."""
    n, strings = len(data), len(lengths)
    text = Text(n + strings + 1, 258, memory)
    raw, ends = np.frombuffer(data, np.uint8), np.cumsum(lengths)
    at = 0
    while at < strings:  # some strings at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TYPES_BLOCK)))
        base, top = int(ends[at - 1]) if at else 0, int(ends[min(to, strings) - 1])
        size = lengths[at:to]
        shift = np.repeat(np.arange(at, at + len(size)), size)
        text.coded[base + at : top + at + len(size)] = 1
        text.coded[np.arange(base, top) + shift] = raw[base:top].astype(np.uint16) + 2
        at += len(size)
    text.set_types()
    return text


def repeated_windows(
    data: bytes, lengths: np.ndarray, owners: np.ndarray, window: int, memory: int = MEMORY, figures: Figures | None = None
) -> np.ndarray:
    """For strings laid end to end: True at each start of a window of bytes that a string of a lesser owner holds
    too. Windows don't cross strings. Windows are equal if the common prefix of neighbours in the order of
    suffixes reaches the window's length; an end mark in between keeps it shorter."""
    lengths = np.asarray(lengths, dtype=np.int64)
    flags = np.zeros(len(data), dtype=bool)
    if not len(data):
        return flags
    text = byte_text(data, lengths, memory)
    ends = np.cumsum(lengths + 1)
    for every, shared in sorted_suffixes(text, window, figures):
        head = np.nonzero(shared < window)[0]
        size = np.diff(np.append(head, len(every)))
        groups = np.nonzero(size > 1)[0]
        if not len(groups):
            continue
        size, head = size[groups], head[groups]
        inner = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        position = every[inner]
        string = np.searchsorted(ends, position, side="right")
        # A window with an end mark in it is shared by windows with end marks only.
        fits = position + window < ends[np.minimum(string, len(ends) - 1)]
        owner = np.where(fits, owners[np.minimum(string, len(ends) - 1)], 0)
        starts = np.cumsum(size) - size
        least = np.repeat(np.minimum.reduceat(owner, starts), size)
        gone = fits & (owner > least)
        flags[position[gone] - string[gone]] = True
    return flags
