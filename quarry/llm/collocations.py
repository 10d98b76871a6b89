"""Operator 12. Phrase collocation mining by hashed buckets and Apriori pruning.

Phrases are counted length by length, one pass over the texts for each. While a pass counts the phrases of one length
exactly, it also counts those that are one word longer in hash buckets (saturating at the least frequency). What is left of
either is a bitmap of fixed size: the buckets with enough occurrences, and the buckets of phrases found to be frequent. Both
are broadcast, and the next pass counts a phrase only if its own bucket and both its parts (the phrase without its last and
without its first word) pass. Bitmaps only save work: what passes is counted exactly, by its words.

    pass 1   counts words          buckets of 2 words
    pass 2   counts 2 words        buckets of 3 words whose two pairs pass
    pass 3   counts 3 words        buckets of 4 words whose three pairs and two triples pass
    pass 4   counts 4 words

In a pass, a chunk of texts is tokenised and counted with numpy (counts by word numbers of the chunk, not by hashes), and
what leaves a task has been added up in the chunk already, then by Spark before its shuffle. Bucket counts leave a task as
gaps and counts by ranges of buckets; ranges are added up from a stream of sorted rows, so no task gathers them.

The bitmaps have a bit for every 32 bytes of text, MAX_BITS at most (16 MB). From some GB of text on, buckets of rare phrases
fill up as well and prune less; the counts stay exact, the shuffles get larger.

Defined results: a null or empty text has no words; a null language is `und`; very long texts are mined whole; rows repeated
count again; ties are ordered by phrase; ids are not looked at, so null ids count; an empty table gives an empty table;
other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, from_planes, planes, releasing

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences: 80 of 100.
COVER = (4, 5)
SCALE = 2_000_000
#: Bytes of text for a bit, and bits at least and at most.
BYTES_A_BIT, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 27
#: Ranges of buckets.
RANGES = 64
#: Bytes of text that are tokenised together (one longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Parts of a language that are ranked apart before the language is.
RANK_PARTS = 16

SPACE, BREAK = 0x20, 0x0A
#: A-Z lower-cased, what parts words as a space, what parts pieces as a line break.
TABLE = bytes(
    BREAK if c in b".,;:!?\n\x0b\x0c\r" else SPACE if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash of a phrase's hash and its next word's."""
    h = (h ^ (x + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 12)


class Bitmap:
    """Which buckets are set; all, if there are no bits."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), dtype=bool)
        at = bucket_of(h, 8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


class Chunk:
    """The words of some texts: numbers in `vocabulary`, hashes, and which follow their neighbour in one piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, lang_hashes: np.ndarray):
        data = np.frombuffer(b"\n".join(texts).translate(TABLE), dtype=np.uint8)
        word = (data != SPACE) & (data != BREAK)
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        breaks = np.flatnonzero(data == BREAK)
        piece = np.searchsorted(breaks, starts)
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary.cast(pa.string())
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.fromiter(map(word_hash, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.lang = langs[np.searchsorted(first, starts, side="right") - 1] if len(texts) else np.zeros(0, np.int64)
        self.together = piece[1:] == piece[:-1]
        self.hashes = hashes[self.word]
        self.one = mixed(lang_hashes[self.lang], self.hashes)

    def within(self, k: int) -> np.ndarray:
        """Where k words in one piece start, for all places that have k - 1 behind them."""
        n = max(0, len(self.word) - k + 1)
        ok = np.ones(n, dtype=bool)
        for j in range(k - 1):
            ok &= self.together[j : j + n]
        return ok

    def phrase(self, shorter: np.ndarray, k: int) -> np.ndarray:
        """Hashes of k words from those of k - 1."""
        n = max(0, len(self.word) - k + 1)
        return mixed(shorter[:n], self.hashes[k - 1 : k - 1 + n])

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, list, np.ndarray]:
        """(language, phrase, count) of the phrases of k words that start at some places."""
        key, size = self.lang[at], len(self.vocabulary)
        for j in range(k):
            key = key * size + self.word[at + j]
            if j < k - 1 and j:  # numbers of phrases stay below the number of places
                key = np.unique(key, return_inverse=True)[1]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        parts = [self.vocabulary.take(pa.array(self.word[at + j])) for j in range(k)]
        return self.lang[at], pa.compute.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], count


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[Chunk, pa.Array]]:
    """Chunks of texts (lang, text) with their languages."""
    import pyarrow.compute  # noqa: F401

    def made() -> tuple[Chunk, pa.Array]:
        coded = pa.array(langs, pa.string()).dictionary_encode()
        hashes = np.array([word_hash(x.encode()) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
        return Chunk(texts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashes), coded.dictionary

    texts, langs, used = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            if texts and used + len(data) > size:
                yield made()
                texts, langs, used = [], [], 0
            texts.append(data)
            langs.append(lang)
            used += len(data)
    if texts:
        yield made()


class Buckets:
    """Counts in buckets, which saturate."""

    def __init__(self, bits: int, least: int):
        self.counts, self.least = np.zeros(bits, dtype=np.uint8), min(least, 255)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(bucket_of(h, len(self.counts)).astype(np.uint32), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, self.least), self.least)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(range, its buckets as gaps and their counts, compressed)."""
        size = len(self.counts) // RANGES
        for r in range(RANGES):
            counts = self.counts[r * size : (r + 1) * size]
            at = np.flatnonzero(counts)
            if len(at):
                yield r, packed(at, counts[at])


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = planes(np.diff(at, prepend=0))
    body = np.concatenate((np.array([len(gaps)], dtype="<i8").view(np.uint8), gaps, counts))
    return np.array([len(body)], dtype="<i8").tobytes() + pa.compress(body.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data, "<i8", 1)[0]), codec="zstd"), np.uint8)
    n = 8 + int(body[:8].view("<i8")[0])
    return np.cumsum(from_planes(body[8:n]).astype(np.int64)), body[n:]


OUT = "lang string, phrase string, n long, `range` int, data binary"


def bucket_batch(found: Buckets) -> Iterator[pa.RecordBatch]:
    for r, data in found.rows():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([r], pa.int32()), pa.array([data], pa.binary())], ["lang", "phrase", "n", "range", "data"])


def counts_batch(langs: pa.Array, lang: np.ndarray, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), phrases.cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["lang", "phrase", "n", "range", "data"])


def one_pass(texts: DataFrame, k: int, bits: int, least: int, longest: int, shorter: Bitmap, buckets: Bitmap) -> DataFrame:
    """Counts of phrases of k words whose bucket and parts pass, and bucket counts of phrases one word longer, written to
    the checkpoint folder. shorter: frequent phrases of k - 1 words; buckets: of k words."""
    shared = texts.sparkSession.sparkContext.broadcast((shorter, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, buckets = shared.value
        longer = Buckets(bits, least) if k < longest else None
        for c, langs in chunks(batches):
            h = c.one
            for j in range(2, k):
                h = c.phrase(h, j)  # of k - 1 words
            ok = c.within(k)
            if k > 1:
                frequent = shorter[h]
                full = c.phrase(h, k)
                # The part without the first word has a hash of its own, which the word behind it starts.
                ok &= frequent[: len(ok)] & frequent[1 : len(ok) + 1] & buckets[full]
            else:
                full = c.one
            at = np.flatnonzero(ok)
            if len(at):
                lang, phrases, n = c.counted(at, k)
                for a in range(0, len(n), 1 << 17):
                    yield counts_batch(langs, lang[a : a + (1 << 17)], phrases.slice(a, 1 << 17), n[a : a + (1 << 17)])
            if longer:
                further = c.within(k + 1)
                further &= ok[: len(further)] & ok[1 : len(further) + 1]
                longer.add(c.phrase(full, k + 1)[further])
        if longer:
            yield from bucket_batch(longer)

    return texts.mapInArrow(releasing_stream(run), OUT).checkpoint()


def releasing_stream(run):
    """A stream's function that gives freed memory back at its start and end."""

    def again(batches):
        releasing(lambda: None)()
        yield from run(batches)
        releasing(lambda: None)()

    return again


def phrase_buckets(frequent: DataFrame, bits: int) -> DataFrame:
    """The buckets of phrases (lang, phrase), as bucket rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(bits, 1)
        for batch in batches:
            h = np.fromiter((word_hash(x.encode()) for x in batch.column(0).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            split = [x.encode().split(b" ") for x in batch.column(1).to_pylist()]
            for j in range(max(map(len, split), default=0)):
                h = mixed(h, np.fromiter((word_hash(x[j]) for x in split), dtype=np.uint64, count=len(split)))
            found.add(h)
        yield from bucket_batch(found)

    return frequent.select("lang", "phrase").mapInArrow(run, OUT)


def bitmap(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """The buckets with `least` occurrences: `bits` / 8 bytes, in ranges. A range's rows come as a sorted stream and are
    added up one after the other."""
    size, least = bits // RANGES, min(least, 255)
    sent = rows.where("data is not null").select("range", "data").repartition(RANGES, "range").sortWithinPartitions("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()])], ["range", "data"])
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at:
                    if at is not None:
                        yield row()
                    at, counts = r, np.zeros(size, dtype=np.uint16)
                places, n = unpacked(data.as_buffer().to_pybytes())
                counts[places] = np.minimum(counts[places] + n, least)
        if at is not None:
            yield row()

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in sent.mapInArrow(run, "`range` int, data binary").collect():  # bits / 8 bytes in all
        out[r["range"] * size // 8 : (r["range"] + 1) * size // 8] = np.frombuffer(r["data"], np.uint8)
    return Bitmap(out)


def bits_for(size: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(1, size // BYTES_A_BIT) - 1).bit_length()))


def frequent_phrases(df: DataFrame, text_col: str, lang_col: str, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of up to `longest` words with `least` occurrences; (lang, n) words)."""
    ensure_checkpoint_dir(df.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    texts = df.select(lang, F.col(text_col).cast("string").alias("text"))
    bits = bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    every, totals = None, None
    shorter = buckets = Bitmap(None)
    for k in range(1, longest + 1):
        rows = one_pass(texts, k, bits, least, longest, shorter, buckets)
        counted = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = counted.where(F.col("f") >= least).withColumn("k", F.lit(k)).checkpoint()
        every = frequent if every is None else every.unionByName(frequent)
        if k < longest:
            buckets = bitmap(rows, bits, least)
            shorter = bitmap(phrase_buckets(frequent, bits), bits, 1)
    return every, totals


def part(phrase: Column, a: Column | int, n: Column | int) -> Column:
    """`n` words of a phrase from the a-th on."""
    return F.array_join(F.slice(F.split(phrase, " "), a, n), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words by the score of
    their weakest cut, without those that a longer phrase mostly covers."""
    every, totals = frequent_phrases(df, text_col, lang_col, least, longest)
    several = every.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    # Each cut, with the frequencies of its two parts: these are frequent as well, since the whole is.
    known = every.select("lang", F.col("phrase").alias("part"), "f")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first = cuts.withColumn("part", part(F.col("phrase"), F.lit(1), F.col("cut"))).join(known.withColumnRenamed("f", "l"), ["lang", "part"]).drop("part")
    both = first.withColumn("part", part(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))).join(known.withColumnRenamed("f", "r"), ["lang", "part"])
    score = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    weakest = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    # Phrases within longer ones, with the most frequent of these.
    spans = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.struct(a.alias("a"), n.alias("n"))))),
        lambda s: s["n"] < F.col("k"),
    )
    inner = several.where("k > 2").select("lang", F.explode(spans).alias("s"), F.col("phrase").alias("whole"), F.col("a").alias("f"))
    covers = inner.select("lang", part(F.col("whole"), F.col("s.a"), F.col("s.n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = lambda c, times: F.col(c).cast("decimal(19,0)") * F.lit(times)
    kept = weakest.join(covers, ["lang", "phrase"], "left").where(F.col("f").isNull() | (wide("f", COVER[1]) < wide("a", COVER[0])))
    flat = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    from pyspark.sql import Window

    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    dealt = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The query in DuckDB's SQL."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: {" || ' ' || ".join(f'w[i + {j}]' for j in range(k))})) AS phrase FROM pieces WHERE len(w) >= {k}"
        for k in range(1, LONGEST + 1)
    )
    words = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS ({grams}),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.w, c.a, cut, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = {words("1", "cut")} JOIN f y ON y.lang = c.lang AND y.phrase = {words("cut + 1", "c.k")}),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, {words("i", "i + n - 1")} AS phrase, a AS f
           FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM cand WHERE k > 2))),
covers AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN covers c USING (lang, phrase) WHERE c.f IS NULL OR 100::HUGEINT * c.f < 80::HUGEINT * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
