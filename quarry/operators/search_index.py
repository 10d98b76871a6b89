"""A stored search index: postings with positions by term buckets, a dictionary for typos, upserts by batches.

    <path>/postings/batch=<n>/bucket=<crc32 of the term>    term, key, positions
    <path>/pieces/batch=<n>/bucket=<crc32 of the piece>     piece, term
    <path>/changes/batch=<n>                                 key; written last, so a batch counts only when it is whole

A search reads one bucket for each term that a query's word may stand for. Which these are is looked up, not measured against
every term: a term is cut into one piece more than there are typos, so a word that is near enough has one of the pieces whole, no
further from its place than there are typos. The pieces that a word may have are looked up in their buckets, for each length of
a term, and only what is found is measured. (A word that allows no typo is its own only term.) A term leaves five pieces at most;
batches of earlier indexes have `variants` instead, what is left of a term's first PREFIX letters when at most two are taken out,
and are searched by these.

An upsert adds a batch: the postings of its documents, and their keys as changes. A posting counts unless a later batch has
changed its document; a document without a text is thereby taken away. A batch that broke off, or came twice, is written again
under its number and counts once. `compact` writes the postings that count as one new batch; the ones it stands for are then
passed over.

Defined results: a null key is left out; of several texts of one key in a batch the largest counts (by the text itself), so a
repeated row changes nothing; an empty table makes an empty batch.
"""

from __future__ import annotations

import zlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import files
from .search import allowed_typos, positions_index, ranked

#: Buckets of terms and of pieces, letters that variants are made of, terms that a query may stand for.
BUCKETS, PREFIX, MOST_TERMS = 256, 8, 10_000
#: Fewest and most letters of the terms that a word may stand for with as many typos (see `allowed_typos`).
LETTERS = {1: (4, 9), 2: (7, None)}


def bucket(c: Column, buckets: int) -> Column:
    return (F.crc32(c) % buckets).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def variants_of(word: str, typos: int = 2) -> set[str]:
    """What is left of the first letters when up to `typos` of them are taken out."""
    head = word[:PREFIX]
    return {"".join(c for i, c in enumerate(head) if i not in out) for k in range(min(typos, len(head)) + 1) for out in combinations(range(len(head)), k)}


def variants(term: Column) -> Column:
    """The same for two typos, as an array."""
    head = F.substring(term, 1, PREFIX)
    less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    shorter = lambda words: F.flatten(F.transform(F.filter(words, lambda s: F.length(s) > 0), less))
    made = lambda one: F.array_distinct(F.concat(F.array(head), one, shorter(one)))
    return F.transform(F.array(shorter(F.array(head))), made)[0]


def cuts(letters: int, typos: int) -> list[int]:
    """Where the pieces of a term begin, and its end."""
    return [letters * i // (typos + 1) for i in range(typos + 2)]


def pieces(term: Column) -> Column:
    """A term's pieces for one typo and for two, as far as it has letters for them: typos.number.letters.piece."""
    n, made = F.length(term), []
    for typos, (fewest, most) in LETTERS.items():
        start = lambda i: F.floor(n * i / (typos + 1)).cast("int")  # noqa: B023, E731
        own = F.array(*(F.concat(F.lit(f"{typos}.{i}."), n.cast("string"), F.lit("."), F.substr(term, start(i) + 1, start(i + 1) - start(i))) for i in range(typos + 1)))
        made.append(F.when((n >= fewest) if most is None else n.between(fewest, most), own).otherwise(F.array().cast("array<string>")))
    return F.concat(*made)


def pieces_of(word: str, typos: int) -> set[str]:
    """The pieces of which a term within `typos` edits of the word has one at least."""
    found, (fewest, most) = set(), LETTERS[typos]
    for n in range(max(len(word) - typos, fewest), min(len(word) + typos, most or len(word) + typos) + 1):
        at = cuts(n, typos)
        for i, (a, b) in enumerate(zip(at, at[1:])):
            starts = range(max(a - typos, 0), min(a + typos, len(word) - (b - a)) + 1)
            found |= {f"{typos}.{i}.{n}.{word[x : x + b - a]}" for x in starts}
    return found


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole batches from the last compaction on."""
    fs, at = files(spark, f"{path}/changes")
    if not fs.exists(at):
        return []
    done = {}
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        inside = {x.getPath().getName() for x in fs.listStatus(folder.getPath())} if name.startswith("batch=") else set()
        if "_SUCCESS" in inside:
            done[int(name.split("=")[1])] = "_BASE" in inside
    base = max((n for n, is_base in done.items() if is_base), default=min(done, default=0))
    return sorted(n for n in done if n >= base)


def upsert(df: DataFrame, path: str, key: str, text: str, batch: int, buckets: int = BUCKETS) -> None:
    """Adds or replaces documents, as batch `batch` (larger than those before, or the same again). Null texts take their
    documents away."""
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias("_text"))
    postings = positions_index(one, key, "_text").withColumnRenamed(key, "key")
    place = postings.withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket")
    place.sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    write_pieces(stored(df.sparkSession, path, [batch], "postings").select("term").distinct(), path, batch, buckets)
    one.select(F.col(key).alias("key")).write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def write_pieces(terms: DataFrame, path: str, batch: int, buckets: int) -> None:
    cut = terms.select("term", F.explode(pieces(F.col("term"))).alias("piece")).withColumn("bucket", bucket(F.col("piece"), buckets)).repartition("bucket")
    cut.sortWithinPartitions("bucket", "piece").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pieces/batch={batch}")


SCHEMAS = {"postings": "term string, key {key}, positions array<int>, bucket int", "pieces": "piece string, term string, bucket int", "variants": "variant string, term string, bucket int", "changes": "key {key}"}


def stored(spark: SparkSession, path: str, batches: list[int], what: str, key: str = "long") -> DataFrame:
    """A part of the index over some batches, with `batch`."""
    schema = SCHEMAS[what].format(key=key)
    out = spark.createDataFrame([], f"{schema}, batch int")
    for n in batches:  # a union of scans; compaction keeps them few
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{what}/batch={n}").withColumn("batch", F.lit(n)))
    return out


def current(spark: SparkSession, path: str, found: DataFrame, batches: list[int], key: str = "long") -> DataFrame:
    """The postings that no later batch has replaced."""
    last = stored(spark, path, batches[1:], "changes", key).groupBy("key").agg(F.max("batch").alias("_last"))
    return found.join(last, "key", "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col("batch"))).drop("_last")


def holding(spark: SparkSession, path: str, batches: list[int], what: str) -> list[int]:
    """The batches that have this part: pieces, or variants as batches of earlier indexes have."""

    def has(n: int) -> bool:
        fs, at = files(spark, f"{path}/{what}/batch={n}")
        return fs.exists(at)

    return [n for n in batches if has(n)]


def matched(spark: SparkSession, path: str, batches: list[int], words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, i, typos): the index's terms that each word may stand for."""
    found = spark.createDataFrame([(w, i, 0) for i, w in enumerate(words)], "term string, i int, typos int")
    loose = [(i, w, allowed_typos(w)) for i, w in enumerate(words) if allowed_typos(w)]
    for what, name, of in (("pieces", "piece", pieces_of), ("variants", "variant", variants_of)):
        asked, some = [(v, i, w, most) for i, w, most in loose for v in of(w, most)], holding(spark, path, batches, what)
        if not asked or not some:
            continue
        query = spark.createDataFrame(asked, f"{name} string, i int, word string, most int")
        near = stored(spark, path, some, what).where(F.col("bucket").isin(sorted({bucket_of(v, buckets) for v, *_ in asked})) & F.col(name).isin(sorted({v for v, *_ in asked})))
        measured = near.join(F.broadcast(query), name).where(F.abs(F.length("term") - F.length("word")) <= 2).select("term", "i", F.levenshtein("term", "word").alias("typos"), "most")
        found = found.unionByName(measured.where(F.col("typos") <= F.col("most")).select("term", "i", "typos"))
    return found.distinct()


def search(spark: SparkSession, path: str, words: list[str], far: int = 8, key: str = "long", buckets: int = BUCKETS) -> DataFrame:
    """(key, matched, typos, proximity) as `ranked` over the documents that count. ValueError if the words may stand for more
    than MOST_TERMS terms."""
    batches = committed(spark, path)
    terms = matched(spark, path, batches, words, buckets).limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    hits = spark.createDataFrame([(t.term, t.i, t.typos) for t in terms], "term string, i int, typos int")
    names = sorted({t.term for t in terms})
    found = stored(spark, path, batches, "postings", key).where(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in names})) & F.col("term").isin(names))
    return ranked(current(spark, path, found, batches, key).select("term", "key", "positions"), "key", words, far, hits)


def compact(spark: SparkSession, path: str, batch: int, key: str = "long") -> None:
    """Writes the postings that count as batch `batch` (larger than all before), which from then on is the first."""
    batches = committed(spark, path)
    live = current(spark, path, stored(spark, path, batches, "postings", key), batches, key).drop("batch")
    live.repartition("bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    terms = stored(spark, path, [batch], "postings", key).select("term").distinct()
    for what, name in (("pieces", "piece"), ("variants", "variant")):
        if some := holding(spark, path, batches, what):
            words = stored(spark, path, some, what).drop("batch").distinct().join(terms, "term", "left_semi").select(name, "term", "bucket")
            words.repartition("bucket").sortWithinPartitions("bucket", name).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{what}/batch={batch}")
    stored(spark, path, [batch], "postings", key).select("key").distinct().write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
    fs, at = files(spark, f"{path}/changes/batch={batch}/_BASE")
    fs.create(at, True).close()
