"""Operator 13. Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found in each text by patterns: assignments, access keys, hexadecimal runs (the base, which always stays) and
other long tokens. Their values are known by a hash. One aggregation over the corpus counts, for each hash, the distinct
repositories (documents) and owners (sources) that hold it: an example that many owners have copied is told from a
credential that one or two owners hold. Other tokens become spans (`owned`) only if they look like credentials (letters and
digits, many different characters, no placeholder's word) and belong to MAX_OWNERS owners at most.

Counts are made of distinct (hash, owner, repository), then of owners, with partial sums before each shuffle, so a value
that a third of all rows hold meets in no task. Verdicts go back to the candidates by a join on the hash that adaptive
execution splits where a value is frequent. Only hashes, places and ids are moved, never texts or values.

Places: Spark has no function for the places of all matches, but splitting a text at a pattern gives the pieces between the
matches, so places are running sums of lengths (in n^1.5 steps within the row, for texts full of matches).

Defined results: a null or empty text has no spans; very long texts are scanned whole; a null id or owner counts as one of
its own; rows repeated with the same id each give a row and count as one repository; spans that start together are ordered
by kind, then by end; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Owners that a value may have and still be its owners' own.
MAX_OWNERS = 2
#: Different characters in a value that looks like a credential, at least.
VARIETY = 8

either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
NAMES = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx"


class Kind(NamedTuple):
    """Matches of `pattern` whose `group` has `least` characters at least, but not those that `unless` matches whole."""

    name: str
    pattern: str
    group: int
    least: int
    unless: str | None = None


#: Runs of hexadecimal digits and access keys are maximal, so their least length may stand in the pattern.
HEX, ACCESS = "[0-9a-f]{24,}", "AKIA[A-Z0-9]{16,}"
BASE = (Kind("assign", ASSIGN, 1, 6), Kind("access", ACCESS, 0, 20), Kind("hex", HEX, 0, 24))
FOUND = f"{ASSIGN.replace('([', '(?:[')}|{ACCESS}|{HEX}"
#: Long tokens that the base doesn't take.
TOKENS = Kind("owned", f"{FOUND}|[A-Za-z0-9+/_=-]{{20,}}", 0, 20, f"^(?:{FOUND})$")
KINDS = (*BASE, TOKENS)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x)


def running(sizes: Column) -> Column:
    """Running sums of an array that is not empty: sums of stretches of sqrt(n), then within each stretch."""

    def by(v: Column, c: Column) -> Column:
        count = F.floor((F.size(v) - 1) / c).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(v, b * c + 1, c))
        before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        within = lambda s, at: F.transform(s, lambda _, i: at + total(F.slice(s, F.lit(1), i + 1)))
        return once(stretches, lambda parts: F.flatten(F.zip_with(parts, once(F.transform(parts, total), before), within)))

    return once(sizes, lambda v: once(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda c: by(v, c)))


def looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= VARIETY
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike(PLACEHOLDER)


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """array of struct(start, kind, end, hash, live) of a kind: code points, the end exclusive."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    sizes = F.zip_with(found, gaps, lambda m, g: F.when(m.isNotNull(), g + F.length(m)))  # one gap more than matches
    ends = running(F.filter(sizes, lambda x: x.isNotNull()))
    span = lambda end, m: F.struct((end - F.length(m["m"])).alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.md5(m["v"]).alias("hash"), looks_live(m["v"]).alias("live"), m["m"].alias("m"), m["v"].alias("v"))
    every = F.zip_with(ends, F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), span)
    fits = lambda s: (F.length(s["v"]) >= kind.least) & (F.lit(True) if kind.unless is None else ~s["m"].rlike(kind.unless))
    kept = F.transform(F.filter(every, fits), lambda s: F.struct(*(s[x].alias(x) for x in ("start", "kind", "end", "hash", "live"))))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>")
    return F.when(text.rlike(kind.pattern), kept).otherwise(empty)


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """row, doc_id, owner, repository and spans for each row of `df`, written to the checkpoint folder: row numbers stay as
    they are, and texts are scanned once."""
    ensure_checkpoint_dir(df.sparkSession)
    ids = {"doc_id": id_col, "owner": owner_col, "repository": repository_col}
    source = df.select(*(F.col(c).alias(name) for name, c in ids.items()), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = [spans_of(F.col("text"), kind, i) for i, kind in enumerate(KINDS)]
    return source.select(F.monotonically_increasing_id().alias("row"), *ids, F.concat(*spans).alias("spans")).checkpoint()


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: how many hold each value."""
    values = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id and `found` for each row of `df`: array of struct(start, kind, end, live, example, repositories, owners) in
    order of start, kind, end. live: looks like a credential and has `max_owners` owners at most; example: has more."""
    found = candidates(df, id_col, text_col, owner_col, repository_col)
    rows = found.where(F.size("spans") > 0).select("row", "doc_id", F.explode("spans").alias("s"))
    held = ownership(found)
    judged = rows.withColumn("hash", F.col("s.hash")).join(held, "hash")
    example = F.col("owners") > max_owners
    span = F.struct("s.start", "s.kind", "s.end", (F.col("s.live") & ~example).alias("live"), example.alias("example"), "repositories", "owners")
    keep = (F.col("s.kind") < len(BASE)) | (F.col("s.live") & ~example)
    kept = judged.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(keep, span))).alias("found"))
    bare = found.where(F.size("spans") == 0).select("doc_id", F.array().cast(kept.schema["found"].dataType).alias("found"))
    return kept.select("doc_id", "found").unionByName(bare)


def secret_digest(df: DataFrame, **options) -> DataFrame:
    """Counts of the base's kinds, the hash of its spans, all spans, and how many are live, examples or added."""
    many = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda i: many(lambda s: s["kind"] == i)
    names = F.array(*(F.lit(k.name) for k in KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return secret_spans(df, **options).select(
        "doc_id",
        *(of_kind(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
        of_kind(len(BASE)).alias("n_owned"),
        many(lambda s: s["live"]).alias("n_live"),
        many(lambda s: s["example"]).alias("n_examples"),
    )


def oracle(max_owners: int = MAX_OWNERS) -> str:
    """The query in DuckDB's SQL."""
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for i, k in enumerate(KINDS):
        unless = f" AND NOT regexp_matches(m, '{quoted(k.unless)}')" if k.unless else ""
        parts.append(f"""
SELECT rid, doc_id, source, {i} AS kind, m, v, stop - length(m) AS start, stop FROM (
  SELECT rid, doc_id, source, unnest(ms) AS m, unnest(vs) AS v,
         unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))) AS stop
  FROM (SELECT rid, doc_id, source, regexp_extract_all(text, '{quoted(k.pattern)}') AS ms,
               regexp_extract_all(text, '{quoted(k.pattern)}', {k.group}) AS vs,
               string_split_regex(text, '{quoted(k.pattern)}') AS ps
        FROM t WHERE regexp_matches(text, '{quoted(k.pattern)}')))
WHERE length(v) >= {k.least}{unless}""")
    names = " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{k.name}" for i, k in enumerate(KINDS))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
held AS (SELECT v, count(*) AS owners FROM (SELECT DISTINCT v, source FROM found) GROUP BY v),
judged AS (
  SELECT f.*, regexp_matches(f.v, '[0-9]') AND regexp_matches(f.v, '[A-Za-z]') AND len(list_distinct(string_split(f.v, ''))) >= {VARIETY}
           AND NOT regexp_matches(f.v, '{PLACEHOLDER}') AND owners <= {max_owners} AS live, owners > {max_owners} AS example
  FROM found f JOIN held USING (v)),
spans AS (SELECT *, CASE kind {names} END || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM judged WHERE kind < {len(BASE)} OR live),
per AS (SELECT rid, {counts}, coalesce(string_agg(s, ',' ORDER BY start, kind, stop) FILTER (kind < {len(BASE)}), '') AS base,
               string_agg(s, ',' ORDER BY start, kind, stop) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_examples FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
       coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM t LEFT JOIN per USING (rid)
"""
