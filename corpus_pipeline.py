"""The corpus pipeline: quality rules, near-duplicates, repeated passages, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents, and
no other column than doc_id, text and n_chars is looked at, whatever its name.

Defined results, for every stage: an empty table gives an empty table. A row is known by its doc_id and its text, so
documents that share an id, or have none, are judged each by its own text.

- quality_rules: a null or empty text has no words and goes; repeated rows are judged alike.
- simhash_dedup: of each group the row with the smallest doc_id stays (ties: the least hash of id and text), null ids
  last; of rows that repeat id and text one stays; null and empty texts are one group.
- suffix_dedup: a null text becomes empty; rows of one id keep what they share; a null id comes after all others;
  a text of nothing but repeated passages stays as an empty one; n_chars follows the text.
- decontamination: null and empty texts hold no item; every row that holds one goes, repeated rows alike.
- bpe_codec: a null or empty text has no tokens; each row gives a row.

Very long texts are taken whole by all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe_codec import encode_digest
from quarry.llm.common import ensure_checkpoint_dir, table
from quarry.llm.decontamination import contaminated
from quarry.llm.quality_rules import keep_good
from quarry.llm.simhash_dedup import near_duplicates
from quarry.llm.suffix_dedup import remove_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return keep_good(docs)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of id and text, and the name of its column, which `docs` lacks."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, by op6's rule (3-word shingles,
    3 of 64 bits): exact copies go, most copies with edits stay (figures in the README)."""
    rows, key = keyed(docs)
    groups = near_duplicates(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = rows.select("doc_id", key).distinct().join(groups, key)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    kept = rows.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that a document with a smaller id has as well; n_chars follows the text."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    rows, key = keyed(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", near_dedup_stage),
    ("suffix_dedup", passage_stage),
    ("decontamination", decontamination_stage),
    ("bpe_codec", token_stage),
]

#: Near-duplicate components and byte-pair merges can't be written in SQL; a test holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is checkpointed in the shared folder, as the next
    stage reads it more than once."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
