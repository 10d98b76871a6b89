"""The roles of the test tables: a paper is a document with a vector; its classes follow from the vector's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table

#: papers: doc_id, text, lang, journal, div, sub, main, conf, sim.
PAPERS_SQL = """(SELECT d.doc_id, d.text, d.lang, d.source AS journal, 'D' || e.label AS div, 'S' || (e.label // 2) AS sub,
  'M' || (e.label // 5) AS main, least(1.0, 4 * abs(e.embedding[1]::DOUBLE)) AS conf, least(1.0, 5 * abs(e.embedding[2]::DOUBLE)) AS sim,
  e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    label = F.col("label")
    part = lambda i, k: F.least(F.lit(1.0), k * F.abs(F.col("embedding")[i].cast("double")))
    return d.join(e, d.doc_id == e.vec_id).select(
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("journal"),
        F.concat(F.lit("D"), label).alias("div"),
        F.concat(F.lit("S"), F.floor(label / 2)).alias("sub"),
        F.concat(F.lit("M"), F.floor(label / 5)).alias("main"),
        part(0, 4).alias("conf"),
        part(1, 5).alias("sim"),
        "embedding",
    )


def order_key(col):
    """An order that looks random and is the same everywhere."""
    return F.md5(col.cast("string"))
