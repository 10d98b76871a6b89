"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, fill_in_middle, quality_rules, secret_scan, url_filters
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .quality_classifier import quality_scores, train

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(documents, labels.where(~held_out(labels.doc_id, 5, 0)))
    found = quality_scores(documents, machine)
    return found.select("doc_id", held_out(found.doc_id, 5, 0).alias("held_out"), "score", "predicted")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, predict

    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out(documents.doc_id, 4, 2)))
    found = predict(documents, model)
    return found.select("doc_id", held_out(found.doc_id, 4, 2).alias("held_out"), "lang_pred", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .lm_scoring import lm_scores

    documents = table(spark, sf_dir, "documents")
    found = lm_scores(documents, ~held_out(documents.doc_id, 7, 2))
    return found.select(
        "doc_id", (~found.training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_collocations": op12_collocations,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.oracle(),
    "op8_url_filters": url_filters.oracle(),
    "op11_fill_in_middle": fill_in_middle.oracle(),
    "op12_collocations": collocations.oracle(),
    "op13_secret_scan": secret_scan.oracle(),
}
