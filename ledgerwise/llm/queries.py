"""Registered queries of the operators: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import (
    centroids,
    decontaminate,
    filter_audit,
    language_id,
    mixing,
    oracle,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_tree,
    token_counts,
    toxicity,
)
from ledgerwise.llm.common import fold, read_table
from ledgerwise.llm.text_stats import with_stats
from ledgerwise.shared import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {
    "op11_posting_list_audit": oracle.FILTER_AUDIT,
    "op12_equal_variance_clustering": oracle.clustering(size=64, scale=256, count=40, rounds=5, salt="2"),
    "op13_fair_queue_mixing": oracle.mixing(weights=mixing.WEIGHTS, rounds=24),
}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


@query
def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned outside fold 1 of 3."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    made = language_id.identify(docs, model, keep=["doc_id"])
    return made.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by encoded length, with sums from each length on."""
    return token_counts.suffix_sums(token_counts.histogram(documents(spark, sf_dir)))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or paraphrased."""
    return decontaminate.contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), 2048)


@query
def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents to keep; cutoffs by language, learned from all quality labels."""
    docs = documents(spark, sf_dir, "doc_id", "text", F.col("lang").alias("stratum"))
    counts = staged(with_stats(docs, keep=["doc_id", "stratum"]), "counts")
    made = quality_rules.judged(counts, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return made.select(*wanted)


@query
def op7_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and suffix-tree scores of all documents; learned outside fold 2 of 7."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row_key")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", place)
    made = suffix_tree.scored(docs, fold(F.col("doc_id"), 7) != 2, row_key="row_key")
    wanted = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return made.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), *wanted)


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over four words, linked within four bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, max_distance=4)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned outside fold 1 of 3."""
    docs = documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    train = toxicity.training_rows(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    made = toxicity.scored(docs, toxicity.fit(train), keep=["doc_id"])
    return made.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op10_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; learned outside fold 1 of 3."""
    counts = staged(with_stats(documents(spark, sf_dir), keep=["doc_id"]), "counts")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train = counts.join(labels.where(fold(F.col("doc_id"), 3) != 1), "doc_id")
    made = quality_classifier.scored(counts, quality_classifier.fit(train), ["doc_id"])
    return made.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op11_posting_list_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in each source and each order of the filters."""
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "text", "source"), read_table(spark, sf_dir, "labels"))


@query
def op12_equal_variance_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all vectors of 64 components, after five rounds."""
    return centroids.clustered(read_table(spark, sf_dir, "embeddings"))


@query
def op13_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each, 150% of all words by source weights 5, 2, 1."""
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"))
