"""From raw documents to packed training sequences, one written table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import decontaminate, language_id, packing, pii, simhash
from ledgerwise.llm.common import read_table
from ledgerwise.operators.joins import by_merge
from ledgerwise.shared import new_path, staged

#: SQL can express none of the learned stages; tests compare each with a brute-force version.
ORACLE_SQL = None
#: So many keys may be broadcast, some megabytes: files say too little of how many they hold.
FEW_KEYS = 100_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without letters, and null or empty ones, go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    marks = language_id.identify(docs.toDF(*(f"kept_{c}" for c in docs.columns)), model, text="kept_text")
    known = marks.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return known.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written once so that every later read has the same; its column's name."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, a hash chooses among rows of one id.

    Groups are of rows, so rows with one id, or without any, are kept or left out by their texts alone; a group names a
    row without id only if it has no other.
    """
    keyed, key = _keyed(docs)
    found = simhash.near_duplicates(keyed, words=4, max_distance=4, doc_id=key)
    found = found.select(F.col("doc_id").alias("found_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), F.col(key))
    ranked = keyed.select(F.col(key).alias("found_row"), order.alias("place")).join(by_merge(found), "found_row")
    first = ranked.groupBy("component_id").agg(F.min("place").getField(key).alias(key))
    return keyed.join(by_merge(first.select(key)), key, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their ids are.

    Texts are shuffled only if the rows to leave out are too many for a broadcast; those are counted.
    """
    keyed, key = _keyed(docs)
    named = keyed.select(F.col(key).alias("doc_id"), "text")
    found = decontaminate.contaminated(named, read_table(spark, sf_dir, "benchmark"))
    away = found.select(F.col("doc_id").alias(key)).distinct()
    if away.count() > FEW_KEYS:
        away = by_merge(away)
    return keyed.join(away, key, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; ``n_chars`` follows."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, 2048)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
