"""Keyed writes as DataFrame operators: upsert, append-new, insert-ignore, per-field set, update-from.

They return the new content of the table; ``sources.store`` writes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import DOCUMENT_KEY, MOVEMENT_KEY
from ledgerwise.operators.joins import by_merge, keyed_join, membership, not_in, salted_lookup
from ledgerwise.operators.ranking import keep_last

REQUIRED = ("fecha", "unique_concept")


def _lacks_key(required: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in required])


def loadable(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows that can be keyed."""
    return df.filter(~_lacks_key(required))


def rejected(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows that cannot be keyed, with the first missing column as reason."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return df.filter(_lacks_key(required)).withColumn("missing", reason)


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str] = MOVEMENT_KEY, on_conflict: str = "update"
) -> DataFrame:
    """Target after inserting ``source``, NULL keys being equal; ``source`` holds one row per key.

    ``on_conflict="update"`` replaces rows whose key exists, ``"ignore"`` keeps them.
    """
    if on_conflict == "update":
        kept = keyed_join(target, by_merge(source.select(*keys)), keys, "left_anti", null_safe=True)
        return kept.unionByName(source, allowMissingColumns=True)
    if on_conflict == "ignore":
        return target.unionByName(not_in(source, target, keys), allowMissingColumns=True)
    raise ValueError(f"on_conflict must be 'update' or 'ignore', not {on_conflict!r}")


def load_counters(target: DataFrame, source: DataFrame, keys: Sequence[str] = MOVEMENT_KEY) -> DataFrame:
    """How many keys of ``source`` an upsert inserts and updates, and how many of the target it leaves alone."""
    action = (
        F.when(F.col("source") & F.col("target"), "updated").when(F.col("source"), "inserted").otherwise("untouched")
    )
    flags = membership({"target": target, "source": source}, keys)
    return flags.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n_keys"))


def append_new(target: DataFrame, source: DataFrame, columns: Sequence[str], file: str = "file_name") -> DataFrame:
    """Target plus the source rows whose ``columns`` it does not hold yet (NULLs equal)."""
    return target.unionByName(new_rows(target, source, columns, file), allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, columns: Sequence[str], file: str = "file_name") -> DataFrame:
    """The source rows whose ``columns`` the target does not hold yet (NULLs equal).

    Files count one after the other in name order: copies inside one file all go in, a row that an earlier file
    brought does not come again.
    """
    flags = target.select(*columns, F.lit(True).alias("_held"), F.lit(None).cast("string").alias("_first"))
    fresh = (
        source.select(*columns, F.lit(False).alias("_held"), F.col(file).alias("_first"))
        .unionByName(flags)
        .groupBy(*columns)
        .agg(F.max("_held").alias("_held"), F.min("_first").alias(file))
        .filter(~F.col("_held"))
        .drop("_held")
    )
    return keyed_join(source, by_merge(fresh), [*columns, file], "left_semi", null_safe=True)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catalogue plus the rows whose key is new; one row per new key."""
    return upsert(target, keep_last(rows, keys, []), keys, "ignore")


def update_from(
    df: DataFrame, edits: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Set ``columns`` on every row whose key has an edit; the last edit in ``order`` counts."""
    last = keep_last(edits, keys, order).select(
        *keys, F.lit(True).alias("_edited"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = salted_lookup(df, last, keys)
    updated = {c: F.when(F.col("_edited"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(updated).select(*df.columns)


def classify(concepts: DataFrame, edits: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Manual classification by (fecha, unique_concept): all amounts that share it change; blank beneficiary is NULL.

    Edits without group or subgroup are not accepted.
    """
    accepted = edits.filter((F.col("category_group") != "") & (F.col("category_subgroup") != "")).withColumn(
        "beneficiario", F.nullif(F.col("beneficiario"), F.lit(""))
    )
    columns = ("category_group", "category_subgroup", "beneficiario")
    return update_from(concepts, accepted, MOVEMENT_KEY[:2], columns, order)


def rename_cascade(df: DataFrame, renames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Follow a parent rename: ``renames`` holds ``columns`` and their ``new_`` values, one of them if a parent repeats."""
    last = keep_last(renames, columns, [f"new_{c}" for c in columns])
    edits = last.select(
        *columns, F.lit(True).alias("_hit"), *[F.col(f"new_{c}").alias(f"_new_{c}") for c in columns]
    )
    joined = salted_lookup(df, edits, columns)
    renamed = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(renamed).select(*df.columns)


def delete_set_null(df: DataFrame, deleted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Follow a parent deletion: the reference becomes NULL, the row stays."""
    joined = salted_lookup(df, deleted.select(*columns).distinct().withColumn("_hit", F.lit(True)), columns)
    cleared = {c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}
    return joined.withColumns(cleared).select(*df.columns)


def delete_cascade(df: DataFrame, deleted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Follow a parent deletion: the rows go with it."""
    return keyed_join(df, deleted.select(*columns), columns, "left_anti")


# what a document row may hold of a payload: the bytes, or their hash and length in the payload store
PAYLOADS = ("pdf_file", "csv_file", "pdf_filename", "csv_filename")
REFERENCES = ("pdf_hash", "pdf_length", "csv_hash", "csv_length", "pdf_filename", "csv_filename")


def _payload_columns(documents: DataFrame, incoming: DataFrame) -> list[str]:
    names = dict.fromkeys((*PAYLOADS, *REFERENCES))
    return [c for c in names if c in documents.columns and c in incoming.columns]


def document_upsert(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or set documents field by field: an absent payload leaves the stored one alone.

    Works on bytes and on references; give it references, and no bytes go through its join.
    """
    payloads = _payload_columns(documents, incoming)
    new = incoming.select(
        *[F.col(k).alias(f"_new_{k}") for k in DOCUMENT_KEY],
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in ("updated_at", *payloads)],
    )
    matches = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_new_{k}") for k in DOCUMENT_KEY])
    both = documents.join(new, matches, "full")
    filled = {c: F.coalesce(f"_new_{c}", c) for c in (*DOCUMENT_KEY, *payloads)}
    filled["updated_at"] = F.when(F.col("_hit"), F.col("_new_updated_at")).otherwise(F.col("updated_at"))
    return both.withColumns(filled).select(*documents.columns)


def document_attach(documents: DataFrame, files: DataFrame, run_ts: Column) -> DataFrame:
    """Set the payload of documents that exist; ``files`` holds the key, and payloads or references and names, one row per
    key."""
    payloads = _payload_columns(documents, files)
    new = files.select(*DOCUMENT_KEY, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in payloads])
    joined = keyed_join(documents, new, DOCUMENT_KEY)
    filled = {c: F.coalesce(f"_new_{c}", c) for c in payloads}
    filled["updated_at"] = F.when(F.col("_hit"), run_ts).otherwise(F.col("updated_at"))
    return joined.withColumns(filled).select(*documents.columns)


def unmatched_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose document does not exist."""
    return keyed_join(files, documents.select(*DOCUMENT_KEY), DOCUMENT_KEY, "left_anti")
