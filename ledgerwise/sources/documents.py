"""Statement documents: binary files, the store that keeps their bytes, and the narrow table that refers to them.

Bytes never move between tasks.  A file is read where its hash is computed; what goes through joins is the hash.  The
payload store holds every content once, under its hash, and is only ever added to; document rows name the hash and the
length of their PDF and CSV.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.contracts import DOCUMENT_KEY, DOCUMENTS
from ledgerwise.functions.text import is_present
from ledgerwise.operators.joins import by_merge, not_in
from ledgerwise.operators.keyed import REFERENCES
from ledgerwise.operators.manifests import parse_document_names
from ledgerwise.shared import staged
from ledgerwise.sources import versions
from ledgerwise.sources.files import file_name_of, list_files, load_paths, paths_of

_text, _long, _flag = T.StringType(), T.LongType(), T.BooleanType()
PAYLOAD_STORE = T.StructType([T.StructField("content_hash", _text), T.StructField("content", T.BinaryType())])
# documents as they are stored: references and flags in place of bytes
STORED_DOCUMENTS = T.StructType(
    [
        *[f for f in DOCUMENTS.fields if not isinstance(f.dataType, T.BinaryType)],
        *[T.StructField(f"{p}_{c}", kind) for p in ("pdf", "csv") for c, kind in (("hash", _text), ("length", _long))],
        *[T.StructField(f"has_{p}", _flag) for p in ("pdf", "csv")],
    ]
)


def newest_of_each_name(files: DataFrame) -> DataFrame:
    """Listed files, the newest (then the first path) of those that share a name."""
    order = F.struct(-F.unix_micros("file_modification_time"), "file_path")
    chosen = files.groupBy("file_name").agg(F.min_by(F.struct(*files.columns), order).alias("file"))
    return chosen.select("file.*")


def _read_bytes(spark: SparkSession, files: DataFrame, columns: dict[str, Column], schema: str) -> DataFrame:
    """``file_path`` and ``columns`` of the listed files, and of no others; none is opened whose bytes no column needs."""
    paths = paths_of(files)
    if not paths:
        return spark.createDataFrame([], f"file_path string, {schema}")
    path = F.col("_metadata.file_path").alias("file_path")
    return load_paths(spark.read.format("binaryFile"), paths, path, *[c.alias(n) for n, c in columns.items()])


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", wanted: DataFrame | None = None) -> DataFrame:
    """Files with their bytes, the newest (then the first path) of those that share a name; only those whose ``file_name`` is
    in ``wanted``, if that is given.  The listing tells which they are; the others are not opened."""
    files = newest_of_each_name(list_files(spark, folder, pattern))
    if wanted is not None:
        files = files.join(wanted.select("file_name"), "file_name", "left_semi")
    columns = {
        "file_name": file_name_of(F.col("_metadata.file_path")),
        "file_modification_time": F.col("_metadata.file_modification_time"),
        "length": F.col("length"),
        "content": F.col("content"),
    }
    schema = "file_name string, file_modification_time timestamp, length long, content binary"
    return _read_bytes(spark, files, columns, schema).drop("file_path")


def keep_payloads(spark: SparkSession, files: DataFrame, store: str) -> DataFrame:
    """Bring the content of listed files into the payload store; ``file_name, content_hash, content_length`` of each.

    Files are read once for their hash, and those whose content the store lacks once more to be written, one file for each
    content.  A run that is repeated finds what it has written and adds nothing.
    """
    files = staged(files, "payload-files")
    hashed = {"content_hash": F.sha2("content", 256), "content_length": F.col("length")}
    known = staged(_read_bytes(spark, files, hashed, "content_hash string, content_length long"), "hashes")
    fresh = not_in(known.groupBy("content_hash").agg(F.min("file_path").alias("file_path")), held_hashes(spark, store), ["content_hash"])
    to_write = staged(files.join(by_merge(fresh.select("file_path")), "file_path", "left_semi"), "fresh-files")
    if not to_write.isEmpty():
        content = {"content_hash": F.sha2("content", 256), "content": F.col("content")}
        rows = _read_bytes(spark, to_write, content, "content_hash string, content binary").drop("file_path")
        versions.append(rows.withColumn(versions.PART, F.lit(versions.WHOLE)), store)
        if not not_in(known.select("content_hash"), held_hashes(spark, store), ["content_hash"]).isEmpty():
            raise RuntimeError("files changed while they were read; run again")
    return files.select("file_path", "file_name").join(by_merge(known), "file_path").drop("file_path")


def held_hashes(spark: SparkSession, store: str) -> DataFrame:
    """Hashes in the payload store; the bytes are not read."""
    schema = T.StructType(PAYLOAD_STORE.fields[:1])
    found = versions.read(spark, store, schema)
    return spark.createDataFrame([], schema) if found is None else found.drop(versions.PART)


def payloads(spark: SparkSession, store: str, hashes: list[str]) -> DataFrame:
    """``content_hash, content`` of some payloads."""
    found = versions.read(spark, store, PAYLOAD_STORE)
    found = spark.createDataFrame([], PAYLOAD_STORE) if found is None else found.drop(versions.PART)
    return found.filter(F.col("content_hash").isin(hashes))


def by_reference(documents: DataFrame) -> DataFrame:
    """Documents with the hash and the length of their payloads in place of the bytes."""
    made = {}
    for part in ("pdf", "csv"):
        made |= {f"{part}_hash": F.sha2(f"{part}_file", 256), f"{part}_length": F.length(f"{part}_file").cast("long")}
    return with_stored_flags(documents.withColumns(made)).drop("pdf_file", "csv_file")


def keyed_payloads(files: DataFrame, extension: str) -> DataFrame:
    """Binary files as document payload columns, keyed by their name."""
    keyed = parse_document_names(files, extension)
    columns = {f"{part}_{c}": F.lit(None).cast(t) for part in ("pdf", "csv") for c, t in (("file", "binary"), ("filename", "string"))}
    columns |= {f"{extension}_file": F.col("content"), f"{extension}_filename": F.col("file_name")}
    return keyed.select(*DOCUMENT_KEY, *[c.alias(n) for n, c in columns.items()])


def keyed_references(kept: dict[str, DataFrame]) -> DataFrame:
    """Kept payloads (by extension) as reference columns, one row per document that has a PDF, a CSV or both."""
    whole = [STORED_DOCUMENTS[c] for c in ("pdf_filename", "pdf_hash", "pdf_length")]
    nothing = F.lit(None).cast(T.StructType([T.StructField(f.name.removeprefix("pdf_"), f.dataType) for f in whole]))
    parts = []
    for extension, files in kept.items():
        one = F.struct(F.col("file_name").alias("filename"), F.col("content_hash").alias("hash"), F.col("content_length").alias("length"))
        columns = [(one if part == extension else nothing).alias(part) for part in ("pdf", "csv")]
        parts.append(parse_document_names(files, extension).select(*DOCUMENT_KEY, *columns))
    both = reduce(DataFrame.unionByName, parts).groupBy(*DOCUMENT_KEY).agg(F.max("pdf").alias("pdf"), F.max("csv").alias("csv"))
    return both.select(*DOCUMENT_KEY, *[F.col(c.replace("_", ".", 1)).alias(c) for c in REFERENCES])


def with_stored_flags(documents: DataFrame) -> DataFrame:
    """Documents with the presence flags as columns, so that later scans can skip the payloads."""
    flags = {
        f"has_{part}": F.coalesce(F.col(f"{part}_length") > 0, F.lit(False))
        if f"{part}_length" in documents.columns
        else is_present(F.col(f"{part}_file"))
        for part in ("pdf", "csv")
    }
    return documents.withColumns(flags)
