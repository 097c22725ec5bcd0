"""What the operators share: reading tables, folds, bounded samples, row-wise work in Arrow batches."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts handled together inside a task, in characters: what a batch needs of memory follows from it.
SLICE_CHARS = 4_000_000
BATCH_BYTES = 32 << 20
HASH_RANGE = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes too, so that long texts do not come together by the ten thousand.

    Sets the session's bound to ``BATCH_BYTES`` unless it has one.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def worker_memory(key: str, make: Callable):
    """A value that is made once in each Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("_worker_memory", ModuleType("_worker_memory")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def sampled(df: DataFrame, by: Column, counts: dict, bound: int) -> DataFrame:
    """About ``bound`` rows of each value of ``by``; ``counts`` has the rows of each.  Which rows depends on all columns
    only, so a retried task picks the same; the expected size holds however large the table is."""
    share = F.lit(0)
    for value, rows in counts.items():
        limit = HASH_RANGE if rows <= bound else math.ceil(HASH_RANGE * bound / rows)
        share = F.when(by.eqNullSafe(F.lit(value)), F.lit(limit)).otherwise(share)
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(HASH_RANGE)) < share)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_CHARS`` bytes of text (one row at least)."""
    for batch in batches:
        texts, start, size = batch.column(column), 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for row, length in enumerate(lengths):
            if size and size + length > SLICE_CHARS:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(length)
        if start < batch.num_rows:
            yield batch.slice(start)


def per_batch(
    df: DataFrame,
    work: Callable[[], Callable[[list], dict[str, list]]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` (default: all) and new ``fields`` that are computed from ``text`` alone; a new column takes
    the place of one that has its name, in upper or lower case.

    ``work()`` is called once in each task and returns a function from a list of texts to the new columns.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = work()
        for batch in sliced(batches, text):
            made = of_texts(batch.column(text).to_pylist())
            arrays = [batch.column(c).cast(target.field(c).type) for c in keep]
            arrays += [pa.array(made[f.name], target.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return in_batches(source, run, schema)
