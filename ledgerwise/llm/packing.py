"""Packing of documents into sequences: bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, sliced
from ledgerwise.llm.tokens import encoder
from ledgerwise.shared import staged

END_ID = 0
PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PLACES = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
#: Sequence ids of one task start at its number times this.
IDS_PER_TASK = 1 << 40


class OpenBins:
    """A fixed number of open bins, kept by free space: a bitset says which amounts of free space occur.

    ``place`` puts an item into the bin with the least sufficient free space and opens a bin if there is none; if too many
    are open, the fullest closes first.  Equal free space: the bin that has waited longest.
    """

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.bins = capacity, bins
        self.free: list[deque] = [deque() for _ in range(capacity + 1)]
        self.occurs, self.open, self.made = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """Number of the bin and the offset in it."""
        fitting = self.occurs >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.occurs |= 1 << left
            self.open += 1
            if self.open > self.bins:
                self._take((self.occurs & -self.occurs).bit_length() - 1)
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.free[space].popleft()
        if not self.free[space]:
            self.occurs &= ~(1 << space)
        self.open -= 1
        return number


def token_pieces(docs: DataFrame, capacity: int, path: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids are those of its whole text and then ``END_ID``; null is an empty text.  Only documents longer than
    ``capacity`` are cut.
    """
    made, source = encoder(path), docs.select(F.col(doc_id).alias("doc_id"), "text")
    schema = T.StructType([source.schema["doc_id"], *PIECES.fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = made().encode
        for batch in sliced(batches):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * len(target)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return in_batches(source, run, schema)


def place(pieces: DataFrame, capacity: int, bins: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length``, each partition packed in its order by itself."""
    schema = T.StructType([*pieces.schema.fields, *PLACES])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = OpenBins(capacity, bins), TaskContext.get().partitionId() * IDS_PER_TASK
        for batch in batches:
            found = np.array([packer.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            arrays = [*batch.columns, pa.array(base + found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return in_batches(pieces, run, schema)


def pack(
    docs: DataFrame, capacity: int = 2048, bins: int = 1024, per_task: int = 500_000, path: str | None = None
) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces are written once with a hash of their place, by which they are dealt evenly and come to each task's packer in no
    order of length: bins are closed when full, not when only long pieces have been seen.  ``bins`` bounds a packer's
    memory, ``per_task`` its rows: the number of tasks follows from the number of pieces, and all that is lost by packing
    apart is what a task's last bins leave.  The hash is stored, so a retried task packs the same way, and rows that repeat
    are dealt apart.  Repeated rows are packed as often as they occur.
    """
    made = token_pieces(docs, capacity, path).withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    pieces = staged(made, "pieces")
    tasks = max(1, -(-pieces.count() // per_task))
    ordered = pieces.repartition(tasks, "turn").sortWithinPartitions("turn")
    return place(ordered, capacity, bins).drop("turn")

