"""Running sums over a whole table in a given order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches
from ledgerwise.shared import staged


def running_sums(df: DataFrame, order: list[str | Column], amounts: list[str], label: str) -> DataFrame:
    """``df`` and, for each of its columns ``amounts`` (longs, none null), the sum up to and with each row, as
    ``<name>_so_far``; written once.

    The rows are dealt by ranges of ``order``, which may cut any group, and summed range by range; what the driver sees is
    a sum per range.  ``order`` should tell rows apart: the sums then are the same on a retry, and no value is too common
    for a range.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{a}_so_far", T.LongType()) for a in amounts), T.StructField("block", T.IntegerType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reached = TaskContext.get().partitionId(), dict.fromkeys(amounts, 0)
        for batch in batches:
            arrays = list(batch.columns)
            for a in amounts:
                sums = reached[a] + np.cumsum(batch.column(a).to_numpy(zero_copy_only=False), dtype=np.int64)
                reached[a] = int(sums[-1]) if len(sums) else reached[a]
                arrays.append(pa.array(sums))
            arrays.append(pa.array(np.full(batch.num_rows, block, np.int32)))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, target)], schema=target)

    made = staged(in_batches(df.repartitionByRange(*order).sortWithinPartitions(*order), run, schema), label)
    totals = made.groupBy("block").agg(*(F.sum(a).alias(a) for a in amounts)).orderBy("block").collect()
    if not totals:
        return made.drop("block")
    before = [accumulate([0, *(r[a] for r in totals)]) for a in amounts]
    offsets = df.sparkSession.createDataFrame(
        [(r["block"], *x) for r, *x in zip(totals, *before)], "block int, " + ", ".join(f"before_{k} long" for k in range(len(amounts)))
    )
    found = made.join(F.broadcast(offsets), "block")  # a row a range, no more than there are shuffle partitions
    sums = {f"{a}_so_far": F.col(f"{a}_so_far") + F.col(f"before_{k}") for k, a in enumerate(amounts)}
    return found.select(*df.columns, *(c.alias(n) for n, c in sums.items()))
