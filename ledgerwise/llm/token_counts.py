"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, sliced
from ledgerwise.llm.tokens import encoder

#: Lengths that are summed up together before sums run over all of them.
SPAN = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(length, n_docs)``: how many of ``docs(text)`` have how many tokens.

    Whole texts, without special tokens; null and empty texts have length 0.  Each task counts first, so what is shuffled
    is a row per task and length.
    """
    schema = T.StructType([T.StructField("length", T.LongType()), T.StructField("n", T.LongType())])
    target, made = to_arrow_schema(schema), encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = made().encode, Counter()
        for batch in sliced(batches):
            counts.update(len(ids) // 4 for ids in encode(batch.column("text").to_pylist()))
        columns = [list(counts), list(counts.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=target)

    return in_batches(docs.select("text"), run, schema).groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """``histogram`` with sums from each length on: ``length, n_docs, n_tokens, docs_from, tokens_from, kept_tokens, rank``.

    ``docs_from`` and ``tokens_from``: documents of that length or more, and their tokens.  ``kept_tokens``: what is left of
    the corpus if every document is cut to that length.  ``rank``: share of documents of that length or less.  Sums run
    within spans of ``SPAN`` lengths, and over the spans' totals: the one ordered task gets a row per span only.
    """
    tokens, span = F.col("length") * F.col("n_docs"), F.floor(F.col("length") / SPAN)
    rows = counts.select("length", "n_docs", tokens.alias("n_tokens"), span.alias("span"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = rows.groupBy("span").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    spans = totals.select(
        "span",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(before).alias("all_docs"),
        F.sum("tokens").over(before).alias("all_tokens"),
    )
    within = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns(
        {"docs_within": F.sum("n_docs").over(within), "tokens_within": F.sum("n_tokens").over(within)}
    ).join(spans, "span")
    docs_from, tokens_from = F.col("docs_within") + F.col("docs_after"), F.col("tokens_within") + F.col("tokens_after")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("length") * docs_from).alias("kept_tokens"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("rank"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_longer, kept_tokens, cut_tokens``, a row for each limit; zeros without documents."""
    parts = []
    for limit in limits:
        longer = F.col("length") > limit
        docs = F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0))
        whole = F.coalesce(F.sum("n_tokens"), F.lit(0))
        cut = F.coalesce(F.sum(F.when(longer, F.col("n_tokens") - limit * F.col("n_docs"))), F.lit(0))
        found = {"docs_longer": docs, "kept_tokens": whole - cut, "cut_tokens": cut}
        parts.append(F.struct(F.lit(limit).alias("context_limit"), *(v.alias(n) for n, v in found.items())))
    return sums.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("row")).select("row.*")


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest ``length`` that at least ``share`` of all documents do not exceed; null without documents."""
    return sums.where(F.col("rank") >= share).agg(F.min("length").alias("length"))
