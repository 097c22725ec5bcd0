"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm.running import running_sums
from ledgerwise.operators.joins import salted_lookup
from ledgerwise.shared import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeated as often as needed (fixed value of the query).
WEIGHTS = (5, 2, 1)
#: Names of a document's place in the queue: by virtual finish time, then what tells rows apart.
PLACE = ["finish", "rank", "epoch", "shuffled", "size", "row"]


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row, doc_id, source, size, shuffled``, written once without texts: words of the text, and a hash that shuffles.

    The hash is of id and text alone, so the order is the same on every run and however the table is cut into files.
    """
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("shuffled"),
        ),
        "sizes",
    )


def with_targets(made: DataFrame, budget: int, repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: ``source, source_size, rank, before`` (sizes of the sources ahead of it) ``, target``.

    Sources come by code point, null last, and share ``budget`` words by weight; none gets more than ``repeats`` times
    its size, and what that leaves is shared again by the others until none is above.  Each round is one grouping.
    """
    sources = made.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(sources, [F.col("source").isNull(), "source"], ["one", "source_size"], "sources")
    rank = F.col("one_so_far") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = ranked.select(
        "source", "source_size", rank.alias("rank"), (F.col("source_size_so_far") - F.col("source_size")).alias("before"),
        weight.alias("weight"), (repeats * F.col("source_size")).alias("most"),
    )
    full, rate = -1, 0.0
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("most")
        row = ranked.agg(
            F.count_if(above).alias("full"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("most"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full, rate = row["full"], (budget - row["most"]) / row["weight"]
    target = F.when(above, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return ranked.select("source", "source_size", "rank", "before", target.alias("target"))


def finish(epoch: Column) -> Column:
    """Virtual finish time of a document's ``epoch``-th repetition: what its source has sent by then, over its target."""
    sent = epoch * F.col("source_size") + F.col("size_so_far") - F.col("before")
    return F.when(F.col("target") > 0, sent / F.col("target")).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    repeats: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, source, text)``: words of the document, of
    its source, the source's target, and the words that the mix takes of it (0 to ``repeats`` times its size).

    A source sends its documents in shuffled order, all of them again in each further epoch.  The queue of all sources is
    sorted by virtual finish time and cut before the document that would pass the budget, so each source ends within a
    document of its target.

    Null text: no words.  Null source: a source of its own, null id: a row like any other, repeated rows: as often as they
    occur.  Sources without words have target 0.  A table without rows gives none.  Other columns, whatever their names, are
    not read.
    """
    made = sized(docs, doc_id, source)
    budget = int((made.agg(F.sum("size")).first()[0] or 0) * Fraction(share))
    sources = staged(with_targets(made, budget, repeats, weights), "targets")
    placed = salted_lookup(made, sources, ["source"], "inner", null_safe=True)
    sent = staged(running_sums(placed, ["rank", "shuffled", "size", "row"], ["size"], "sent"), "sent")

    epochs = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    queue = running_sums(epochs.select(finish(F.col("epoch")).alias("finish"), *PLACE[1:]), [*PLACE], ["size"], "queue")
    last = queue.where(F.col("size_so_far") <= budget).agg(F.max(F.struct(*PLACE))).first()[0]

    taken = F.lit(0).cast("long")
    if last is not None:
        cut = F.struct(*(F.lit(last[c]).cast(queue.schema[c].dataType).alias(c) for c in PLACE))
        for epoch in range(repeats):
            here = {"finish": finish(F.lit(epoch)), "epoch": F.lit(epoch)}
            place = F.struct(*(here.get(c, F.col(c)).alias(c) for c in PLACE))
            taken += F.when(place <= cut, F.col("size")).otherwise(0)
    return sent.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
