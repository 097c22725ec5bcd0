"""What each quality filter removes in every order of the filters: sorted posting lists, merged by galloping.

A filter's posting list holds the rows that fail it, ascending.  Lists are kept for each part and each range of row
numbers, so that no list is longer than ``RANGE`` and none is ever gathered in one place.  Unions and differences are
merged within a range; their sizes add up over the ranges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, sliced
from ledgerwise.shared import staged

#: The filters, in the order of their bits (fixed values).
FILTERS = "ABCDE"
_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Row numbers of a range: 2 to this power.
RANGE_BITS = 16
_COPY, _FIRST, _GOOD, _TOXIC = 4, 5, 6, 7

SIZES = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("letter", T.IntegerType()),
        T.StructField("before", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("gone", "removed", "redundant", "good_lost", "toxic_lost")),
    ]
)


# --- merging ---------------------------------------------------------------------------------------------------------
def seek(ids: list[int], key: int, at: int) -> int:
    """First place from ``at`` on whose id is not below ``key``: steps double until they pass it, then the last is halved."""
    step, end = 1, len(ids)
    while at + step < end and ids[at + step] < key:
        at += step
        step *= 2
    return bisect_left(ids, key, at, min(end, at + step + 1))


def union(lists: list[list[int]]) -> list[int]:
    """All ids of ascending lists, ascending: the list with the smallest head gives its run up to the next head."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    out: list[int] = []
    while heads:
        _, k, at = heappop(heads)
        ids = lists[k]
        stop = seek(ids, heads[0][0], at) if heads else len(ids)
        out += ids[at:stop]
        stop += stop == at  # the next list has this id too
        if stop < len(ids):
            heappush(heads, (ids[stop], k, stop))
    return out


def difference(ids: list[int], away: list[int]) -> list[int]:
    """Ids of the first ascending list that the second does not hold, ascending."""
    out: list[int] = []
    at = place = 0
    while at < len(ids):
        place = seek(away, ids[at], place)
        if place == len(away):
            return out + ids[at:]
        if away[place] == ids[at]:
            at += 1
        else:
            stop = seek(ids, away[place], at)
            out += ids[at:stop]
            at = stop
    return out


def sizes(lists: list[list[int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each list and each set of other lists (as a bit mask) that come before it: how many ids are in any of them
    all, in the list alone, and in the list and a list before it."""
    unions = [union([x for k, x in enumerate(lists) if mask >> k & 1]) for mask in range(1 << len(lists))]
    made = {}
    for k, ids in enumerate(lists):
        for before, gone in enumerate(unions):
            if not before >> k & 1:
                removed = len(difference(ids, gone))
                made[k, before] = len(unions[before | 1 << k]), removed, len(ids) - removed
    return made


# --- the five filters ------------------------------------------------------------------------------------------------
def _fails(raw: bytes, points: int) -> int:
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * points) << 2
        | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3
    )


def facts(docs: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """One written row per row of ``docs``: ``row`` (a number of its own), ``doc_id, part, bits`` of the filters that a text
    fails by itself, and the ``digest`` of the text.  Null texts count as empty, null parts as the empty string."""
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("bits", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            points = pa.compute.utf8_length(batch.column("text")).to_pylist()
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            arrays = [batch.column(f.name).cast(target.field(f.name).type) for f in kept]
            arrays += [
                pa.array(map(_fails, raws, points), pa.int32()),
                pa.array([hashlib.sha256(raw).digest() for raw in raws], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return staged(in_batches(source, run, schema), "facts")


def first_of_copies(made: DataFrame) -> DataFrame:
    """``(row, part)`` of the rows whose text no smaller id has.

    One grouping by the text's digest, combined before the shuffle, so a text that a third of all rows share costs a row
    a task.  It names one row for the smallest id of a text; rows that repeat that id and that text are found by a join
    that runs only if there are any.
    """
    known = made.where("doc_id IS NOT NULL")
    one = known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "row", "part")).alias("low"),
        F.min(F.struct("doc_id", (-F.col("row")).alias("turned"))).alias("high"),
    )
    one = staged(one.select("digest", "low.*", (F.col("low.row") != -F.col("high.turned")).alias("again")), "firsts")
    found = one.where("NOT again").select("row", "part")
    again = one.where("again").select("digest", "doc_id")
    if again.isEmpty():
        return found
    return found.union(known.join(again, ["digest", "doc_id"]).select("row", "part"))


def labelled_rows(made: DataFrame, labels: DataFrame) -> DataFrame:
    """``(row, part, bits)`` of rows that any label of their id calls good (quality 1) or toxic (1)."""
    bits = F.max((F.col("quality") == 1).cast("int")) * (1 << _GOOD) + F.max((F.col("toxic") == 1).cast("int")) * (1 << _TOXIC)
    flags = labels.where("doc_id IS NOT NULL").fillna(0, ["quality", "toxic"]).groupBy("doc_id").agg(bits.alias("bits"))
    return made.select("row", "part", "doc_id").join(flags.where("bits > 0"), "doc_id").select("row", "part", "bits")


# --- posting lists ---------------------------------------------------------------------------------------------------
def posting_lists(marks: DataFrame, names: dict[str, int]) -> DataFrame:
    """``part, range`` and for each name the ascending ``row`` numbers whose ``bits`` have the bit of that name.

    ``marks(row, part, bits)`` may have several rows with bits of one row number, each bit once.  Groups hold the rows of
    one part within one range of 65,536 row numbers, whatever share of the table the part has.  Written once.
    """
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("bits").bitwiseAND(1 << bit) != 0, F.col("row")))).alias(name)
        for name, bit in names.items()
    ]
    return staged(marks.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range")).agg(*lists), "postings")


def _sizes_of_ranges(lists: DataFrame) -> DataFrame:
    """``SIZES`` of every part and range."""
    target = to_arrow_schema(SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                plain = [row[c] for c in FILTERS[:-1]]
                plain.append(difference(row["known"], row["first"]))
                parted = [[difference(x, difference(x, row[only])) for x in plain] for only in ("good", "toxic")]
                every, good, toxic = map(sizes, (plain, *parted))
                rows = [(row["part"], *key, *every[key], good[key][1], toxic[key][1]) for key in every]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return in_batches(lists, run, SIZES)


def _orders() -> list[tuple]:
    """Every order of the filters, step by step: ``filter_order, step, letter, before``."""
    made = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, letter in enumerate(order, 1):
            made.append((name, step, letter, before))
            before |= 1 << letter
    return made


def _orders_with(before: Column) -> Column:
    """Orders in which a filter comes right after the filters of a mask."""
    counts = [bin(m).count("1") for m in range(1 << len(FILTERS))]
    ways = [factorial(n) * factorial(max(0, len(FILTERS) - 1 - n)) for n in counts]
    return F.element_at(F.array(*map(F.lit, ways)), before + 1)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """What each of the five ``FILTERS`` does at its step of each order, in each part of ``docs(doc_id, text, <part>)``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, 600 rows a part,
    zeros included.  A: fewer than 50 words; B: fewer than 65 distinct words in 100; C: more than 5 capitals in 100 code
    points; D: a sign of ``#$%&*|``; E: the text of a row with a smaller id.

    Rows count as often as they occur.  Null text: empty.  Null id: has no smaller one and is none, so E passes it and no
    label is its own.  Several labels of an id: one that says 1 is enough.  A table without rows gives none.  Other
    columns, whatever their names, are not read.
    """
    made = facts(docs, doc_id, part)
    own = F.col("bits") + F.col("doc_id").isNotNull().cast("int") * (1 << _COPY)
    marks = made.select("row", "part", own.alias("bits"))
    marks = marks.union(first_of_copies(made).select("row", "part", F.lit(1 << _FIRST)))
    marks = marks.union(labelled_rows(made, labels))
    names = {c: k for k, c in enumerate(FILTERS[:-1])} | {"known": _COPY, "first": _FIRST, "good": _GOOD, "toxic": _TOXIC}
    found = _sizes_of_ranges(posting_lists(marks, names))

    counted = [c for c in SIZES.names if c not in ("part", "letter", "before")]
    sums = staged(found.groupBy("part", "letter", "before").agg(*(F.sum(c).alias(c) for c in counted)), "sizes")
    others = F.element_at(F.array(*(F.lit((1 << len(FILTERS)) - 1 - (1 << k)) for k in range(len(FILTERS)))), F.col("letter") + 1)
    each = sums.groupBy("part", "letter").agg(
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * _orders_with(F.col("before"))).alias("shapley"),
    )
    rows = made.groupBy("part").agg(F.count("*").alias("rows"))
    orders = docs.sparkSession.createDataFrame(_orders(), "filter_order string, step int, letter int, before int")
    table = sums.join(each, ["part", "letter"]).join(rows, "part")
    table = table.join(F.broadcast(orders), ["letter", "before"])  # 600 rows
    return table.select(
        "part", "filter_order", "step", (F.col("rows") - F.col("gone")).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
