"""Language-model scores by a probabilistic suffix tree over bytes, beside a word model with add-one counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, sliced
from ledgerwise.shared import staged

#: Stands for the end of a text; no byte of UTF-8.
END = 0xFF
#: Bytes of text that make a block: words are counted and looked up, and texts scored, block by block.
BLOCK_BYTES = 6 << 20
_STREAM = 1 << 20
_ROW = 1024

WORDS = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]
)
GRAMS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def lowered(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text with A-Z lower-cased; null: empty."""
    return [(x or "").encode("utf-8", "replace").lower() for x in texts.to_pylist()]


def streams(texts: list[bytes], size: int = _STREAM):
    """Runs of texts of about ``size`` bytes: (index of the first, texts)."""
    at, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(text) + 1
    if at < len(texts):
        yield at, texts[at:]


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text, and its end, with the ``depth`` bytes before it, packed into a number; and their counts.

    Before a text stand ``depth`` ends, so that contexts know where a text begins and never reach into the one before.
    """
    found = []
    for _, run in streams(texts):
        pad = bytes([END]) * depth
        raw = np.frombuffer(b"".join(chain.from_iterable((pad, x, b"\xff") for x in run)), np.uint8)
        packed = np.zeros(len(raw) - depth, np.int64)
        for k in range(depth + 1):
            packed = (packed << 8) | raw[k : len(raw) - depth + k]
        lengths = np.array([len(x) + 1 for x in run])
        starts = np.cumsum(lengths + depth) - lengths - depth
        keep = np.zeros(len(raw) + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, starts + lengths, -1)
        found.append(np.unique(packed[np.cumsum(keep)[: len(packed)] > 0], return_counts=True))
    return _merged(found)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*found))
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, counts, len(distinct)).astype(np.int64)


def gather_words(blocks: DataFrame) -> DataFrame:
    """Words of each block with their number in its training texts, 0 if only others have them.

    ``blocks(block, text, train)``.
    """
    target = to_arrow_schema(WORDS)

    def of_block(table: pa.Table) -> pa.Table:
        block, train = table.column("block")[0].as_py(), table.column("train").to_pylist()
        words: Counter = Counter()
        for text, learn in zip(lowered(table.column("text")), train):
            if learn:
                words.update(text.split())
            else:
                for word in set(text.split()):
                    words.setdefault(word, 0)
        counts = pa.array(words.values(), pa.int64())
        blocks = pa.array(np.full(len(words), block, np.int32))
        return pa.Table.from_arrays([blocks, pa.array(words.keys(), pa.binary()), counts], schema=target)

    return blocks.groupBy("block").applyInArrow(of_block, WORDS)


def gather_grams(docs: DataFrame, depth: int, pending: int = 4_000_000) -> DataFrame:
    """``(gram, n)`` of all ``docs(text)``, summed up within each task whenever ``pending`` rows have come together."""
    target = to_arrow_schema(GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for batch in sliced(batches):
            found.append(grams(lowered(batch.column("text")), depth))
            if sum(len(k) for k, _ in found) > pending:
                found = [_merged(found)]
                if len(found[0][0]) > pending // 2:
                    yield from _rows(found.pop(), target)
        yield from _rows(_merged(found), target)

    return in_batches(docs.select("text"), run, GRAMS)


def _rows(table: tuple[np.ndarray, np.ndarray], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(table[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in table], schema=target)


def contexts(counted: DataFrame, depth: int, least_share: float, least_gain: float) -> DataFrame:
    """Retained contexts with their next-byte counts: ``level, context, symbol, n``.

    A context is retained if it makes up ``least_share`` of all positions and if its next-byte distribution differs from
    that of the context one byte shorter: counts times Kullback-Leibler divergence, in nats, of at least ``least_gain``
    (the likelihood-ratio test).  At most ``depth / least_share`` contexts can pass, however large the corpus is.
    """
    levels = F.explode(F.array(*map(F.lit, range(depth + 1)))).alias("level")
    part = counted.select("gram", "n", levels).select(
        "level",
        F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * level) - 1)").alias("context"),
        F.expr("cast(gram & 255 as int)").alias("symbol"),
        "n",
    )
    table = staged(part.groupBy("level", "context", "symbol").agg(F.sum("n").alias("n")), "contexts")
    totals = table.groupBy("level", "context").agg(F.sum("n").alias("total"))
    everything = table.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = totals.where((F.col("total") >= least_share * everything) | (F.col("level") == 0))
    rows = staged(table.join(frequent, ["level", "context"]), "frequent")
    longer, odds = (F.col("level") + 1).alias("level"), (F.col("n") / F.col("total")).alias("q")
    shorter = rows.select(longer, F.col("context").alias("shorter"), "symbol", odds)
    own = rows.where("level > 0").withColumn("shorter", F.expr("context & (shiftleft(1L, 8 * (level - 1)) - 1)"))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q")))
    passed = own.join(shorter, ["level", "shorter", "symbol"]).groupBy("level", "context").agg(gain.alias("gain"))
    kept = passed.where(F.col("gain") >= least_gain).select("level", "context")
    wanted = ["level", "context", "symbol", "n"]
    return rows.join(kept, ["level", "context"]).select(*wanted).unionByName(rows.where("level = 0").select(*wanted))


def automaton(table: dict[str, list[int]], depth: int, weight: float = 8.0) -> dict:
    """States, transitions and log10 probabilities, from ``level, context, symbol, n`` of the retained contexts.

    States are the retained contexts and whatever stands at their beginnings and ends, so that the longest suffix state of
    a text so far follows from the one before and the next byte.  A state that is not retained itself has the distribution
    of its longest retained suffix.  Smoothing: ``weight`` draws from the next shorter context's distribution, at the root from
    a uniform one over all 256 symbols.  Symbols that never occur are alike everywhere and share the last column.
    """
    seen = sorted({*table["symbol"], END})
    column = np.full(256, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    width = len(seen) + 1
    alike = np.ones(width, np.float32)  # how many symbols a column stands for
    alike[-1] = 256 - len(seen)
    counts: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(width, np.float32)}
    for level, context, symbol, n in zip(table["level"], table["context"], table["symbol"], table["n"]):
        counts.setdefault((level, context), np.zeros(width, np.float32))[column[symbol]] = n
    start = (depth, (1 << (8 * depth)) - 1)
    states = set()
    for level, context in [*counts, start]:
        for begin in range(level + 1):
            for end in range(begin, level + 1):
                states.add((end - begin, (context >> (8 * (level - end))) & ((1 << (8 * (end - begin))) - 1)))
    order = sorted(states)
    number = {s: i for i, s in enumerate(order)}
    shorter = [number[n - 1, c & ((1 << (8 * (n - 1))) - 1)] if n else -1 for n, c in order]
    children: list[list[tuple[int, int]]] = [[] for _ in order]
    for i, (level, context) in enumerate(order):
        if level:
            children[number[level - 1, context >> 8]].append((int(column[context & 255]), i))
    step, odds = np.zeros((len(order), width), np.int32), np.zeros((len(order), width), np.float32)
    for i, state in enumerate(order):  # shorter states come first
        above = np.full(width, 1 / 256, np.float32) if i == 0 else odds[shorter[i]]
        own = counts.get(state)
        odds[i] = above if own is None else (own + weight * above) / (own.sum(dtype=np.float64) + weight)
        if i:
            step[i] = step[shorter[i]]
        for at, child in children[i]:
            step[i, at] = child
    step[:, column[END]] = number[start]
    return {"step": step, "log": np.log10(odds), "column": column, "start": number[start], "depth": depth, "alike": alike}


def log10_probabilities(texts: list[bytes], model: dict) -> np.ndarray:
    """Of each text with its end.  A run of texts is cut into rows that step side by side; each row is warmed up with the
    ``depth`` bytes before it, after which its state is that of the whole text."""
    out = np.zeros(len(texts))
    flat_step, flat_log, width = model["step"].ravel(), model["log"].ravel(), model["step"].shape[1]
    column = model["column"]
    for first, run in streams(texts):
        raw = np.frombuffer(b"\xff".join(run) + b"\xff", np.uint8)
        rows = -(-len(raw) // _ROW)
        padded = np.full(model["depth"] + rows * _ROW, END, np.uint8)
        padded[model["depth"] : model["depth"] + len(raw)] = raw
        state, logs = np.full(rows, model["start"], np.int64), np.zeros((_ROW, rows), np.float32)
        at = np.arange(rows) * _ROW
        for k in range(-model["depth"], _ROW):
            place = state * width + column[padded[at + (k + model["depth"])]]
            if k >= 0:
                logs[k] = flat_log[place]
            state = flat_step[place].astype(np.int64)
        lengths = np.array([len(x) + 1 for x in run])
        sums = np.add.reduceat(logs.T.ravel()[: len(raw)].astype(np.float64), np.cumsum(lengths) - lengths)
        out[first : first + len(run)] = sums
    return out


def scored(
    docs: DataFrame,
    train: Column,
    depth: int = 5,
    least_share: float = 1e-5,
    least_gain: float = 10.0,
    block_bytes: int = BLOCK_BYTES,
    row_key: str | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    ``train``: which rows the models learn from.  Documents are dealt into blocks of about ``block_bytes`` by a hash of the
    column ``row_key``, which must be the same whenever ``docs`` is read (a file's path and the row's place in it); without
    it, of id and text, and rows that repeat share a block.  Words
    are counted within blocks and then summed; each block gets back the counts of its own words, so that no task holds
    the vocabulary.  The tree's next-byte counts are gathered likewise; what is left after the divergence tests is bounded
    and goes to every task.  Null and empty texts are one end; without training rows all counts are zero and the tree is
    its uniform root.  Repeated rows are scored, and learned from, as often as they occur.
    """
    place = F.xxhash64(row_key) if row_key else F.xxhash64("doc_id", "text")
    docs = docs.select(F.col("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"), place.alias("place"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(size / block_bytes))
    blocks = docs.withColumn("block", F.pmod("place", F.lit(count)).cast("int")).drop("place")
    words = staged(gather_words(blocks), "gathered")
    totals = staged(words.groupBy("word").agg(F.sum("n").alias("total")), "words")
    texts = docs.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()[0]
    known, tokens = totals.where("total > 0").agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, tokens = known + int(texts > 0), tokens + texts
    counted = gather_grams(docs.where("train"), depth).groupBy("gram").agg(F.sum("n").alias("n"))
    table = contexts(counted, depth, least_share, least_gain).toArrow().to_pydict()
    model = docs.sparkSession.sparkContext.broadcast(automaton(table, depth))
    lookup = words.select("block", "word").join(totals, "word")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    target = to_arrow_schema(schema)
    room = float(tokens + distinct + 1)

    def of_block(rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return target.empty_table()
        kinds = dict(zip(table.column("word").to_pylist(), table.column("total").to_pylist()))
        logs = dict(zip(kinds, np.log10((np.array(list(kinds.values()), float) + 1) / room).tolist()))
        end = math.log10((texts + 1) / room)
        texts_here, made = lowered(rows.column("text")), []
        for text in texts_here:
            found = text.split()
            known_here = sum(map(bool, map(kinds.__getitem__, found))) + int(texts > 0)
            made.append((len(found) + 1, known_here, math.fsum(map(logs.__getitem__, found)) + end))
        n_tokens, n_known, base = zip(*made)
        return pa.Table.from_arrays(
            [
                rows.column("doc_id").cast(target.field("doc_id").type),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array([tokens] * len(made), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(log10_probabilities(texts_here, model.value), pa.float64()),
            ],
            schema=target,
        )

    sides = blocks.select("block", "doc_id", "text").groupBy("block"), lookup.groupBy("block")
    return sides[0].cogroup(sides[1]).applyInArrow(of_block, schema)
