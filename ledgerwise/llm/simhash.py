"""Near duplicates by SimHash: segment-popcount embedding, grid range join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.llm.common import per_batch
from ledgerwise.llm.components import connected_components
from ledgerwise.operators.joins import by_merge
from ledgerwise.shared import staged

SEED = 42
LOW_BITS = 0x5555555555555555
SEGMENTS = 32


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash over shingles of ``words`` words, as a signed number; zero without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    joined, size = b" ".join(tokens), min(words, len(tokens))
    starts = [0, *(ends[: len(tokens) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray, block: int = 65_536) -> int:
    """The bits that are set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of every row with its ``fingerprint`` (long)."""

    def work() -> Callable[[list], dict]:
        return lambda texts: {"fingerprint": [fingerprint(x, words) for x in texts]}

    return per_batch(docs, work, [T.StructField("fingerprint", T.LongType())], text, keep)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def embedding(bits: Column) -> Column:
    """Set bits of each two-bit segment, as a code of 0, 1 or 2 ones per segment.

    The Manhattan distance of two embeddings is the number of code bits that differ, and never above the Hamming distance.
    """
    low, shifted = F.lit(LOW_BITS), F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(bits.bitwiseAND(shifted).bitwiseAND(low), 1))


def layouts(max_distance: int, groups: int) -> list[tuple[int, list[int]]]:
    """Grid layouts as masks over the embedding, each with the group masks that must differ.

    Segments fall into ``groups`` groups.  Within ``max_distance`` at least ``groups - max_distance`` groups agree; a layout
    is one choice of them.  A pair belongs to its first agreeing groups alone, so that it is found once: the groups
    before the layout's last that are not in it must differ.
    """
    agree = groups - max_distance
    if not 0 < agree <= groups <= SEGMENTS:
        raise ValueError("groups must be above max_distance and at most 32")
    parts = np.array_split(np.arange(SEGMENTS), groups)
    masks = [sum(3 << (2 * int(s)) for s in part) for part in parts]
    return [
        (_signed(sum(masks[g] for g in chosen)), [_signed(masks[g]) for g in range(chosen[-1]) if g not in chosen])
        for chosen in combinations(range(groups), agree)
    ]


def groups_for(prints: int, max_distance: int) -> int:
    """How many groups of segments make the join cheapest for a number of distinct fingerprints.

    Layouts are ways to choose the agreeing groups, and each sends every fingerprint once.  A segment's count tells about 1.5
    bits, so a layout's cell has about so many fingerprints; comparing two is taken as a quarter of sending one.
    """
    def cost(groups: int) -> float:
        cells = 2.0 ** (1.5 * SEGMENTS * (groups - max_distance) / groups)
        return comb(groups, max_distance) * prints * (1 + prints / cells / 8)

    return min(range(max_distance + 3, min(SEGMENTS, max_distance + 13)), key=cost)


def links(prints: DataFrame, max_distance: int = 4, groups: int | None = None) -> DataFrame:
    """``(a, b)``, each pair of different fingerprints within ``max_distance`` bits once.

    ``prints(fingerprint)`` holds distinct fingerprints.  Range join on the grid of segment counts: candidates share the
    cell of a layout, the Manhattan distance of the embeddings is the lower bound, the Hamming distance decides.  All of it
    runs inside the join, so no pair is written that is not a link.  More ``groups`` make cells finer and layouts more;
    unless they are given, their number follows from that of the fingerprints.  Neither side is broadcast: Catalyst takes
    the exploded rows to be as small as the fingerprints they come from.
    """
    grid = layouts(max_distance, groups or groups_for(prints.count(), max_distance))
    width = max(len(others) for _, others in grid)
    listed = lambda values: F.array(*map(F.lit, values))
    keyed = prints.select(
        "fingerprint", embedding(F.col("fingerprint")).alias("code"), F.posexplode(listed([m for m, _ in grid]))
    )
    cell = F.col("code").bitwiseAND(F.col("col"))
    keyed = keyed.select("fingerprint", "code", F.col("pos").alias("layout"), cell.alias("cell"))
    left, right = keyed.alias("l"), keyed.alias("r")
    codes = F.col("l.code").bitwiseXOR(F.col("r.code"))
    near = (
        (F.col("l.layout") == F.col("r.layout"))
        & (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.fingerprint") < F.col("r.fingerprint"))
        & (F.bit_count(codes) <= max_distance)
        & (F.bit_count(F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))) <= max_distance)
    )
    for k in range(width):
        mask = F.get(listed([others[k] if k < len(others) else 0 for _, others in grid]), F.col("l.layout"))
        near &= (mask == 0) | (codes.bitwiseAND(mask) != 0)
    return left.join(by_merge(right), near).select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b"))


def near_duplicates(
    docs: DataFrame, words: int = 4, max_distance: int = 4, groups: int | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """``(doc_id, fingerprint long, component_id)`` for every row of ``docs(doc_id, text)``.

    Exact copies are one fingerprint before anything is joined.  Null and empty texts have fingerprint zero and are linked
    like any other.  Rows with one id share the row of the id's smallest component; a null id belongs to its text's
    component and names none unless all of them are null.  Fingerprints and components grow with ``docs`` and are never
    broadcast.
    """
    prints = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), "text"), words, keep=["doc_id"]), "prints")
    distinct = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(links(distinct, max_distance, groups))
    grouped = staged(found.join(by_merge(distinct), F.col("node") == F.col("fingerprint")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = grouped.join(by_merge(smallest), "component").select("fingerprint", "component_id")
    named = by_merge(of_print).join(distinct, "fingerprint", "right")
    named = named.select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(by_merge(named), "fingerprint").select("doc_id", "fingerprint", "component_id")
