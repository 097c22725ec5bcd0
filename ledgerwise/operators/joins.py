"""Keyed joins.

No broadcast hints: Catalyst broadcasts a side whose size it knows to be under the threshold (file size at planning,
shuffle size at run time) and otherwise sorts and merges, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def by_merge(lookup: DataFrame) -> DataFrame:
    """A lookup that grows with the input, never broadcast in its next join.

    Before anything runs Catalyst goes by the size of the files, in which repeated values take next to nothing; what goes
    through the driver are whole rows, and a hash table of them.
    """
    return lookup.hint("merge")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool | Collection[str] = False,
) -> DataFrame:
    """Equi-join on same-named keys, keeping the left side's key columns.

    ``null_safe`` matches NULL with NULL, on all keys or on those named, and stays an equi-join in the plan.
    """
    marked = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    lenient = keys if null_safe is True else null_safe or ()
    pairs = {k: (F.col(k), F.col(f"_right_{k}")) for k in keys}
    matches = [a.eqNullSafe(b) if k in lenient else a == b for k, (a, b) in pairs.items()]
    return left.join(marked, reduce(and_, matches), how).drop(*[f"_right_{k}" for k in keys])


def salted_lookup(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool | Collection[str] = False,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a table with one row per key, when one key may hold a large share of the rows.

    Rows of a key are spread over ``salts`` partitions by a hash of their whole content (the same on a retry) and the
    lookup row is repeated once per salt.  The repeated lookup is shuffled on (keys, salt), which also lets adaptive
    execution split what is still skewed.  Catalyst does not see the repetition in its estimates, which would send ``salts``
    times what it allows for a broadcast through the driver; hence the merge hint.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    repeated = by_merge(lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    lenient = keys if null_safe is True else null_safe or ()
    return keyed_join(left.withColumn("_salt", spread), repeated, [*keys, "_salt"], how, lenient).drop("_salt")


def not_in(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``.

    The right keys are made distinct first: that combines copies before the shuffle, so a key repeated very often
    on the right costs one row per map task.  They grow with the right side and are never broadcast.
    """
    return keyed_join(left, by_merge(right.select(*keys).distinct()), keys, "left_anti", null_safe)


def present_in(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return keyed_join(left, by_merge(right.select(*keys).distinct()), keys, "left_semi", null_safe)


def membership(parts: dict[str, DataFrame], keys: Sequence[str], **extra: Column) -> DataFrame:
    """One row per key with a flag per part telling whether the key occurs in it (NULL keys are equal).

    One shuffle of all parts together, combined map-side, in place of one join per pair.  ``extra`` adds aggregates.
    """
    tagged = [df.select(*keys, F.lit(name).alias("_part")) for name, df in parts.items()]
    flags = [F.max(F.col("_part") == name).alias(name) for name in parts]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(*keys).agg(*flags, *[c.alias(n) for n, c in extra.items()])
