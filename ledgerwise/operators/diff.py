"""Differences between two versions of a table.

Both versions go through one shuffle on the whole row, combined map-side: equal rows collapse before they move.

Large tables of which little has changed are compared by digests first (``differing_buckets``): a few numbers for each part
and bucket of rows move, and only rows of buckets that differ are looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.operators.joins import keyed_join, membership


def common_columns(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns both have, in the order of ``new``."""
    return [c for c in new.columns if c in old.columns]


def schema_diff(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """Column names only, no data is read."""
    return {
        "added": sorted(set(new.columns) - set(old.columns)),
        "removed": sorted(set(old.columns) - set(new.columns)),
        "common": common_columns(old, new),
    }


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows, compared as text over the common columns, that only one version holds: ``change`` tells which."""
    columns = common_columns(old, new)
    flags = membership({"_old": _as_text(old, columns), "_new": _as_text(new, columns)}, columns)
    change = F.when(F.col("_new") & ~F.col("_old"), "added").when(F.col("_old") & ~F.col("_new"), "removed")
    return flags.select(*columns, change.alias("change")).filter(F.col("change").isNotNull())


def occurring_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows over the common columns that occur exactly once in both versions together, NULLs equal."""
    columns = common_columns(old, new)
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).drop("_n")


def same_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: do both hold the same rows the same number of times, whatever their order?"""
    if old.columns != new.columns:
        return new.agg(F.lit(False).alias("equal"))
    signed = old.withColumn("_side", F.lit(-1)).unionByName(new.withColumn("_side", F.lit(1)))
    surplus = signed.groupBy(*new.columns).agg(F.sum("_side").alias("_surplus"))
    return surplus.agg((F.count_if(F.col("_surplus") != 0) == 0).alias("equal"))


def summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: sizes, columns added and removed, distinct rows added and removed; each version is read once."""
    names = schema_diff(old, new)
    columns = names["common"]
    both = _as_text(old, columns).withColumn("_old", F.lit(1)).withColumn("_new", F.lit(0)).unionByName(
        _as_text(new, columns).withColumn("_old", F.lit(0)).withColumn("_new", F.lit(1))
    )
    counts = both.groupBy(*columns).agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    return counts.agg(
        F.count_if(F.col("_old") == 0).alias("rows_added"),
        F.count_if(F.col("_new") == 0).alias("rows_removed"),
        F.coalesce(F.sum("_new"), F.lit(0)).alias("rows_new"),
        F.coalesce(F.sum("_old"), F.lit(0)).alias("rows_old"),
    ).withColumns(
        {"columns_added": F.lit(",".join(names["added"])), "columns_removed": F.lit(",".join(names["removed"]))}
    )


def changed_values(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys of both versions whose ``column`` differs (NULL is a value), with the new value."""
    before = old.select(*keys, F.col(column).alias("_before"))
    joined = keyed_join(new.select(*keys, column), before, keys, "inner")
    return joined.filter(~F.col(column).eqNullSafe(F.col("_before"))).drop("_before")


# --- by digests ------------------------------------------------------------------------------------------------------
BUCKETS = 64


def _bucket(text: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *text), F.lit(buckets)).cast("int")


def _digests(df: DataFrame, part: str, columns: Sequence[str], buckets: int, side: str) -> DataFrame:
    """Number of rows, sum of one hash and exclusive or of another, for each part and bucket."""
    text = [F.col(c).cast("string") for c in columns]
    one, other = F.xxhash64(*text).cast("decimal(20,0)"), F.xxhash64(F.lit("other"), *reversed(text))
    named = {"part": F.col(part).cast("string"), "bucket": _bucket(text, buckets), "one": one, "other": other}
    grouped = df.select(*[c.alias(n) for n, c in named.items()]).groupBy("part", "bucket")
    return grouped.agg(F.struct(F.count(F.lit(1)), F.sum("one").cast("string"), F.bit_xor("other")).alias(side))


def differing_buckets(old: DataFrame, new: DataFrame, part: str, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``part, bucket`` where the rows of two versions, as text over ``columns``, are not the same the same number of times.

    ``part`` names a column that both versions have, such as their month.  Each version is read once; a row for each part and
    bucket leaves a task, so no key is too common.  Rows are told apart by their number and two independent hashes.
    """
    before, after = (_digests(df, part, columns, buckets, side) for df, side in ((old, "before"), (new, "after")))
    after = after.withColumnsRenamed({"part": "_part", "bucket": "_bucket"})
    same = F.col("part").eqNullSafe(F.col("_part")) & (F.col("bucket") == F.col("_bucket"))
    both = before.join(after, same, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    found = F.when(F.col("bucket").isNull(), F.col("_part")).otherwise(F.col("part"))
    return both.select(found.alias("part"), F.coalesce("bucket", "_bucket").alias("bucket"))


def _rows_of(df: DataFrame, part: str, columns: Sequence[str], pairs: dict[str | None, list[int]], buckets: int) -> DataFrame:
    """Rows of the given parts and buckets; the parts are a filter that reaches the scan."""
    text = [F.col(c).cast("string") for c in columns]
    bucket = _bucket(text, buckets)
    named = [p for p in pairs if p is not None]
    wanted = F.col(part).cast("string").isin(named) | (F.col(part).isNull() if None in pairs else F.lit(False))
    of_part = F.lit(False)
    for p, numbers in pairs.items():
        of_part = of_part | (F.col(part).cast("string").eqNullSafe(F.lit(p)) & bucket.isin(numbers))
    return df.filter(wanted).filter(of_part)


def row_changes_by_digest(old: DataFrame, new: DataFrame, part: str, buckets: int = BUCKETS) -> DataFrame:
    """What ``row_changes`` gives; rows are compared only in parts and buckets whose digests differ.

    Stored tables whose partitions are their parts (``store.read_parts(..., keep_part=True)``) are read twice only there.
    The driver sees the differing parts and buckets, at most ``buckets`` a part.
    """
    columns = [c for c in common_columns(old, new) if c != part]
    pairs: dict[str | None, list[int]] = {}
    for row in differing_buckets(old, new, part, columns, buckets).collect():
        pairs.setdefault(row["part"], []).append(row["bucket"])
    if not pairs:
        old, new = old.limit(0), new.limit(0)
    else:
        old, new = (_rows_of(df, part, columns, pairs, buckets) for df in (old, new))
    return row_changes(old.select(*columns), new.select(*columns))


def same_content_by_digest(old: DataFrame, new: DataFrame, part: str, buckets: int = BUCKETS) -> DataFrame:
    """What ``same_content`` gives, from digests alone: one row."""
    if old.columns != new.columns:
        return new.agg(F.lit(False).alias("equal"))
    columns = [c for c in new.columns if c != part]
    return differing_buckets(old, new, part, columns, buckets).agg((F.count(F.lit(1)) == 0).alias("equal"))
