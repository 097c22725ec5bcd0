"""First / last / top rows per key.

``row_number() <= k`` right above its window gets a group limit before the shuffle, so each map task sends at most
k rows per key however many rows the key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise.contracts import CUTOFF_KEY


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key (NULLs equal): the last in ``order``, ties broken by a hash of the whole row."""
    descending = [F.col(c).desc_nulls_last() for c in order]
    return top_per_key(df, keys, [*descending, F.xxhash64(*df.columns).desc()])


def latest_cutoffs(account_cutoffs: DataFrame, n: int = 2) -> DataFrame:
    """The newest ``n`` cutoff periods of every account."""
    return top_per_key(account_cutoffs, CUTOFF_KEY[:2], [F.col("cutoff_period").desc()], n)


def newest_file(manifest: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest file (last name on a tie) among those not known before, per group of ``by``; none if nothing is new."""
    fresh = manifest.join(known.select("file_name").distinct(), "file_name", "left_anti")
    newest = F.max(F.struct("file_modification_time", "file_name")).alias("newest")
    found = fresh.groupBy(*by).agg(newest).filter(F.col("newest").isNotNull())
    return found.select(*by, "newest.file_name", "newest.file_modification_time")
