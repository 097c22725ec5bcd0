"""Tables on shared storage.

Movement and classification tables are partitioned by the month of ``fecha``, documents by their period.  Both are
part of the key, so a load can only touch the partitions it brings: an upsert reads, merges and rewrites those and no
others.  All of them are switched by a pointer (``versions``): readers see a load whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.contracts import MOVEMENT_KEY, MOVEMENTS
from ledgerwise.operators.enrich import MOVEMENT_ID, with_movement_id
from ledgerwise.operators.keyed import loadable, new_rows, upsert
from ledgerwise.operators.ranking import keep_last
from ledgerwise.shared import exists, staged
from ledgerwise.sources import versions
from ledgerwise.sources.versions import PART

# partition of a row, as SQL over its key columns
MONTH_OF_ROW = "date_format(fecha, 'yyyy-MM')"
PERIOD_OF_DOCUMENT = "cutoff_period"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole table; empty with ``schema`` where it was never written, or holds nothing."""
    found = versions.read(spark, path, schema)
    if found is not None:
        return found.drop(PART)
    if schema is not None and (not exists(spark, path) or versions.current(spark, path).number):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def _by_part(df: DataFrame, part: str) -> DataFrame:
    """Rows grouped by partition for writing; adaptive execution cuts large partitions into several files."""
    return df.withColumn(PART, F.coalesce(F.expr(part), F.lit("none"))).hint("rebalance", PART)


def read_parts(
    spark: SparkSession,
    path: str,
    schema: T.StructType = MOVEMENTS,
    only: Sequence[str] | None = None,
    since: str | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """Partitioned table without the storage column: all of it, the named partitions, or those from one on.

    A report over the last months asks for ``since`` the first of them; the scan then lists no earlier folder.
    ``keep_part`` leaves the storage column in, for filters that are to skip folders.
    """
    stored = versions.read(spark, path, schema, only, since)
    if stored is None:
        whole = T.StructType([*schema.fields, T.StructField(PART, T.StringType())]) if keep_part else schema
        return spark.createDataFrame([], whole)
    if since is not None:
        stored = stored.filter(F.col(PART) >= since)
    return stored if keep_part else stored.drop(PART)


def changed_parts(spark: SparkSession, path: str, since: versions.Content) -> list[str]:
    """Partitions that have been written since an earlier content of the table; nothing is read but the pointer."""
    now = versions.current(spark, path).parts
    return sorted(versions.part_name(f) for f in {*now, *since.parts} if now.get(f) != since.parts.get(f))


def rows_of_parts(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """Rows of each partition, of all tables together; only the footers of the files are read."""
    rows: dict[str, int] = {}
    for path in paths:
        stored = versions.read(spark, path, T.StructType([]))
        for part, n in stored.groupBy(PART).count().collect() if stored is not None else ():
            rows[part] = rows.get(part, 0) + n
    return rows


def overwrite_parts(df: DataFrame, path: str, part: str = MONTH_OF_ROW) -> None:
    """Truncate and insert, in one switch.  ``df`` may read the old table."""
    versions.replace(_by_part(df, part), path)


def parts_of(df: DataFrame, part: str = MONTH_OF_ROW) -> list[str]:
    """Partitions the rows belong to.

    Months of dates are at most twelve per calendar year, so they fit a list; a literal list is what lets the scan
    skip the other partitions.
    """
    return [row[0] for row in df.select(F.coalesce(F.expr(part), F.lit("none"))).distinct().collect()]


def merge_parts(
    source: DataFrame,
    path: str,
    merge: Callable[[DataFrame], DataFrame],
    schema: T.StructType = MOVEMENTS,
    part: str = MONTH_OF_ROW,
    touched: Sequence[str] | None = None,
) -> None:
    """Replace the partitions ``source`` touches by ``merge`` of their rows; the other partitions are not read.

    The merged rows go straight into the new folders, which count once all are written.  ``touched`` saves the look at
    ``source`` where its partitions are known.
    """
    spark = source.sparkSession
    touched = parts_of(source, part) if touched is None else touched
    if touched:
        versions.replace_parts(_by_part(merge(read_parts(spark, path, schema, touched)), part), path, touched)


def unique_rows(source: DataFrame, order: Sequence[str] = ("file_date", "file_name")) -> DataFrame:
    """Rows to load: keyed, one per key, staged so that their real size decides how they are joined."""
    return staged(keep_last(loadable(source), MOVEMENT_KEY, order), "load")


def upsert_movements(source: DataFrame, path: str, on_conflict: str = "update") -> dict[str, int]:
    """Keyed upsert into a movement table; rows without key are left out (``keyed.rejected`` lists them).

    Running it again with the same source changes nothing.  Returns the counters of ``upsert_unique``.
    """
    return upsert_unique(unique_rows(source), path, on_conflict)


def upsert_unique(
    unique: DataFrame, path: str, on_conflict: str = "update", touched: Sequence[str] | None = None
) -> dict[str, int]:
    """Upsert of rows that are staged already, keyed and one per key.

    Returns how many keys it ``inserted`` and ``updated``, and how many it left ``untouched`` in the partitions it read: the
    rows are counted on their way to storage, those there before by the footers of their files.
    """
    touched = parts_of(unique) if touched is None else touched
    if not touched:
        return {"inserted": 0, "updated": 0, "untouched": 0}
    before = read_parts(unique.sparkSession, path, unique.schema, touched).count()
    counts = Observation()

    def merge(stored: DataFrame) -> DataFrame:
        old, new = stored.withColumn("_loaded", F.lit(False)), unique.withColumn("_loaded", F.lit(True))
        seen = upsert(old, new, MOVEMENT_KEY, on_conflict).observe(
            counts, F.count_if("_loaded").alias("written"), F.count_if(~F.col("_loaded")).alias("kept")
        )
        return seen.drop("_loaded")

    merge_parts(unique, path, merge, unique.schema, touched=touched)
    written, kept = (counts.get[c] for c in ("written", "kept"))
    return {"inserted": written - (before - kept), "updated": before - kept, "untouched": kept}


# with this setting tables bucketed by movement_id join on the whole movement key without a shuffle
COLOCATED_JOINS = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def save_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Catalogue table bucketed by a hash of the movement key.

    Movements and their classification saved with the same number of buckets meet bucket by bucket in every
    enrichment: the shuffle is paid once, on writing.
    """
    bucketed = with_movement_id(df).repartition(buckets, MOVEMENT_ID).write.mode("overwrite")
    bucketed.bucketBy(buckets, MOVEMENT_ID).sortBy(MOVEMENT_ID).option("path", path).saveAsTable(table)


def replace_table(df: DataFrame, path: str, part: str | None = None) -> None:
    """Overwrite a table whose new content may come from the old one; ``part`` is SQL for a partition to select by."""
    versions.replace(df.withColumn(PART, F.lit(versions.WHOLE)) if part is None else _by_part(df, part), path)


# --- sets of tables that change together ---------------------------------------------------------------------------
def publish(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Write all tables into a new version folder, then note the version as published.

    The note is appended last, in one file: readers see all tables of a version or none.  Versions sort by name.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    note = spark.range(1).select(F.lit(version).alias("version"))
    note.coalesce(1).write.mode("append").parquet(f"{root}/published")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table of the newest published version."""
    version = spark.read.parquet(f"{root}/published").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={version}/{name}")


def export_sets(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", skip_empty: bool = False) -> None:
    """One data set per table; ``skip_empty`` leaves out tables without rows.

    CSV cells are written as statements are read: quotes inside quotes doubled, line breaks inside quotes.
    """
    for name, df in tables.items():
        if skip_empty and df.isEmpty():
            continue
        writer = df.write.mode("overwrite")
        writer.options(header=True, escape='"').csv(f"{root}/{name}") if fmt == "csv" else writer.parquet(f"{root}/{name}")


# --- snapshots -------------------------------------------------------------------------------------------------------
def save_snapshot(df: DataFrame, root: str, snapshot_date: date) -> None:
    df.write.mode("overwrite").parquet(f"{root}/snapshot_date={snapshot_date.isoformat()}")


def load_snapshot(spark: SparkSession, root: str, snapshot_date: date) -> DataFrame | None:
    """Snapshot of one day, None if there is none; one that cannot be read is an error, not a missing one."""
    path = f"{root}/snapshot_date={snapshot_date.isoformat()}"
    return spark.read.parquet(path) if exists(spark, path) else None


def load_latest_snapshot(spark: SparkSession, root: str, as_of: date) -> DataFrame | None:
    """Snapshot of ``as_of``, else of the day before, else None."""
    for day in (as_of, as_of - timedelta(days=1)):
        found = load_snapshot(spark, root, day)
        if found is not None:
            return found.withColumn("file_date", F.lit(day))
    return None


def read_daily_file(spark: SparkSession, root: str, as_of: date, suffix: str) -> DataFrame | None:
    """CSV of ``as_of`` (``{yyyy-MM}/{yyyy-MM-dd}{suffix}``), else of the day before, else None; all columns text."""
    for day in (as_of, as_of - timedelta(days=1)):
        name = f"{day.isoformat()}{suffix}"
        path = f"{root}/{day:%Y-%m}/{name}"
        if not exists(spark, path):
            continue
        found = spark.read.options(header=True, escape='"').csv(path)
        return found.withColumns({"file_date": F.lit(day), "file_name": F.lit(name)})
    return None


def replace_snapshot(spark: SparkSession, root: str, as_of: date, suffix: str, path: str) -> bool:
    """Full replace of a stored snapshot by the daily file of ``as_of``, else of the day before; without either it stays as
    it is.  Tells whether there was one."""
    found = read_daily_file(spark, root, as_of, suffix)
    if found is not None:
        replace_table(found, path)
    return found is not None


def feed_snapshot(source: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append to a stored snapshot what it does not hold yet; what it holds is read by its keys only and stays as it is."""
    held = read_table(source.sparkSession, path, T.StructType([source.schema[c] for c in columns]))
    versions.append(new_rows(held, source, columns).withColumn(PART, F.lit(versions.WHOLE)), path)
