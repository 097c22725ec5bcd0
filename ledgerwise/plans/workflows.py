"""Whole jobs: load statements, rebuild the enriched tables, plan downloads, bring in documents.

Each is a chain of operators with the reads and writes around it; nothing here runs on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.contracts import ACCOUNT_CUTOFFS, CONCEPTS, DOCUMENT_KEY, KINDS
from ledgerwise.operators import manifests as m
from ledgerwise.operators.calendar import refresh_account_cutoffs
from ledgerwise.operators.enrich import enriched_table, export_rows, newest_first_in_slots, state_changes, sync_concepts
from ledgerwise.operators.export import as_cells
from ledgerwise.operators.joins import keyed_join
from ledgerwise.operators.keyed import document_attach, document_upsert, loadable
from ledgerwise.shared import job_folder, staged
from ledgerwise.sources import store
from ledgerwise.sources.documents import (
    STORED_DOCUMENTS,
    keep_payloads,
    keyed_references,
    newest_of_each_name,
    with_stored_flags,
)
from ledgerwise.sources.files import (
    distinct_names,
    holds_columns,
    list_files,
    load_paths,
    paths_of,
    statement_manifest,
    with_headers,
)
from ledgerwise.sources.statements import (
    concat_files,
    last_of_each_key,
    raw_reader,
    readable,
    refusal,
    refused,
    statement_movements,
    with_files,
)
from ledgerwise.sources.versions import current

# fixed values: table prefixes
PREFIX = {"debit": "debito", "credit": "credito"}


@dataclass
class Ledger:
    """Where a ledger lives and who its accounts are."""

    spark: SparkSession
    root: str
    accounts: DataFrame

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def movements(self, kind: str, estado: str) -> DataFrame:
        return store.read_parts(self.spark, self.path(f"{PREFIX[kind]}_{estado}"))

    def concepts(self, kind: str) -> DataFrame:
        return store.read_parts(self.spark, self.path(f"{PREFIX[kind]}_conceptos"), CONCEPTS)

    def documents(self) -> DataFrame:
        return store.read_parts(self.spark, self.path("documents"), STORED_DOCUMENTS)

    def cutoffs(self) -> DataFrame:
        return store.read_table(self.spark, self.path("account_cutoffs"), ACCOUNT_CUTOFFS)


def load_statements(
    ledger: Ledger,
    closed_folder: str,
    open_folder: str,
    as_of,
    run_ts: Column,
    null_date: bool = True,
    on_conflict: str = "update",
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Daily load: closed tables by keyed upsert, open tables by replacement, then the classification sync.

    Returns, per kind and state, the loaded movements; the ``rejects``; and the ``counters`` of every table: keys inserted,
    updated and left untouched in the months of the load, and lines rejected, all counted on their way to storage.  What
    the load read lies in the ledger's ``loaded_<estado>`` until the next load but one; nothing else stays behind.
    """
    with job_folder(ledger.spark):
        return _load_statements(ledger, closed_folder, open_folder, as_of, run_ts, null_date, on_conflict, multi_line)


def _load_statements(ledger, closed_folder, open_folder, as_of, run_ts, null_date, on_conflict, multi_line):
    spark, loaded, away, counters = ledger.spark, {}, [], []
    for estado, folder, day in (("cerrado", closed_folder, None), ("abierto", open_folder, as_of)):
        manifest = staged(statement_manifest(spark, folder, ledger.accounts, day), f"manifest-{estado}")
        rows = last_of_each_key(statement_movements(spark, folder, manifest, estado, as_of, null_date, multi_line))
        brought, seen = ledger.path(f"loaded_{estado}"), Observation()
        store.replace_table(rows.observe(seen, *_lines_by_kind()), brought, "kind")
        # a plan without any rows may be left out with what it was to count
        lines = seen.get if current(spark, brought).parts else dict.fromkeys(_LINES, 0)
        both = store.read_parts(spark, brought, rows.schema)
        away.append(refused(both))
        for kind in KINDS:
            movements = loadable(readable(store.read_parts(spark, brought, rows.schema, [kind])).drop("kind"))
            path, table = ledger.path(f"{PREFIX[kind]}_{estado}"), f"{PREFIX[kind]}_{estado}"
            concepts = ledger.path(f"{PREFIX[kind]}_conceptos")
            if estado == "cerrado":
                found = load_closed(movements, path, concepts, ledger.accounts, kind, run_ts, on_conflict)
            else:
                sync_classification(concepts, movements, ledger.accounts, kind, run_ts)
                store.overwrite_parts(movements, path)
                found = {"inserted": lines[f"{kind}_good"], "updated": 0, "untouched": 0}
            counters.append((table, found["inserted"], found["updated"], found["untouched"], lines[f"{kind}_bad"]))
            loaded[table] = movements
    loaded["rejects"] = away[0].unionByName(away[1])
    loaded["counters"] = spark.createDataFrame(counters, COUNTERS)
    return loaded


COUNTERS = "table string, inserted long, updated long, untouched long, rejected long"
_LINES = {f"{kind}_{name}": (kind, name == "bad") for kind in KINDS for name in ("good", "bad")}


def _lines_by_kind() -> list[Column]:
    """Loadable and refused lines of each kind, as aggregates."""
    bad = refusal().isNotNull()
    return [F.count_if((F.col("kind") == kind) & (bad == away)).alias(name) for name, (kind, away) in _LINES.items()]


def load_closed(
    movements: DataFrame, path: str, concepts: str, accounts: DataFrame, kind: str, run_ts: Column, on_conflict: str = "update"
) -> dict[str, int]:
    """Closed movements (written already, one per key) into their table, and what changes by that into the classification.

    The classification comes first: as long as the movements are not in their table, a run that is repeated after a
    crash finds the same changes again.  Returns the counters of the upsert.
    """
    months = store.parts_of(movements)
    if months:
        stored = store.read_parts(movements.sparkSession, path, only=months)
        changes = staged(state_changes(stored, movements), f"sync-{kind}")
        sync_classification(concepts, changes, accounts, kind, run_ts, months)
    return store.upsert_unique(movements, path, on_conflict, months)


def sync_classification(
    path: str, movements: DataFrame, accounts: DataFrame, kind: str, run_ts: Column, months: list[str] | None = None
) -> None:
    """Bring a stored classification table in step with loaded movements, in the months they touch."""
    store.merge_parts(
        movements,
        path,
        lambda stored: sync_concepts(stored, movements, accounts, kind, run_ts),
        CONCEPTS,
        touched=months,
    )


def rebuild_enriched(
    tables: dict[str, DataFrame], concepts: dict[str, DataFrame], root: str, version: str
) -> None:
    """Drop and rebuild all enriched tables; ``concepts`` is keyed by the prefix of the table name."""
    built = {name: enriched_table(df, concepts[name.split("_")[0]]) for name, df in tables.items()}
    store.publish(built, root, version)


def export_ledger(ledger: Ledger, root: str) -> None:
    """For each kind one data set of all movements, closed and open, with their classification, newest first; and the
    same as cell text (``cells``).  The months and their sizes are known from storage, so nothing is read to find the order."""
    sets = {}
    for kind in KINDS:
        paths = [ledger.path(f"{PREFIX[kind]}_{estado}") for estado in ("cerrado", "abierto")]
        closed, opened = (store.read_parts(ledger.spark, path) for path in paths)
        month_rows = store.rows_of_parts(ledger.spark, paths)
        rows = export_rows(closed, opened, ledger.concepts(kind))
        sets[PREFIX[kind]] = newest_first_in_slots(rows, month_rows)
    store.export_sets(sets, root)
    stored = {name: ledger.spark.read.parquet(f"{root}/{name}") for name in sets}
    store.export_sets({name: as_cells(df) for name, df in stored.items()}, f"{root}/cells", "csv")


def feed_from_files(spark: SparkSession, folder: str, required: tuple[str, ...], path: str, multi_line: bool = False) -> None:
    """Feed a stored snapshot from all files of a folder whose header holds the ``required`` columns, in any order.

    Files are read by their header, however wide, and rows come whole: all columns of their file by name, and the name and
    the date of the file.  Rows whose required columns the snapshot holds already stay out.  A line whose number of cells is
    not that of its header is kept as text in ``line`` besides.  A column name that repeats in a header, in any case, gets a
    number (``Saldo_1``).
    """
    with job_folder(spark):
        listed = with_headers(list_files(spark, folder)).filter(holds_columns(F.col("header"), required))
        dated = listed.withColumn("file_date", F.to_date("file_modification_time"))
        manifest = staged(dated.select("file_path", "raw_path", "file_name", "file_date", "header"), "feed-files")
        headers = [r["header"] for r in manifest.select("header").distinct().orderBy("header").collect()]
        parts = [_rows_of_header(spark, manifest, header, multi_line) for header in headers]
        if parts:
            store.feed_snapshot(staged(concat_files(parts), "feed-rows"), path, required)


def _rows_of_header(spark: SparkSession, manifest: DataFrame, header: list[str], multi_line: bool) -> DataFrame:
    """Rows of all files with one header, columns under its names."""
    files = manifest.filter(F.col("header") == F.array(*map(F.lit, header)))
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    schema = cells.add("line", T.StringType())
    reader = raw_reader(spark.read.format("csv"), schema, multi_line).option("columnNameOfCorruptRecord", "line")
    lines = load_paths(reader, paths_of(files), *schema.names, F.col("_metadata.file_path").alias("file_path"))
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate(distinct_names(header))]
    return with_files(lines, files.drop("header")).select(*named, "line", "file_name", "file_date")


def plan_downloads(ledger: Ledger, days: DataFrame, as_of, run_ts: Column, rule: str = "v2") -> DataFrame:
    """Renew the account cutoffs, then list the statements still to fetch."""
    spark = ledger.spark
    renewed = refresh_account_cutoffs(ledger.cutoffs(), ledger.accounts, days, as_of, run_ts, rule)
    store.replace_table(renewed, ledger.path("account_cutoffs"))
    closed = {kind: ledger.movements(kind, "cerrado") for kind in KINDS}
    opened = {kind: ledger.movements(kind, "abierto") for kind in KINDS}
    return m.download_plan(
        store.read_table(spark, ledger.path("account_cutoffs"), ACCOUNT_CUTOFFS), ledger.accounts, closed, opened, as_of
    )


def sync_pdf_documents(ledger: Ledger, folder: str, only_if_files: bool = True) -> bool:
    """Documents for all cutoffs without PDF, with a reference to the payload of those whose file has arrived.

    With ``only_if_files`` nothing is written as long as not one expected file is there; tells whether it wrote.
    """
    with job_folder(ledger.spark):
        return _sync_pdf_documents(ledger, folder, only_if_files)


def _sync_pdf_documents(ledger: Ledger, folder: str, only_if_files: bool) -> bool:
    spark = ledger.spark
    flags = m.document_flags(ledger.documents())
    listed = staged(newest_of_each_name(list_files(spark, folder, "*.pdf")), "pdf-files")
    waiting = staged(m.documents_to_sync(ledger.cutoffs(), flags, listed), "waiting")
    arrived = waiting.filter(F.col("file_name").isNotNull())
    if only_if_files and arrived.isEmpty():
        return False
    kept = keep_payloads(spark, listed.join(arrived.select("file_name"), "file_name", "left_semi"), ledger.path("payloads"))
    references = kept.select("file_name", F.col("content_hash").alias("pdf_hash"), F.col("content_length").alias("pdf_length"))
    incoming = staged(keyed_join(waiting, references, ["file_name"]).drop("file_name"), "documents")
    _merge_documents(ledger, incoming, lambda stored: document_upsert(stored, incoming))
    return True


def _merge_documents(ledger: Ledger, incoming: DataFrame, merge) -> None:
    store.merge_parts(
        incoming,
        ledger.path("documents"),
        lambda stored: with_stored_flags(merge(stored)),
        STORED_DOCUMENTS,
        store.PERIOD_OF_DOCUMENT,
    )


def attach_documents(ledger: Ledger, folder: str, as_of, run_ts: Column) -> DataFrame:
    """Create the open documents that are missing, attach every expected file that has arrived.

    Returns the attached keys, which the ledger keeps (``attached``) until the next run but one.
    """
    with job_folder(ledger.spark):
        _attach_documents(ledger, folder, as_of, run_ts)
    return store.read_table(ledger.spark, ledger.path("attached"), ATTACHED)


ATTACHED = T.StructType([T.StructField(c, T.StringType()) for c in (*DOCUMENT_KEY, "filename", "filetype")])


def _attach_documents(ledger: Ledger, folder: str, as_of, run_ts: Column) -> None:
    spark = ledger.spark
    created = staged(missing_open(ledger, as_of), "open-documents")
    _merge_documents(ledger, created, lambda stored: stored.unionByName(created, allowMissingColumns=True))
    flags = m.document_flags(ledger.documents())
    listed = staged(newest_of_each_name(list_files(spark, folder, "*")), "all-files")
    wanted = staged(m.files_to_attach(flags, listed, as_of).select(*ATTACHED.names), "attach")
    kept = {}
    for kind in ("csv", "pdf"):
        names = wanted.filter(F.col("filetype") == kind).select(F.col("filename").alias("file_name"))
        kept[kind] = keep_payloads(spark, listed.join(names, "file_name", "left_semi"), ledger.path("payloads"))
    files = staged(keyed_references(kept), "references")
    _merge_documents(ledger, files, lambda stored: document_attach(stored, files, run_ts))
    store.replace_table(wanted, ledger.path("attached"))


def missing_open(ledger: Ledger, as_of) -> DataFrame:
    """Open documents that have to be created."""
    return m.missing_open_documents(ledger.documents(), as_of)
