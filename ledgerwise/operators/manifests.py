"""What is loaded, what is expected, what is missing: statements and documents as keyed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import CLOSED_STATUS, DOCUMENT_KEY, HAS_PDF, NO_PDF, OPEN_PERIOD, OPEN_STATUS
from ledgerwise.functions.dates import day, in_year, is_regular, period, recent_periods
from ledgerwise.functions.text import is_present
from ledgerwise.operators.joins import keyed_join, not_in, present_in
from ledgerwise.operators.ranking import latest_cutoffs
from ledgerwise.operators.reports import latest_file_date

PLAN = ("type", "period", "account", "status")


# --- statements --------------------------------------------------------------------------------------------------
def loaded_pairs(*movement_tables: DataFrame) -> DataFrame:
    """Distinct (period, cuenta) of all tables; each table is made distinct first, which combines map-side."""
    pairs = [t.select("period", "cuenta").distinct() for t in movement_tables]
    union = pairs[0]
    for part in pairs[1:]:
        union = union.unionByName(part)
    return union.distinct()


def missing_closed(account_cutoffs: DataFrame, loaded: DataFrame, newest: int = 2) -> DataFrame:
    """Newest cutoffs of each account with no loaded statement; the account type plays no part in the match."""
    wanted = latest_cutoffs(account_cutoffs, newest).select(
        "type", F.col("cutoff_period").alias("period"), F.col("account_number").alias("account")
    )
    have = loaded.select("period", F.col("cuenta").alias("account"))
    return not_in(wanted, have, ["period", "account"]).withColumn("status", F.lit(CLOSED_STATUS)).select(*PLAN)


def missing_open(accounts: DataFrame, open_tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Accounts whose open table was not loaded on ``as_of``; ``open_tables`` maps type to movements."""
    today = F.date_format(day(as_of), "yyyy-MM-dd")
    wanted = accounts.select("type", today.alias("period"), F.col("account_number").alias("account"))
    loaded = None
    for kind, table in open_tables.items():
        part = latest_file_date(table).select(
            F.lit(kind).alias("type"),
            F.date_format("max_date", "yyyy-MM-dd").alias("period"),
            F.col("cuenta").alias("account"),
        )
        loaded = part if loaded is None else loaded.unionByName(part)
    return not_in(wanted, loaded, ["type", "period", "account"]).withColumn("status", F.lit(OPEN_STATUS)).select(*PLAN)


def download_plan(
    account_cutoffs: DataFrame,
    accounts: DataFrame,
    closed_tables: dict[str, DataFrame],
    open_tables: dict[str, DataFrame],
    as_of,
) -> DataFrame:
    """Every statement still to fetch: closed periods, then today's open ones."""
    closed = missing_closed(account_cutoffs, loaded_pairs(*closed_tables.values()))
    return closed.unionByName(missing_open(accounts, open_tables, as_of))


# --- file names --------------------------------------------------------------------------------------------------
def document_file_name(extension: str):
    """``{period}_{account}_{type}.{extension}``; for the open period this reads ``open_...``."""
    return F.concat(F.concat_ws("_", *DOCUMENT_KEY), F.lit(f".{extension}"))


def statement_file_name():
    """Closed: ``{period} {account}.csv``; open: the account and the name it was downloaded with."""
    closed = F.concat(F.concat_ws(" ", "period", "account"), F.lit(".csv"))
    return F.when(F.col("status") == CLOSED_STATUS, closed).otherwise(F.concat_ws("_", "account", "original_name"))


def snapshot_path(snapshot_date, suffix: str, state: str):
    """``{date}{suffix}`` for closed snapshots, in a folder per month for current ones."""
    name = F.concat(F.date_format(snapshot_date, "yyyy-MM-dd"), F.lit(suffix))
    return name if state == "cerrado" else F.concat_ws("/", period(snapshot_date), name)


def snapshots_of(df: DataFrame, date_column: str, as_of) -> DataFrame:
    """Snapshots a run on ``as_of`` may use: that day's and the day before's."""
    return df.filter(F.col(date_column).between(F.date_sub(as_of, 1), as_of))


def parse_document_names(files: DataFrame, extension: str = "pdf") -> DataFrame:
    """Document key out of ``file_name``; other extensions and names without exactly three parts are skipped."""
    name = F.col("file_name")
    parts = F.split(name, "_")
    wanted = F.lower(name).endswith(f".{extension}") & (F.size(parts) == 3)
    return (
        files.filter(wanted)
        .withColumn("cutoff_period", parts[0])
        .withColumn("account_number", parts[1])
        .withColumn("type", F.regexp_replace(parts[2], r"\.[^.]*$", ""))
    )


# --- documents ---------------------------------------------------------------------------------------------------
def document_flags(documents: DataFrame) -> DataFrame:
    """Keys with presence flags.

    A table that stores ``has_pdf`` / ``has_csv`` (see ``sources.documents``) is used as it is, so the scan never
    touches payloads; otherwise the flags come from the payload lengths.
    """
    flags = {
        f"has_{part}": (
            F.coalesce(F.col(f"has_{part}"), F.lit(False))
            if f"has_{part}" in documents.columns
            else is_present(F.col(f"{part}_file"))
        )
        for part in ("pdf", "csv")
    }
    status = F.when(F.col("has_pdf"), HAS_PDF).otherwise(NO_PDF)
    return (
        documents.select(*DOCUMENT_KEY, "updated_at", *[c.alias(n) for n, c in flags.items()])
        .withColumn("pdf_status", status)
    )


def missing_open_documents(documents: DataFrame, as_of) -> DataFrame:
    """Open documents to create: accounts seen in the year of ``as_of`` that have none."""
    pair = ["account_number", "type"]
    seen = documents.filter(in_year(F.col("cutoff_period"), as_of)).select(*pair).distinct()
    have = documents.filter(F.col("cutoff_period") == OPEN_PERIOD)
    missing = not_in(seen, have, pair)
    return missing.select(F.lit(OPEN_PERIOD).alias("cutoff_period"), *pair)


def with_open_documents(flags: DataFrame, as_of) -> DataFrame:
    """Flagged documents plus the open ones that have to exist."""
    created = missing_open_documents(flags, as_of).withColumns(
        {"has_pdf": F.lit(False), "has_csv": F.lit(False), "pdf_status": F.lit(NO_PDF)}
    )
    return flags.unionByName(created, allowMissingColumns=True)


def pending_csv(flags: DataFrame, as_of, refresh_open: bool = False) -> DataFrame:
    """Documents waiting for a CSV: open ones not updated today, or periods of the last two months.

    A document that holds a CSV is not pending; ``refresh_open`` asks again for open ones last updated before today.
    """
    is_open = F.col("cutoff_period") == OPEN_PERIOD
    stale = F.to_date("updated_at") < day(as_of)
    limit = period(F.add_months(day(as_of), -2))
    recent = is_regular(F.col("cutoff_period")) & (F.col("cutoff_period") >= limit)
    pending = ~F.col("has_csv") & ((is_open & (F.col("updated_at").isNull() | stale)) | recent)
    if refresh_open:
        pending = pending | (is_open & stale)
    return flags.filter(pending).select(*DOCUMENT_KEY)


def pending_pdf(flags: DataFrame, as_of) -> DataFrame:
    """Documents of the year of ``as_of`` waiting for their PDF; open ones have none."""
    return flags.filter(~F.col("has_pdf") & in_year(F.col("cutoff_period"), as_of)).select(*DOCUMENT_KEY)


def expected_files(flags: DataFrame, as_of) -> DataFrame:
    """File names that would complete the pending documents."""
    csv = pending_csv(flags, as_of).withColumns({"filename": document_file_name("csv"), "filetype": F.lit("csv")})
    pdf = pending_pdf(flags, as_of).withColumns({"filename": document_file_name("pdf"), "filetype": F.lit("pdf")})
    return csv.unionByName(pdf)


def files_to_attach(flags: DataFrame, files: DataFrame, as_of) -> DataFrame:
    """Expected files that are there."""
    have = files.select(F.col("file_name").alias("filename"))
    return present_in(expected_files(flags, as_of), have, ["filename"])


def without_pdf(account_cutoffs: DataFrame, flags: DataFrame) -> DataFrame:
    """Account cutoffs whose document has no PDF yet."""
    return not_in(account_cutoffs, flags.filter("has_pdf"), DOCUMENT_KEY)


def in_recent_periods(account_cutoffs: DataFrame, as_of, months: int = 3) -> DataFrame:
    return account_cutoffs.filter(F.col("cutoff_period").isin(*recent_periods(as_of, months)))


def pending_uploads(account_cutoffs: DataFrame, flags: DataFrame, files: DataFrame) -> DataFrame:
    """Cutoffs without PDF whose file is there."""
    named = without_pdf(account_cutoffs, flags).withColumn("filename", document_file_name("pdf"))
    return present_in(named, files.select(F.col("file_name").alias("filename")), ["filename"])


def documents_to_sync(account_cutoffs: DataFrame, flags: DataFrame, files: DataFrame) -> DataFrame:
    """Documents a sync writes: every cutoff without PDF, with ``file_name`` where its file is there."""
    named = without_pdf(account_cutoffs, flags).withColumn("_name", document_file_name("pdf"))
    arrived = files.select(F.col("file_name").alias("_name"), "file_name").distinct()
    return keyed_join(named, arrived, ["_name"]).drop("_name")
