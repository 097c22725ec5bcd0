"""Plans of missing statements and documents over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.contracts import DOCUMENT_KEY, HEADERS
from ledgerwise.operators import calendar as c
from ledgerwise.operators import keyed as k
from ledgerwise.operators import manifests as m
from ledgerwise.operators.joins import by_merge
from ledgerwise.operators.ranking import newest_file as newest
from ledgerwise.operators.reports import newest_snapshot
from ledgerwise.plans import views as v
from ledgerwise.plans.registry import query
from ledgerwise.shared import staged
from ledgerwise.sources import files as fs
from ledgerwise.sources.documents import by_reference, keyed_references

_KEY = "cutoff_period, account_number, type"


def _account_cutoffs(spark, sf):
    return c.account_cutoffs(v.accounts(spark, sf), c.cutoff_days(v.years(spark, sf)), v.AS_OF, v.run_ts())


def _flags(spark, sf):
    return m.document_flags(v.documents(spark, sf))


def _files(spark, sf):
    """Files that have arrived: a PDF per month of finished orders, a CSV per month of open ones, an open CSV."""
    orders = v.table(spark, sf, "orders").select(
        v.account_number("o_custkey").alias("account_number"),
        F.date_format("o_orderdate", "yyyy-MM").alias("cutoff_period"),
        F.col("o_orderstatus").alias("status"),
    )
    tagged = orders.join(by_merge(v.accounts(spark, sf)), "account_number")
    named = tagged.select(
        F.when(F.col("status") == "F", m.document_file_name("pdf"))
        .when(F.col("status") == "O", m.document_file_name("csv"))
        .otherwise(F.concat_ws("_", F.lit("open"), "account_number", F.concat("type", F.lit(".csv"))))
        .alias("file_name")
    )
    return named.distinct()


_FILES = f"""files AS (
    SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN period || '_' || cuenta || '_' || type || '.pdf'
                                       WHEN 'O' THEN period || '_' || cuenta || '_' || type || '.csv'
                                       ELSE 'open_' || cuenta || '_' || type || '.csv' END AS file_name
    FROM ledger JOIN accounts ON cuenta = account_number)"""
_PENDING_CSV = f"""pending_csv AS (
    SELECT {_KEY} FROM flags
    WHERE NOT has_csv AND CASE WHEN cutoff_period = 'open'
                               THEN updated_at IS NULL OR updated_at::DATE < DATE '{v.AS_OF}'
                               ELSE cutoff_period >= '2001-05' END)"""
_PENDING_PDF = f"""pending_pdf AS (SELECT {_KEY} FROM flags WHERE NOT has_pdf AND cutoff_period LIKE '2001-%')"""
_EXPECTED = f"""expected AS (
    SELECT {_KEY}, cutoff_period || '_' || account_number || '_' || type || '.csv' AS filename, 'csv' AS filetype
    FROM pending_csv UNION ALL
    SELECT {_KEY}, cutoff_period || '_' || account_number || '_' || type || '.pdf', 'pdf' FROM pending_pdf)"""


def _using(sql: str, *ctes: str) -> str:
    """A query with further named parts, in a form that fits behind the views."""
    return f", {', '.join(ctes)}\n{sql}"


# --- statements ------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT period, cuenta FROM movements", "movements")
def loaded_pairs(spark, sf):
    return m.loaded_pairs(*[v.movements(spark, sf, estado=e) for e in ("cerrado", "abierto")])


_LATE_LOADED = "SELECT DISTINCT period, cuenta FROM movements WHERE fecha < DATE '2001-07-15'"
_CLOSED = f"""SELECT type, cutoff_period AS period, account_number AS account, 'closed' AS status FROM (
        SELECT * FROM account_cutoffs
        QUALIFY row_number() OVER (PARTITION BY account_number, type ORDER BY cutoff_period DESC) <= 2) t
    WHERE NOT EXISTS (SELECT 1 FROM ({_LATE_LOADED}) l WHERE l.period = cutoff_period AND cuenta = account_number)"""
_OPEN = f"""SELECT type, '{v.AS_OF}' AS period, account_number AS account, 'open' AS status FROM accounts
    WHERE account_number NOT IN (SELECT cuenta FROM movements WHERE estado = 'abierto'
                                 GROUP BY cuenta HAVING max(file_date) = DATE '{v.AS_OF}')"""


def _loaded_tables(spark, sf):
    rows = {kind: v.movements(spark, sf, kind) for kind in ("debit", "credit")}
    early = {kind: df.filter(F.col("fecha") < v.day("2001-07-15")) for kind, df in rows.items()}
    opened = {kind: df.filter(F.col("estado") == "abierto") for kind, df in rows.items()}
    return early, opened


@query(_CLOSED, "account_cutoffs", "movements")
def missing_closed(spark, sf):
    early, _ = _loaded_tables(spark, sf)
    return m.missing_closed(_account_cutoffs(spark, sf), m.loaded_pairs(*early.values()))


@query(_OPEN, "accounts", "movements")
def missing_open(spark, sf):
    _, opened = _loaded_tables(spark, sf)
    return m.missing_open(v.accounts(spark, sf), opened, v.AS_OF)


@query(f"{_CLOSED} UNION ALL {_OPEN}", "account_cutoffs", "movements")
def download_plan(spark, sf):
    early, opened = _loaded_tables(spark, sf)
    return m.download_plan(_account_cutoffs(spark, sf), v.accounts(spark, sf), early, opened, v.AS_OF)


@query(
    """SELECT account_number, type, cutoff_period FROM account_cutoffs
       WHERE cutoff_period IN ('2001-07', '2001-06', '2001-05')""",
    "account_cutoffs",
)
def recent_periods(spark, sf):
    return m.in_recent_periods(_account_cutoffs(spark, sf), v.AS_OF).drop("updated_at")


@query(
    """SELECT fecha::VARCHAR AS fecha, unique_concept, cuenta,
              period || ' ' || cuenta || '.csv' AS closed_name, cuenta || '_descarga ' || period || '.csv' AS open_name,
              strftime(fecha, '%Y-%m-%d') || '_credito.csv' AS closed_snapshot,
              period || '/' || strftime(fecha, '%Y-%m-%d') || '_debito.csv' AS current_snapshot
       FROM movements""",
    "movements",
)
def file_names(spark, sf):
    rows = v.movements(spark, sf).withColumns(
        {"account": F.col("cuenta"), "original_name": F.concat(F.lit("descarga "), F.col("period"), F.lit(".csv"))}
    )
    return (
        rows.withColumn("status", F.lit("closed"))
        .withColumn("closed_name", m.statement_file_name())
        .withColumn("status", F.lit("open"))
        .withColumn("open_name", m.statement_file_name())
        .select(
            "fecha",
            "unique_concept",
            "cuenta",
            "closed_name",
            "open_name",
            m.snapshot_path(F.col("fecha"), "_credito.csv", "cerrado").alias("closed_snapshot"),
            m.snapshot_path(F.col("fecha"), "_debito.csv", "corriente").alias("current_snapshot"),
        )
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS file_date
    FROM orders""")
def file_date_from_name(spark, sf):
    prefix = F.when(F.col("o_orderpriority") == "5-LOW", "latest").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    name = F.concat(prefix, F.lit("_debito_"), F.col("o_orderstatus"), F.lit(".csv"))
    return v.table(spark, sf, "orders").select("o_orderkey", fs.file_date_from_name(name).alias("file_date"))


@query("""
    SELECT event_id, event_type IN ('view', 'click') AS is_debit, event_type = 'view' AS exact_debit FROM events""")
def header_subset(spark, sf):
    """Headers built from events: the debit header, the same in another order with an extra column, others."""
    debit = HEADERS["debit"]
    header = (
        F.when(F.col("event_type") == "view", F.array(*[F.lit(h) for h in debit]))
        .when(F.col("event_type") == "click", F.array(*[F.lit(h) for h in ("Nota", *reversed(debit))]))
        .otherwise(F.array(F.col("event_type")))
    )
    return v.table(spark, sf, "events").select(
        "event_id",
        fs.holds_columns(header, debit).alias("is_debit"),
        F.coalesce(fs.exact_contract(header) == "debit", F.lit(False)).alias("exact_debit"),
    )


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'debit' WHEN 'click' THEN 'credit' WHEN 'error' THEN 'instalment'
                     END AS contract
    FROM events""")
def header_contracts(spark, sf):
    """All contract families against one header per event."""
    pick = F.when(F.col("event_type") == "signup", F.array(F.lit("Fecha")))
    for kind, event in (("debit", "view"), ("credit", "click"), ("instalment", "error")):
        pick = pick.when(F.col("event_type") == event, F.array(*[F.lit(h) for h in HEADERS[kind]]))
    header = pick.otherwise(F.reverse(F.array(*[F.lit(h) for h in HEADERS["credit"]])))
    return v.table(spark, sf, "events").select("event_id", fs.exact_contract(header).alias("contract"))


@query(
    """SELECT DISTINCT file_name, min(account_number) OVER (PARTITION BY file_name) AS cuenta
       FROM (SELECT DISTINCT period || ' ' || cuenta || CASE estado WHEN 'abierto' THEN ' y 00007.csv' ELSE '.csv' END
                    AS file_name FROM movements) f
       JOIN accounts ON contains(file_name, account_number)""",
    "movements",
    "accounts",
)
def account_tag(spark, sf):
    """Statement names, some naming two accounts; the account comes out of the name alone."""
    ending = F.when(F.col("estado") == "abierto", " y 00007.csv").otherwise(".csv")
    names = v.movements(spark, sf).select(F.concat(F.concat_ws(" ", "period", "cuenta"), ending).alias("file_name"))
    return fs.tag_accounts(names.distinct(), v.accounts(spark, sf))


@query("""
    SELECT event_type AS folder, 'download ' || lpad(event_id::VARCHAR, 12, '0') || '.csv' AS file_name
    FROM events WHERE event_type <> 'error'
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def newest_file(spark, sf):
    """Events as downloads: the newest per folder that was not there before."""
    listing = v.table(spark, sf, "events").select(
        F.col("event_type").alias("folder"),
        F.concat(F.lit("download "), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".csv")).alias("file_name"),
        F.col("ts").alias("file_modification_time"),
    )
    known = listing.filter(F.col("folder") == "error")
    return newest(listing, known, ["folder"]).select("folder", "file_name")


# --- documents -------------------------------------------------------------------------------------------------------
@query(
    f"""SELECT {_KEY}, has_pdf, has_csv, CASE WHEN has_pdf THEN 'Has PDF' ELSE 'No PDF' END AS pdf_status,
               updated_at::VARCHAR AS updated_at FROM flags""",
    "flags",
)
def doc_flags(spark, sf):
    return _flags(spark, sf)


@query(
    """SELECT DISTINCT 'open' AS cutoff_period, account_number, type FROM flags f
       WHERE cutoff_period LIKE '2001-%' AND NOT EXISTS (
           SELECT 1 FROM flags o WHERE o.cutoff_period = 'open' AND o.account_number = f.account_number AND o.type = f.type)""",
    "flags",
)
def missing_open_docs(spark, sf):
    return m.missing_open_documents(_flags(spark, sf), v.AS_OF)


@query(_using(f"SELECT {_KEY} FROM pending_csv", _PENDING_CSV), "flags")
def pending_csv(spark, sf):
    return m.pending_csv(_flags(spark, sf), v.AS_OF)


@query(
    _using(
        f"""SELECT {_KEY} FROM pending_csv UNION SELECT {_KEY} FROM flags
            WHERE cutoff_period = 'open' AND updated_at::DATE < DATE '{v.AS_OF}'""",
        _PENDING_CSV,
    ),
    "flags",
)
def pending_csv_refresh_open(spark, sf):
    return m.pending_csv(_flags(spark, sf), v.AS_OF, refresh_open=True)


@query(
    _using(
        f"""SELECT {_KEY} FROM pending_csv UNION ALL
            SELECT DISTINCT 'open', account_number, type FROM flags f WHERE cutoff_period LIKE '2001-%' AND NOT EXISTS (
                SELECT 1 FROM flags o WHERE o.cutoff_period = 'open' AND o.account_number = f.account_number)""",
        _PENDING_CSV,
    ),
    "flags",
)
def pending_csv_with_open(spark, sf):
    """Open documents are created first, and then wait for their CSV like the others."""
    return m.pending_csv(m.with_open_documents(_flags(spark, sf), v.AS_OF), v.AS_OF)


@query(_using(f"SELECT {_KEY} FROM pending_pdf", _PENDING_PDF), "flags")
def pending_pdf(spark, sf):
    return m.pending_pdf(_flags(spark, sf), v.AS_OF)


@query(
    _using(f"SELECT {_KEY}, filename, filetype FROM expected", _PENDING_CSV, _PENDING_PDF, _EXPECTED), "flags"
)
def expected_files(spark, sf):
    return m.expected_files(_flags(spark, sf), v.AS_OF)


@query(
    _using(
        f"SELECT {_KEY}, filename, filetype FROM expected WHERE filename IN (SELECT file_name FROM files)",
        _PENDING_CSV,
        _PENDING_PDF,
        _EXPECTED,
        _FILES,
    ),
    "flags",
    "ledger",
)
def files_to_attach(spark, sf):
    return m.files_to_attach(_flags(spark, sf), _files(spark, sf), v.AS_OF)


@query(
    _using(
        """SELECT file_name, split_part(file_name, '_', 1) AS cutoff_period, split_part(file_name, '_', 2) AS account_number,
                  replace(split_part(file_name, '_', 3), '.pdf', '') AS type
           FROM files WHERE file_name LIKE '%.pdf'""",
        _FILES,
    ),
    "ledger",
    "accounts",
)
def parse_file_names(spark, sf):
    return m.parse_document_names(_files(spark, sf))


_NO_PDF = f"""no_pdf AS (
    SELECT a.*, cutoff_period || '_' || account_number || '_' || type || '.pdf' AS filename FROM account_cutoffs a
    WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE has_pdf AND f.cutoff_period = a.cutoff_period
                      AND f.account_number = a.account_number AND f.type = a.type))"""


@query(_using(f"SELECT {_KEY} FROM no_pdf", _NO_PDF), "account_cutoffs", "flags")
def cutoffs_without_pdf(spark, sf):
    return m.without_pdf(_account_cutoffs(spark, sf), _flags(spark, sf)).select(*DOCUMENT_KEY)


@query(
    _using(f"SELECT {_KEY}, filename FROM no_pdf WHERE filename IN (SELECT file_name FROM files)", _NO_PDF, _FILES),
    "account_cutoffs",
    "flags",
    "ledger",
)
def pending_upload_plan(spark, sf):
    plan = m.pending_uploads(_account_cutoffs(spark, sf), _flags(spark, sf), _files(spark, sf))
    return plan.drop("updated_at")


@query(
    _using(
        f"SELECT {_KEY}, file_name FROM no_pdf LEFT JOIN files ON filename = file_name",
        _NO_PDF,
        _FILES,
    ),
    "account_cutoffs",
    "flags",
    "ledger",
)
def documents_to_sync(spark, sf):
    rows = m.documents_to_sync(_account_cutoffs(spark, sf), _flags(spark, sf), _files(spark, sf))
    return rows.select(*DOCUMENT_KEY, "file_name")


_PAYLOAD = """coalesce(length(pdf_file), -1) AS pdf_length, coalesce(length(csv_file), -1) AS csv_length"""


def _stored_documents(spark, sf):
    """The document table as it is stored: references in place of bytes."""
    return staged(by_reference(v.documents(spark, sf)), "documents")


def _payload_lengths(df):
    lengths = [F.coalesce(f"{p}_length", F.lit(-1)).alias(f"{p}_length") for p in ("pdf", "csv")]
    return df.select(*DOCUMENT_KEY, F.col("updated_at"), *lengths)


@query(
    _using(
        f"""SELECT cutoff_period, account_number, type, updated_at::VARCHAR AS updated_at, {_PAYLOAD} FROM (
                SELECT coalesce(a.cutoff_period, d.cutoff_period) AS cutoff_period,
                       coalesce(a.account_number, d.account_number) AS account_number, coalesce(a.type, d.type) AS type,
                       CASE WHEN a.type IS NULL THEN d.updated_at ELSE TIMESTAMP '{v.RUN_TS}' END AS updated_at,
                       coalesce(file_name, pdf_file) AS pdf_file, csv_file
                FROM documents_t d FULL JOIN (SELECT n.*, file_name FROM no_pdf n LEFT JOIN files ON filename = file_name) a
                  ON d.cutoff_period = a.cutoff_period AND d.account_number = a.account_number AND d.type = a.type) u""",
        _NO_PDF,
        _FILES,
    ),
    "account_cutoffs",
    "flags",
    "ledger",
)
def doc_upsert(spark, sf):
    """Every cutoff without PDF is written; the bytes of a file are its name here."""
    stored = _stored_documents(spark, sf)  # its flags are stored too: the documents are made once
    flags = by_merge(m.document_flags(stored))
    waiting = m.documents_to_sync(_account_cutoffs(spark, sf), flags, _files(spark, sf))
    content = F.col("file_name").cast("binary")
    incoming = waiting.withColumns({"pdf_hash": F.sha2(content, 256), "pdf_length": F.length(content).cast("long")})
    return _payload_lengths(k.document_upsert(stored, incoming))


def _arrived(spark, sf):
    """Files for the documents' accounts in all months, named after them; the content is the name."""
    content = F.col("file_name").cast("binary")
    kept = _files(spark, sf).select(
        "file_name", F.sha2(content, 256).alias("content_hash"), F.length(content).cast("long").alias("content_length")
    )
    return keyed_references({"pdf": kept})


_PDFS = """pdfs AS (SELECT file_name, split_part(file_name, '_', 1) AS p, split_part(file_name, '_', 2) AS a
                    FROM files WHERE file_name LIKE '%.pdf')"""


@query(
    _using(
        f"""SELECT {_KEY}, CASE WHEN p IS NULL THEN updated_at ELSE TIMESTAMP '{v.RUN_TS}' END::VARCHAR AS updated_at,
                   coalesce(length(file_name), length(pdf_file), -1) AS pdf_length,
                   coalesce(length(csv_file), -1) AS csv_length
            FROM documents_t LEFT JOIN pdfs ON p = cutoff_period AND a = account_number""",
        _FILES,
        _PDFS,
    ),
    "documents_t",
    "ledger",
)
def doc_attach(spark, sf):
    return _payload_lengths(k.document_attach(_stored_documents(spark, sf), _arrived(spark, sf), v.run_ts()))


@query(
    _using(
        """SELECT p AS cutoff_period, a AS account_number, file_name AS pdf_filename FROM pdfs
           WHERE NOT EXISTS (SELECT 1 FROM documents_t d WHERE d.cutoff_period = p AND d.account_number = a
                             AND d.updated_at < TIMESTAMP '2001-01-01')""",
        _FILES,
        _PDFS,
    ),
    "documents_t",
    "ledger",
)
def doc_unmatched(spark, sf):
    """Files of months that have no document yet: only documents of earlier years are stored."""
    before = _stored_documents(spark, sf).filter(F.col("updated_at") < F.lit("2001-01-01").cast("timestamp"))
    return k.unmatched_files(before, _arrived(spark, sf)).select("cutoff_period", "account_number", "pdf_filename")


@query(
    f"""SELECT fecha::VARCHAR AS fecha, unique_concept, cuenta, file_date::VARCHAR AS file_date FROM movements
        WHERE file_date = (SELECT max(file_date) FROM movements
                           WHERE file_date IN (DATE '{v.AS_OF}' + 1, DATE '{v.AS_OF}'))""",
    "movements",
)
def latest_snapshot(spark, sf):
    """Movements as daily snapshots: that of the day, else of the day before."""
    return newest_snapshot(
        m.snapshots_of(v.movements(spark, sf), "file_date", F.date_add(v.day(v.AS_OF), 1))
    ).select("fecha", "unique_concept", "cuenta", "file_date")
