"""Files and streams: the orders written as statement files, one per nation and kind, and read back.

The folders are new on every run and lie in the shared directory of the session.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import HEADERS, MOVEMENT_KEY
from ledgerwise.operators.joins import by_merge
from ledgerwise.plans import views as v
from ledgerwise.plans import workflows
from ledgerwise.plans.registry import query
from ledgerwise.shared import new_path, staged
from ledgerwise.sources import files as fs
from ledgerwise.sources import store
from ledgerwise.sources.documents import (
    binary_files,
    held_hashes,
    keep_payloads,
    keyed_payloads,
    keyed_references,
    newest_of_each_name,
)
from ledgerwise.sources.statements import concat_files, statement_movements
from ledgerwise.streaming.ingest import ingest_statements, report_of
from ledgerwise.streaming.ingest import stream_rejects as rejects_of_stream

KINDS = ("debit", "credit")
_OUT = ("fecha", "unique_concept", "concepto", "cargo", "abono", "saldo", "estado", "cuenta", "period", "file_name")


def _nation_account(kind):
    return F.concat(F.lit("1" if kind == "debit" else "2"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))


def nation_accounts(spark, sf) -> DataFrame:
    """A debit and a credit account per nation."""
    nations = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    parts = [nations.select(_nation_account(k).alias("account_number"), F.lit(k).alias("type")) for k in KINDS]
    return concat_files(parts)


def _by_nation(spark, sf, kind, estado):
    rows = v.movements(spark, sf, kind, estado)
    owners = v.table(spark, sf, "customer").select(v.account_number("c_custkey").alias("cuenta"), "c_nationkey")
    return rows.join(by_merge(owners), "cuenta").withColumn("account", _nation_account(kind))


def write_statements(spark, sf, estado: str) -> str:
    """Folder with one statement per nation and kind, and one file per nation that fits no contract."""
    folder = new_path(spark, f"statements-{estado}")
    for kind in KINDS:
        rows = _by_nation(spark, sf, kind, estado)
        header = HEADERS[kind]
        name = F.concat(F.lit("2001-06 "), F.col("account"), F.lit(".csv"))
        if estado == "abierto":
            name = F.concat_ws("_", "account", F.lit("descarga.csv"))
        values = {
            "Fecha": F.date_format("fecha", "dd/MM/yyyy" if kind == "debit" else "yyyy-MM-dd"),
            "Concepto": F.concat(F.lit("  "), F.col("concepto")),
            "Cargos": F.col("cargo"), "Cargo": F.col("cargo"),
            "Abonos": F.col("abono"), "Abono": F.coalesce(F.col("abono").cast("string"), F.lit("NaN")),
            "Saldos": F.col("cargo"), "Tarjeta": F.col("cuenta"),
        }
        statement = rows.select(*[values[c].cast("string").alias(c) for c in header], name.alias("file"))
        statement.hint("rebalance", "file").write.mode("append").partitionBy("file").option("header", True).csv(folder)
        if kind == "credit":
            other = statement.select("Concepto", "Fecha", F.concat(F.lit("otro "), F.col("file")).alias("file"))
            other.hint("rebalance", "file").write.mode("append").partitionBy("file").option("header", True).csv(folder)
    return folder


_NATIONS = f"""nations AS (
    SELECT m.*, type, CASE type WHEN 'debit' THEN '1' ELSE '2' END || lpad(c_nationkey::VARCHAR, 4, '0') AS account
    FROM movements m JOIN customer ON {v._sql_account("c_custkey")} = cuenta
    JOIN accounts ON account_number = cuenta)"""
_EXPORTED = """m.fecha::VARCHAR AS fecha, m.unique_concept, m.cargo::DECIMAL(12,2)::VARCHAR AS cargo,
    m.abono::DECIMAL(12,2)::VARCHAR AS abono, m.cuenta, m.estado, nullif(k.category_group, '') AS category_group"""
_STATEMENT = """fecha::VARCHAR AS fecha, unique_concept, concepto, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono,
    CASE type WHEN 'debit' THEN cargo::DOUBLE END AS saldo, estado, account AS cuenta"""
_CLOSED = f""", {_NATIONS} SELECT {_STATEMENT}, '2001-06' AS period, '2001-06 ' || account || '.csv' AS file_name
    FROM nations WHERE estado = 'cerrado'"""


def _scan(spark, sf, estado, as_of=None):
    folder, people = write_statements(spark, sf, estado), nation_accounts(spark, sf)
    manifest = staged(fs.statement_manifest(spark, folder, people, as_of), "manifest")
    return statement_movements(spark, folder, manifest, estado, v.AS_OF)


def _today(spark) -> date:
    return spark.range(1).select(F.current_date()).first()[0]


@query(_CLOSED, "movements", "accounts")
def statement_scan(spark, sf):
    """All closed statements of both kinds; the files of the third sort are skipped."""
    return _scan(spark, sf, "cerrado").select(*_OUT)


@query(
    f""", {_NATIONS} SELECT {_STATEMENT}, CASE type WHEN 'debit' THEN '2001-07' ELSE '2001-08' END AS period,
             account || '_descarga.csv' AS file_name
        FROM nations WHERE estado = 'abierto'""",
    "movements",
    "accounts",
)
def today_statements(spark, sf):
    """Open statements are those written on the day of the run."""
    return _scan(spark, sf, "abierto", _today(spark)).select(*_OUT)


_FILE_OF = """CASE estado WHEN 'abierto' THEN account || '_descarga.csv' ELSE '2001-06 ' || account || '.csv' END"""


@query(
    f""", {_NATIONS} SELECT DISTINCT {_FILE_OF} AS file_name, type AS contract, 5::BIGINT AS n_columns FROM nations
        UNION ALL SELECT DISTINCT 'otro ' || {_FILE_OF}, NULL, 2 FROM nations WHERE type = 'credit'""",
    "movements",
    "accounts",
)
def header_contract(spark, sf):
    """Every file of both folders with the contract of its header."""
    folders = [write_statements(spark, sf, estado) for estado in ("cerrado", "abierto")]
    files = fs.with_headers(concat_files([fs.list_files(spark, folder) for folder in folders]))
    return files.select(
        "file_name", fs.exact_contract(F.col("header")).alias("contract"), F.size("header").cast("long").alias("n_columns")
    ).distinct()


def write_odd_statements(spark, sf) -> str:
    """Closed debit statements as banks write them: by the last digit of the number, thousands separators, quotes and
    commas inside the concept, a null marker for a concept, or a column too many."""
    folder, digit = new_path(spark, "statements-odd"), F.right(F.col("unique_concept"), F.lit(1))
    quoted = F.concat(F.lit('PAGO "A, B" '), F.col("unique_concept"))
    concept = F.when(digit == "2", quoted).when(digit == "3", "NaN").otherwise(F.col("concepto"))
    charge = F.when(digit == "1", F.format_number("cargo", 2)).otherwise(F.col("cargo").cast("string"))
    rows = _by_nation(spark, sf, "debit", "cerrado").select(
        F.date_format("fecha", "dd/MM/yyyy").alias("Fecha"),
        concept.alias("Concepto"),
        charge.alias("Cargos"),
        F.col("abono").cast("string").alias("Abonos"),
        F.lit(None).cast("string").alias("Saldos"),
        F.concat(F.lit("2001-06 "), F.col("account"), F.lit(".csv")).alias("file"),
    )
    rows.write.partitionBy("file").options(header=True, escape='"').csv(folder)
    return folder


@query(
    f""", {_NATIONS}, odd AS (SELECT *, right(unique_concept, 1) AS digit FROM nations
            WHERE estado = 'cerrado' AND type = 'debit')
        SELECT account AS cuenta, CASE WHEN digit = '1' AND cargo >= 1000 THEN 'cargo' WHEN digit = '3' THEN 'unique_concept'
               ELSE 'loaded' END AS reason, count(*) AS n_rows,
               sum(CASE WHEN digit = '3' OR digit = '1' AND cargo >= 1000 THEN 0 ELSE cargo END)::DOUBLE AS loaded_cargo
        FROM odd GROUP BY ALL""",
    "movements",
    "accounts",
)
def load_rejects(spark, sf):
    """What becomes of every written line: loaded, or refused with a reason."""
    folder, people = write_odd_statements(spark, sf), nation_accounts(spark, sf)
    manifest = staged(fs.statement_manifest(spark, folder, people), "manifest")
    rows = statement_movements(spark, folder, manifest, "cerrado")
    reason = F.coalesce("reason", F.when(F.col("unique_concept").isNull(), "unique_concept"), F.lit("loaded"))
    cargo = F.when(reason == "loaded", F.col("cargo")).otherwise(0)
    counted = rows.groupBy("cuenta", reason.alias("reason"))
    return counted.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(cargo).cast("double").alias("loaded_cargo"))


@query(
    f""", {_NATIONS}, odd AS (SELECT *, right(unique_concept, 1) AS digit FROM nations
            WHERE estado = 'cerrado' AND type = 'debit')
        SELECT account AS cuenta, CASE WHEN digit = '1' AND cargo >= 1000 THEN 'cargo' WHEN digit = '3' THEN 'unique_concept'
               ELSE 'loaded' END AS reason, count(*) AS n_rows FROM odd GROUP BY ALL""",
    "movements",
    "accounts",
)
def stream_rejects(spark, sf):
    """What becomes of every line that the stream reads: in the table, or among the rejects with its reason."""
    folder, people, root = write_odd_statements(spark, sf), nation_accounts(spark, sf), new_path(spark, "stream")
    checkpoint = f"{root}/checkpoint"
    stream = ingest_statements(spark, folder, people, {"debit": f"{root}/debit"}, checkpoint, v.run_ts(), max_files=20)
    stream.awaitTermination()
    loaded = store.read_parts(spark, f"{root}/debit").select("cuenta", F.lit("loaded").alias("reason"))
    away = rejects_of_stream(spark, report_of(checkpoint)).select("cuenta", "reason")
    return loaded.unionByName(away).groupBy("cuenta", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    f""", {_NATIONS} SELECT DISTINCT account || '_descarga.csv' AS file_name, true AS of_today FROM nations
        WHERE estado = 'abierto' UNION ALL
        SELECT DISTINCT 'otro ' || account || '_descarga.csv', true FROM nations
        WHERE estado = 'abierto' AND type = 'credit'""",
    "movements",
    "accounts",
)
def today_files(spark, sf):
    """Files of the day out of the listing, with their provenance."""
    files, today = fs.list_files(spark, write_statements(spark, sf, "abierto")), _today(spark)
    of_today = F.to_date("file_modification_time") == F.lit(today)
    return fs.created_on(files, today).select("file_name", of_today.alias("of_today")).distinct()


def write_documents(spark, sf, value) -> str:
    """Folder with a PDF per nation and kind that holds ``value`` of its movements."""
    folder = new_path(spark, "documents")
    for kind in KINDS:
        rows = _by_nation(spark, sf, kind, None).groupBy("account").agg(value.cast("string").alias("value"))
        name = F.concat(F.lit("2001-06_"), F.col("account"), F.lit(f"_{kind}.pdf"))
        rows.select("value", name.alias("file")).hint("rebalance", "file").write.mode("append").partitionBy("file").text(
            folder
        )
    return folder


@query(
    f""", {_NATIONS}, contents AS (
            SELECT account, type, max(strftime(fecha, '%Y-%m')) || chr(10) AS content FROM nations GROUP BY ALL)
        SELECT account AS account_number, type, sha256(content) AS pdf_hash, length(content) AS pdf_length,
               1::BIGINT AS copies, count(*) OVER (PARTITION BY content) AS documents
        FROM contents""",
    "movements",
    "accounts",
)
def payload_store(spark, sf):
    """Documents that hold the newest month of a nation, brought in twice: every content is stored once, however many
    documents refer to it."""
    folder, path = write_documents(spark, sf, F.max(F.date_format("fecha", "yyyy-MM"))), new_path(spark, "payloads")
    for _ in range(2):
        listed = newest_of_each_name(fs.list_files(spark, folder, "part-*"))
        references = staged(keyed_references({"pdf": keep_payloads(spark, listed, path)}), "references")
    copies = held_hashes(spark, path).groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))
    uses = references.groupBy("pdf_hash").agg(F.count(F.lit(1)).alias("documents"))
    counted = uses.join(by_merge(copies), F.col("pdf_hash") == F.col("content_hash"))
    return references.join(by_merge(counted), "pdf_hash").select("account_number", "type", "pdf_hash", "pdf_length", "copies", "documents")


@query(
    f""", {_NATIONS} SELECT '2001-06' AS cutoff_period, account AS account_number, type, 
               length(count(*)::VARCHAR) + 1 AS pdf_length
        FROM nations GROUP BY ALL""",
    "movements",
    "accounts",
)
def binary_scan(spark, sf):
    """A document per nation and kind, holding its number of movements; found by name, read as bytes."""
    folder = write_documents(spark, sf, F.count(F.lit(1)))
    payloads = keyed_payloads(binary_files(spark, folder, "part-*"), "pdf")
    return payloads.select(
        "cutoff_period", "account_number", "type", F.length("pdf_file").cast("long").alias("pdf_length")
    )


@query(_CLOSED, "movements", "accounts")
def stream_ingest(spark, sf):
    """The closed statements through the stream, twice: the second run finds nothing new."""
    folder, people = write_statements(spark, sf, "cerrado"), nation_accounts(spark, sf)
    root = new_path(spark, "stream")
    tables = {kind: f"{root}/{kind}" for kind in KINDS}
    for _ in range(2):
        stream = ingest_statements(spark, folder, people, tables, f"{root}/checkpoint", v.run_ts(), max_files=40)
        stream.awaitTermination()
    return concat_files([store.read_parts(spark, path) for path in tables.values()]).select(*_OUT)


@query(
    f""", {_NATIONS} SELECT fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono,
             concepto, account AS cuenta, estado, '{v.RUN_TS}' AS updated_at
        FROM nations""",
    "movements",
    "accounts",
)
def daily_load(spark, sf):
    """Closed and open statements loaded, classification tables in step: every movement is there, unclassified."""
    people = nation_accounts(spark, sf)
    ledger = workflows.Ledger(spark, new_path(spark, "ledger"), people)
    folders = [write_statements(spark, sf, estado) for estado in ("cerrado", "abierto")]
    workflows.load_statements(ledger, *folders, _today(spark), v.run_ts())
    columns = (*MOVEMENT_KEY, "concepto", "cuenta", "estado", "updated_at")
    return concat_files([ledger.concepts(kind) for kind in KINDS]).select(*columns)


_MOVEMENT = "fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono, cuenta"


@query(f"SELECT {_MOVEMENT}, '2001-07-30' AS file_date FROM movements", "movements")
def snapshot_of_yesterday(spark, sf):
    """No snapshot of the day: the one of the day before is taken."""
    root, as_of = new_path(spark, "snapshots"), date.fromisoformat(v.AS_OF)
    store.save_snapshot(v.movements(spark, sf), root, as_of - timedelta(days=1))
    store.save_snapshot(v.movements(spark, sf, estado="abierto"), root, as_of - timedelta(days=2))
    return store.load_latest_snapshot(spark, root, as_of).select(*MOVEMENT_KEY, "cuenta", "file_date")


@query(f"SELECT {_MOVEMENT} FROM movements", "movements")
def snapshot_fed(spark, sf):
    """A stored snapshot fed twice with overlapping movements."""
    path = new_path(spark, "snapshot")
    for rows in (v.stored(spark, sf), v.loaded(spark, sf)):
        store.feed_snapshot(rows, path, MOVEMENT_KEY)
    return store.read_table(spark, path).select(*MOVEMENT_KEY, "cuenta")


@query(
    f"""SELECT {_MOVEMENT}, '2001-07-30' AS file_date, '2001-07-30_todos.csv' AS file_name FROM movements
        WHERE estado = 'cerrado'""",
    "movements",
)
def snapshot_replaced(spark, sf):
    """A stored snapshot replaced by the daily file of the day before, as there is none of the day; two days later there is
    neither, and it stays."""
    root, path, as_of = new_path(spark, "daily"), new_path(spark, "snapshot"), date.fromisoformat(v.AS_OF)
    store.replace_table(v.movements(spark, sf, estado="abierto"), path)
    daily = v.movements(spark, sf, estado="cerrado").select(*MOVEMENT_KEY, "cuenta")
    store.export_sets({f"{as_of:%Y-%m}/2001-07-30_todos.csv": daily}, root, "csv")
    replaced = [store.replace_snapshot(spark, root, as_of + timedelta(days=n), "_todos.csv", path) for n in (0, 2)]
    assert replaced == [True, False]
    stored = store.read_table(spark, path)
    amounts = {c: F.col(c).cast("decimal(12,2)") for c in ("cargo", "abono")}
    return stored.withColumns(amounts).select(*MOVEMENT_KEY, "cuenta", "file_date", "file_name")


@query(f"SELECT {_MOVEMENT} FROM movements", "movements")
def export_sets(spark, sf):
    """One CSV data set per kind and state."""
    names = {f"{kind}_{estado}": (kind, estado) for kind in KINDS for estado in ("cerrado", "abierto")}
    root = new_path(spark, "export")
    store.export_sets({n: v.movements(spark, sf, *of).select(*MOVEMENT_KEY, "cuenta") for n, of in names.items()}, root, "csv")
    schema = "fecha date, unique_concept string, cargo decimal(12,2), abono decimal(12,2), cuenta string"
    return concat_files([spark.read.schema(schema).option("header", True).csv(f"{root}/{n}") for n in names])


@query(
    f""", {_NATIONS}, files AS (
            SELECT CASE type WHEN 'debit' THEN strftime(fecha, '%d/%m/%Y') ELSE strftime(fecha, '%Y-%m-%d') END AS fecha,
                   concepto, '2001-06 ' || account || '.csv' AS file_name FROM nations WHERE estado = 'cerrado'),
        firsts AS (SELECT *, min(file_name) OVER (PARTITION BY fecha, concepto) AS first_file FROM files)
        SELECT fecha, concepto, file_name FROM firsts WHERE file_name = first_file""",
    "movements",
    "accounts",
)
def feed_job(spark, sf):
    """A snapshot fed twice from a folder: files of all kinds that hold a date and a concept."""
    folder, path = write_statements(spark, sf, "cerrado"), new_path(spark, "fed")
    for _ in range(2):
        workflows.feed_from_files(spark, folder, ("Fecha", "Concepto"), path)
    stored = store.read_table(spark, path)
    return stored.select(F.col("Fecha").alias("fecha"), F.col("Concepto").alias("concepto"), "file_name")


def write_wide_statements(spark, sf) -> str:
    """Files of twelve columns, date and concept in the tenth and twelfth, one per nation; and files of three columns in
    another order that hold half of the same rows."""
    folder = new_path(spark, "statements-wide")
    rows = _by_nation(spark, sf, "debit", "cerrado")
    values = {f"Campo {i}": F.concat(F.lit(f"{i}-"), F.col("unique_concept")) for i in range(1, 10)}
    values |= {"Fecha": F.date_format("fecha", "dd/MM/yyyy"), "Sucursal": F.col("cuenta"), "Concepto": F.col("concepto")}
    wide = rows.select(*[c.alias(n) for n, c in values.items()], F.concat("account", F.lit(" a ancho.csv")).alias("file"))
    half = rows.filter(F.right(F.col("unique_concept"), F.lit(1)).isin("0", "2", "4", "6", "8")).withColumn("cargo", F.col("cargo").cast("string"))
    slim = half.select(
        F.col("concepto").alias("Concepto"), "cargo", F.date_format("fecha", "dd/MM/yyyy").alias("Fecha"),
        F.concat("account", F.lit(" b corto.csv")).alias("file"),
    )
    for statement in (wide, slim):
        statement.hint("rebalance", "file").write.mode("append").partitionBy("file").options(header=True, escape='"').csv(folder)
    return folder


@query(
    f""", {_NATIONS}, files AS (
            SELECT strftime(fecha, '%d/%m/%Y') AS fecha, concepto, '7-' || unique_concept AS campo, cuenta AS sucursal,
                   account || ' a ancho.csv' AS file_name FROM nations WHERE estado = 'cerrado' AND type = 'debit'),
        firsts AS (SELECT *, min(file_name) OVER (PARTITION BY fecha, concepto) AS first_file FROM files)
        SELECT fecha, concepto, campo, sucursal, file_name FROM firsts WHERE file_name = first_file""",
    "movements",
    "accounts",
)
def feed_wide(spark, sf):
    """A snapshot fed twice from files of different widths: rows come whole, by the names of their columns."""
    folder, path = write_wide_statements(spark, sf), new_path(spark, "fed")
    for _ in range(2):
        workflows.feed_from_files(spark, folder, ("Fecha", "Concepto"), path)
    stored = store.read_table(spark, path)
    assert stored.filter("line IS NOT NULL").isEmpty()
    named = {"Fecha": "fecha", "Concepto": "concepto", "Campo 7": "campo", "Sucursal": "sucursal"}
    return stored.select(*[F.col(c).alias(n) for c, n in named.items()], "file_name")


@query(
    f"""SELECT {_EXPORTED}, 'PAGO "A, B"' || chr(10) || m.concepto AS concepto
        FROM movements m LEFT JOIN concepts k ON m.fecha = k.fecha
        AND m.unique_concept = k.unique_concept AND m.cargo = k.cargo AND m.abono = k.abono""",
    "movements",
    "concepts",
)
def export_job(spark, sf):
    """The cells of a whole export: both kinds, closed and open, with their classification; concepts hold quotes, commas and
    line breaks."""
    odd = F.concat(F.lit('PAGO "A, B"\n'), F.col("concepto"))
    ledger, root = workflows.Ledger(spark, new_path(spark, "ledger"), v.accounts(spark, sf)), new_path(spark, "export")
    for kind in KINDS:
        for estado in ("cerrado", "abierto"):
            rows = v.movements(spark, sf, kind, estado).withColumn("concepto", odd)
            store.overwrite_parts(rows, ledger.path(f"{workflows.PREFIX[kind]}_{estado}"))
        store.overwrite_parts(v.concepts(spark, sf), ledger.path(f"{workflows.PREFIX[kind]}_conceptos"))
    workflows.export_ledger(ledger, root)
    reader = spark.read.options(header=True, escape='"', multiLine=True)
    cells = [reader.csv(f"{root}/cells/{workflows.PREFIX[kind]}") for kind in KINDS]
    columns = ("fecha", "unique_concept", "cargo", "abono", "cuenta", "estado", "category_group", "concepto")
    return concat_files(cells).select(*columns)
