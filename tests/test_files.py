"""Statement and document files as banks and people name them, through whole jobs."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import D, M, document, documents, movement, movements
from ledgerwise.contracts import CONCEPTS, HEADERS, RENAMES
from ledgerwise.operators.calendar import cutoff_days
from ledgerwise.plans import workflows as w
from ledgerwise.shared import new_path
from ledgerwise.sources import files as fs
from ledgerwise.sources import store
from ledgerwise.sources.documents import binary_files, keyed_payloads
from ledgerwise.sources.statements import concat_files, normalize_columns, statement_movements
from ledgerwise.streaming.ingest import ingest_statements

DEBIT, CREDIT = ",".join(HEADERS["debit"]), ",".join(HEADERS["credit"])


def run_ts():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([("0639", "debit"), ("39 2", "debit"), ("777", "credit")], "account_number string, type string")


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")


@pytest.fixture
def closed(tmp_path):
    folder = str(tmp_path / "closed")
    write(folder, "2024-03 0639.csv", DEBIT, "05/03/2024,SPEI 123-45,10.50,,100", "06/03/2024,PAGO NÓMINA,,20,120", "bad,---,1,,")
    write(folder, "2024-02 0639+x%.csv", DEBIT, "05/02/2024,\"SPEI 9, uno\",nan,3.00,5")
    write(folder, "2024-03 777.csv", CREDIT, "2024-03-10 10:11:12,COMPRA 5,,7.25,1234", "2024-03-11,COMPRA 6,1, NaN ,1234")
    write(folder, "2024-03 0639 reordered.csv", "Concepto,Fecha,Cargos,Abonos,Saldos", "x,05/03/2024,1,1,1")
    write(folder, "2024-03 nobody.csv", DEBIT, "05/03/2024,x,1,1,1")
    write(folder, "notes 0639.txt", DEBIT, "05/03/2024,x,1,1,1")
    write(folder, "empty 0639.csv")
    return folder


def test_manifest_accepts_exact_headers_of_known_accounts(spark, rows, closed, accounts):
    got = rows(fs.statement_manifest(spark, closed, accounts), "file_name", "contract", "cuenta")
    assert got == [
        ("2024-02 0639+x%.csv", "debit", "0639"),
        ("2024-03 0639.csv", "debit", "0639"),
        ("2024-03 777.csv", "credit", "777"),
    ]


def test_header_subset(spark, rows, closed):
    headers = fs.with_headers(fs.list_files(spark, closed))
    fits = headers.filter(fs.holds_columns(F.col("header"), ["Fecha", "Saldos"]))
    assert len(rows(fits, "file_name")) == 4


def test_account_in_name_is_the_lowest(spark, rows, accounts):
    files = spark.createDataFrame([("x0639 2024.csv",), ("777 0639",), ("none",), ("",), ("777",)], "file_name string")
    assert rows(fs.tag_accounts(files, accounts)) == [("777 0639", "0639"), ("777", "777"), ("x0639 2024.csv", "0639")]


def test_only_files_of_the_day(spark, closed):
    day = date(2024, 3, 1)
    stamp = 1709280000 + 3600
    os.utime(os.path.join(closed, "2024-03 0639.csv"), (stamp, stamp))
    names = [r["file_name"] for r in fs.created_on(fs.list_files(spark, closed), day).collect()]
    assert names == ["2024-03 0639.csv"]


def test_typed_movements(spark, rows, closed, accounts):
    manifest = fs.statement_manifest(spark, closed, accounts)
    got = statement_movements(spark, closed, manifest, "cerrado")
    assert rows(got, "kind", "fecha", "unique_concept", "cargo", "abono", "saldo", "period") == [
        ("credit", D("2024-03-10"), "5", M("7.25"), None, None, "2024-03"),
        ("credit", D("2024-03-11"), "6", None, M("1.00"), None, "2024-03"),
        ("debit", D("1900-01-01"), None, M("1.00"), None, None, "2024-03"),
        ("debit", D("2024-02-05"), "9", None, M("3.00"), M("5.00"), "2024-02"),
        ("debit", D("2024-03-05"), "12345", M("10.50"), None, M("100.00"), "2024-03"),
        ("debit", D("2024-03-06"), "PAGONÓMINA", None, M("20.00"), M("120.00"), "2024-03"),
    ]
    strict = statement_movements(spark, closed, manifest, "cerrado", null_date=False)
    assert strict.filter("fecha IS NULL").count() == 1
    opened = statement_movements(spark, closed, manifest, "abierto", "2024-12-05")
    assert {(r["kind"], r["period"]) for r in opened.collect()} == {("debit", "2024-12"), ("credit", "2025-01")}


def test_normalize_columns(spark):
    frame = spark.createDataFrame([("a", 1, 2)], "Fecha string, Cargos int, `Otro x` int")
    normalized, missing, extra = normalize_columns(frame, RENAMES["debit"])
    assert (normalized.columns, missing, extra) == (["fecha", "cargo"], ["concepto", "abono", "saldo"], ["Otro x"])


def test_concat_of_nothing_has_the_schema(spark):
    assert concat_files([], spark).columns == movements(spark).columns


def make_ledger(spark, accounts):
    return w.Ledger(spark, new_path(spark, "test-ledger"), accounts)


def test_daily_load(spark, rows, closed, accounts, tmp_path):
    opened = str(tmp_path / "open")
    write(opened, "0639_mov.csv", DEBIT, "05/03/2024,SPEI 123-45,10.50,,100", "01/04/2024,NUEVO,2,,98")
    ledger, today = make_ledger(spark, accounts), spark.range(1).select(F.current_date()).first()[0]
    for _ in range(2):
        loaded = w.load_statements(ledger, closed, opened, today, run_ts())
    assert rows(ledger.movements("debit", "cerrado"), "unique_concept") == [("12345",), ("9",), ("PAGONÓMINA",)]
    assert rows(ledger.movements("debit", "abierto"), "unique_concept") == [("12345",), ("NUEVO",)]
    assert ledger.movements("credit", "cerrado").count() == 2 and ledger.movements("credit", "abierto").count() == 0
    assert rows(ledger.concepts("debit"), "unique_concept", "estado") == [
        ("12345", "abierto"), ("9", "cerrado"), ("NUEVO", "abierto"), ("PAGONÓMINA", "cerrado"),
    ]
    assert rows(loaded["rejects"], "reason", "file_name") == [("unique_concept", "2024-03 0639.csv")]

    plan = w.plan_downloads(ledger, cutoff_days(spark.createDataFrame([(2024,)], "year_value int")), "2024-04-10", run_ts())
    closed_plan = rows(plan.filter("status = 'closed'"), "account", "period")
    assert closed_plan == [("0639", "2024-04"), ("39 2", "2024-03"), ("39 2", "2024-04"), ("777", "2024-04")]


def test_nothing_is_lost_to_dialect_or_unreadable_amounts(spark, rows, accounts, tmp_path):
    folder, opened = str(tmp_path / "odd"), str(tmp_path / "none")
    write(
        folder, "2024-03 0639.csv", DEBIT,
        '05/03/2024,SPEI 1,"1,000.00",,', '05/03/2024,SPEI 1,"2,000.00",,', '06/03/2024,"PAGO ""A, B"" 12",5,,',
        "07/03/2024,UNO,DOS 7,8,,9", "08/03/2024,NaN,3,,",
    )
    write(opened, "skipped.csv", DEBIT)
    ledger, today = make_ledger(spark, accounts), spark.range(1).select(F.current_date()).first()[0]
    loaded = w.load_statements(ledger, folder, opened, today, run_ts())
    assert rows(loaded["debito_cerrado"], "concepto", "unique_concept") == [('PAGO "A, B" 12', "12")]
    assert rows(loaded["rejects"], "reason") == [("cargo",), ("cargo",), ("columns",), ("unique_concept",)]
    assert "SPEI 1,1,000.00" in {r["raw"] and r["raw"][11:] for r in loaded["rejects"].collect()}


@pytest.mark.parametrize("broken", range(4))
def test_a_load_that_crashes_is_made_good_by_the_next(spark, rows, closed, accounts, tmp_path, monkeypatch, broken):
    """Each write of the closed load fails in turn; afterwards all is as if none had."""
    opened = str(tmp_path / "none")
    write(opened, "skipped.csv", DEBIT)
    ledger, today = make_ledger(spark, accounts), spark.range(1).select(F.current_date()).first()[0]
    merge, calls = store.merge_parts, []

    def failing(*args, **more):
        calls.append(1)
        if len(calls) == broken + 1:
            raise OSError("lost")
        merge(*args, **more)

    monkeypatch.setattr(store, "merge_parts", failing)
    with pytest.raises(OSError):
        w.load_statements(ledger, closed, opened, today, run_ts())
    w.load_statements(ledger, closed, opened, today, run_ts())
    for kind in ("debit", "credit"):
        keys = rows(ledger.movements(kind, "cerrado"), "fecha", "unique_concept", "cargo", "abono")
        assert keys and rows(ledger.concepts(kind), "fecha", "unique_concept", "cargo", "abono") == keys


def test_closed_files_again_leave_open_classifications_alone(spark, rows, closed, accounts, tmp_path):
    opened = str(tmp_path / "open")
    write(opened, "0639_mov.csv", DEBIT, "05/03/2024,SPEI 123-45,10.50,,100")
    ledger, today = make_ledger(spark, accounts), spark.range(1).select(F.current_date()).first()[0]
    w.load_statements(ledger, closed, opened, today, run_ts())
    before = rows(ledger.concepts("debit"), "unique_concept", "estado")
    assert ("12345", "abierto") in before
    tables = {"debit": ledger.path("debito_cerrado")}
    concepts = {"debit": ledger.path("debito_conceptos")}
    ingest_statements(
        spark, closed, accounts, tables, ledger.path("checkpoint"), run_ts(), concepts
    ).awaitTermination()
    assert rows(ledger.concepts("debit"), "unique_concept", "estado") == before


def test_two_files_of_one_name_are_one_document(spark, tmp_path):
    from ledgerwise.sources.documents import binary_files

    for place, text in (("a", "old"), ("b", "old too")):
        write(str(tmp_path / "docs" / place), "2024-01_0639_debit.pdf", text)
    found = binary_files(spark, str(tmp_path / "docs")).collect()
    assert [r["file_name"] for r in found] == ["2024-01_0639_debit.pdf"]


def test_stream_finds_only_new_files(spark, rows, closed, accounts):
    root = new_path(spark, "test-stream")
    tables = {k: f"{root}/{k}" for k in ("debit", "credit")}
    concepts = {k: f"{root}/{k}_conceptos" for k in tables}

    def run():
        query = ingest_statements(spark, closed, accounts, tables, f"{root}/checkpoint", run_ts(), concepts)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() > 0
    assert run() == 0
    write(closed, "2024-04 0639.csv", DEBIT, "05/03/2024,SPEI 12345,10.50,,1", "07/04/2024,OTRO 8,1,,")
    run()
    assert rows(store.read_parts(spark, tables["debit"]), "unique_concept", "file_name") == [
        ("12345", "2024-04 0639.csv"), ("8", "2024-04 0639.csv"), ("9", "2024-02 0639+x%.csv"),
        ("PAGONÓMINA", "2024-03 0639.csv"),
    ]
    assert store.read_parts(spark, tables["credit"]).count() == 2
    assert store.read_parts(spark, concepts["debit"], CONCEPTS).count() == 4


def test_binary_documents(spark, rows, tmp_path):
    folder = str(tmp_path / "docs")
    write(folder, "2024-01_0639_debit.pdf", "pdf bytes")
    write(folder, "odd.pdf", "x")
    got = keyed_payloads(binary_files(spark, folder), "pdf")
    assert rows(got, "cutoff_period", "account_number", "type", "pdf_file") == [("2024-01", "0639", "debit", bytearray(b"pdf bytes\n"))]


def test_document_jobs(spark, rows, accounts, tmp_path):
    folder = str(tmp_path / "docs")
    ledger = make_ledger(spark, accounts)
    days = cutoff_days(spark.createDataFrame([(2024,)], "year_value int"))
    w.plan_downloads(ledger, days, "2024-02-10", run_ts())
    write(folder, "other.pdf", "x")
    assert not w.sync_pdf_documents(ledger, folder)
    write(folder, "2024-01_0639_debit.pdf", "january")
    assert w.sync_pdf_documents(ledger, folder)
    assert ledger.documents().count() == 6
    assert rows(ledger.documents().filter("has_pdf"), "cutoff_period", "account_number") == [("2024-01", "0639")]
    write(folder, "open_0639_debit.csv", "open rows")
    write(folder, "2024-02_0639_debit.pdf", "february")
    write(folder, "2024-02_0639_debit.csv", "rows of february")
    attached = w.attach_documents(ledger, folder, "2024-02-15", run_ts())
    assert rows(attached, "filename") == [("2024-02_0639_debit.csv",), ("2024-02_0639_debit.pdf",), ("open_0639_debit.csv",)]
    assert ledger.documents().count() == 9
    full = ledger.documents().filter("account_number = '0639'")
    assert rows(full, "cutoff_period", "has_pdf", "has_csv", "pdf_filename") == [
        ("2024-01", True, False, None), ("2024-02", True, True, "2024-02_0639_debit.pdf"), ("open", False, True, None),
    ]
    assert w.attach_documents(ledger, folder, "2024-02-15", run_ts()).count() == 0


def test_snapshots(spark, rows):
    root = new_path(spark, "test-snapshots")
    assert store.load_latest_snapshot(spark, root, date(2024, 3, 2)) is None
    store.save_snapshot(movements(spark, movement("2024-03-01", "old")), root, date(2024, 3, 1))
    assert rows(store.load_latest_snapshot(spark, root, date(2024, 3, 2)), "unique_concept", "file_date") == [("old", D("2024-03-01"))]
    store.save_snapshot(movements(spark, movement("2024-03-01", "new")), root, date(2024, 3, 2))
    assert rows(store.load_latest_snapshot(spark, root, date(2024, 3, 2)), "unique_concept") == [("new",)]
    assert store.load_latest_snapshot(spark, root, date(2024, 3, 4)) is None


def test_daily_file_of_today_or_yesterday(spark, rows, tmp_path):
    root = str(tmp_path)
    write(f"{root}/2024-02", "2024-02-29_debito.csv", DEBIT, "05/03/2024,x,1,,1")
    got = store.read_daily_file(spark, root, date(2024, 3, 1), "_debito.csv")
    assert rows(got, "Concepto", "file_date", "file_name") == [("x", D("2024-02-29"), "2024-02-29_debito.csv")]
    assert store.read_daily_file(spark, root, date(2024, 3, 2), "_debito.csv") is None
    assert store.read_daily_file(spark, root, date(2024, 2, 29), "_credito.csv") is None


def test_reports_over_the_last_months_skip_older_partitions(spark, rows):
    path = new_path(spark, "test-since")
    store.overwrite_parts(movements(spark, movement("2024-01-01", "1"), movement("2024-03-01", "2")), path)
    recent = store.read_parts(spark, path, since="2024-02")
    assert "PartitionFilters: [isnotnull(part" in recent._jdf.queryExecution().executedPlan().toString()
    assert rows(recent, "unique_concept") == [("2",)]


def test_empty_sets_are_not_exported(spark):
    root = new_path(spark, "test-export")
    store.export_sets({"full": spark.range(1), "none": spark.range(0)}, root, skip_empty=True)
    assert store.exists(spark, f"{root}/full") and not store.exists(spark, f"{root}/none")


def test_publish_switches_all_tables(spark):
    root = new_path(spark, "test-publish")
    for version, n in (("1", 1), ("2", 2)):
        store.publish({"a": spark.range(n), "b": spark.range(n + 1)}, root, version)
        assert [store.read_published(spark, root, t).count() for t in ("a", "b")] == [n, n + 1]


def test_overwrite_may_read_what_it_replaces(spark, rows):
    path = new_path(spark, "test-overwrite")
    store.overwrite_parts(movements(spark, movement("2024-03-01", "1"), movement("2024-04-01", "2")), path)
    store.overwrite_parts(store.read_parts(spark, path).filter("unique_concept = '2'"), path)
    assert rows(store.read_parts(spark, path), "unique_concept") == [("2",)]


def test_stored_flags_spare_the_payloads(spark):
    from ledgerwise.operators.manifests import document_flags, pending_pdf
    from ledgerwise.sources.documents import with_stored_flags

    path = new_path(spark, "test-flags")
    with_stored_flags(documents(spark, document("2024-01", "1", pdf_file=b"p"))).write.parquet(path)
    pending = pending_pdf(document_flags(spark.read.parquet(path)), "2024-02-01")
    assert "pdf_file" not in pending._jdf.queryExecution().executedPlan().toString()
