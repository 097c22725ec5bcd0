"""Tables switched by a pointer, loads that lose nothing, payloads kept once."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from helpers import D, document, documents, movement, movements
from ledgerwise.contracts import HEADERS
from ledgerwise.operators.enrich import newest_first, newest_first_in_slots
from ledgerwise.operators.keyed import document_attach, document_upsert
from ledgerwise.plans import workflows as w
from ledgerwise.shared import new_path, shared_dir
from ledgerwise.sources import documents as ds
from ledgerwise.sources import files as fs
from ledgerwise.sources import store, versions
from ledgerwise.sources.statements import statement_movements
from ledgerwise.streaming import ingest

DEBIT = ",".join(HEADERS["debit"])


def run_ts():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def write(folder, name, *lines, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as file:
        file.write(end.join(lines) + end)


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([("0639", "debit"), ("777", "credit")], "account_number string, type string")


@pytest.fixture
def table(spark):
    path = new_path(spark, "test-table")
    store.overwrite_parts(movements(spark, movement("2024-03-01", "1"), movement("2024-04-01", "2")), path)
    return path


# --- the pointer -----------------------------------------------------------------------------------------------------
def folders(path):
    return sorted(
        f"{part}/{version}" for part in os.listdir(path) if part.startswith("part=") for version in os.listdir(f"{path}/{part}")
    )


def test_a_write_that_ends_before_the_switch_changes_nothing(spark, rows, table, monkeypatch):
    load = movements(spark, movement("2024-04-01", "2", cuenta="new"), movement("2024-04-02", "3"), movement("2024-05-01", "4"))
    other = new_path(spark, "test-undisturbed")
    store.overwrite_parts(store.read_parts(spark, table), other)
    store.upsert_movements(load, other)

    before, switch = rows(store.read_parts(spark, table)), versions.switch
    for write_again in (lambda: store.upsert_movements(load, table), lambda: store.overwrite_parts(load, table)):
        monkeypatch.setattr(versions, "switch", lambda *args: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write_again()
        monkeypatch.setattr(versions, "switch", switch)
        assert rows(store.read_parts(spark, table)) == before
    store.upsert_movements(load, table)
    assert rows(store.read_parts(spark, table)) == rows(store.read_parts(spark, other))
    left = versions.vacuum(spark, table)
    assert len(left) == 4 and not set(left) & set(folders(table))
    assert rows(store.read_parts(spark, table)) == rows(store.read_parts(spark, other))


def test_a_pointer_that_was_not_finished_does_not_count(spark, rows, table):
    before = rows(store.read_parts(spark, table))
    with open(f"{table}/{versions.POINTERS}/0000000002.json", "w") as file:
        file.write('{"part=2024-03": ["ver')
    assert rows(store.read_parts(spark, table)) == before
    store.upsert_movements(movements(spark, movement("2024-06-01", "9")), table)
    assert len(rows(store.read_parts(spark, table))) == 3


def test_a_plan_made_before_a_switch_still_runs_after_it(spark, rows, table):
    old, before = store.read_parts(spark, table), rows(store.read_parts(spark, table))
    store.overwrite_parts(movements(spark, movement("2024-07-01", "7")), table)
    assert rows(old) == before
    assert rows(store.read_parts(spark, table), "unique_concept") == [("7",)]
    store.overwrite_parts(movements(spark, movement("2024-08-01", "8")), table)
    assert [f.split("/")[0] for f in folders(table)] == ["part=2024-07", "part=2024-08"]


def test_the_later_of_two_writers_gets_an_error(spark, rows, table):
    before = versions.current(spark, table)
    store.upsert_movements(movements(spark, movement("2024-03-05", "5")), table)
    with pytest.raises(versions.ConcurrentWrite):
        versions.switch(spark, table, before, {})
    assert len(rows(store.read_parts(spark, table))) == 3


def test_untouched_months_are_neither_read_nor_written(spark, table):
    march = [f for f in folders(table) if "2024-03" in f]
    store.upsert_movements(movements(spark, movement("2024-04-09", "9")), table)
    assert [f for f in folders(table) if "2024-03" in f] == march
    only = store.read_parts(spark, table, only=["2024-04"])
    assert {re.search("part=([^/]+)", f)[1] for f in only.inputFiles()} == {"2024-04"}


def test_parts_that_lose_all_rows_and_rows_of_other_parts(spark, rows, table):
    versions.replace_parts(spark.createDataFrame([], "part string, fecha date"), table, ["2024-03"])
    assert rows(store.read_parts(spark, table), "unique_concept") == [("2",)]
    with pytest.raises(ValueError, match="2024-09"):
        versions.replace_parts(movements(spark, movement("2024-09-01", "1")).withColumn("part", F.lit("2024-09")), table, ["2024-04"])
    assert rows(store.read_parts(spark, table), "unique_concept") == [("2",)]


def test_appended_versions_may_have_other_columns(spark, rows):
    path = new_path(spark, "test-append")
    for n, columns in enumerate(("a", "b c"), 1):
        versions.append(spark.range(n).select(F.col("id").alias(columns), F.lit("all").alias("part")), path)
    assert rows(store.read_table(spark, path), "a", "b c") == [(0, None), (None, 0), (None, 1)]


def test_counters_of_an_upsert(spark, table):
    load = movements(spark, movement("2024-04-01", "2", cuenta="x"), movement("2024-04-02", "3"), movement("2024-09-01", "4"))
    store.upsert_movements(movements(spark, movement("2024-04-30", "30")), table)
    assert store.upsert_movements(load, table) == {"inserted": 2, "updated": 1, "untouched": 1}
    assert store.upsert_movements(load, table) == {"inserted": 0, "updated": 3, "untouched": 1}
    assert store.upsert_movements(load, table, "ignore") == {"inserted": 0, "updated": 0, "untouched": 4}
    assert store.upsert_movements(load.filter("false"), table) == {"inserted": 0, "updated": 0, "untouched": 0}


def test_digests_find_the_changes_of_whole_comparisons(spark, rows, table):
    from ledgerwise.operators import diff

    more = [movement("2024-03-01", str(n), cargo="1.00") for n in range(200)] + [movement("2024-05-01", "a")] * 2
    store.upsert_movements(movements(spark, *more, movement("2024-04-01", "2")), table)
    before = store.read_parts(spark, table, keep_part=True)
    twice = before.unionByName(before.filter("unique_concept = '7'"))
    store.upsert_movements(movements(spark, movement("2024-03-01", "7", cargo="1.00", cuenta="new"), movement("2024-03-09", "b")), table)
    after = store.read_parts(spark, table, keep_part=True)
    plain = lambda df: df.drop("part")
    for a, b in ((before, after), (after, before), (before, before), (before, twice), (before.filter("false"), after)):
        assert rows(diff.row_changes_by_digest(a, b, "part")) == rows(diff.row_changes(plain(a), plain(b)))
        assert rows(diff.same_content_by_digest(a, b, "part")) == rows(diff.same_content(plain(a), plain(b)))
    again = diff.row_changes_by_digest(before, after, "part")
    pruned = re.findall(r"PartitionFilters: \[part#\d+ IN \((.*?)\)|PartitionFilters: \[(.*?)\]", plan_of(again))
    assert len(pruned) == 2 and all("2024-03" in str(p) and "2024-04" not in str(p) for p in pruned)


# --- loads -----------------------------------------------------------------------------------------------------------
def test_counters_of_a_load_and_no_staged_folders(spark, rows, accounts, tmp_path):
    closed, opened = str(tmp_path / "closed"), str(tmp_path / "open")
    write(closed, "2024-03 0639.csv", DEBIT, "05/03/2024,SPEI 1,1,,", "05/03/2024,SPEI 2,2,,", '05/03/2024,SPEI 3,"1,000",,')
    write(opened, "0639_mov.csv", DEBIT, "05/04/2024,SPEI 9,1,,", "05/04/2024,nan,1,,")
    ledger, today = w.Ledger(spark, new_path(spark, "test-ledger"), accounts), spark.range(1).select(F.current_date()).first()[0]
    jobs = lambda: [x for x in os.listdir(f"{shared_dir(spark)}/ledgerwise") if x.startswith("job-")]
    before = jobs()
    got = w.load_statements(ledger, closed, opened, today, run_ts())
    assert rows(got["counters"]) == [
        ("credito_abierto", 0, 0, 0, 0), ("credito_cerrado", 0, 0, 0, 0), ("debito_abierto", 1, 0, 0, 1), ("debito_cerrado", 2, 0, 0, 1),
    ]
    write(closed, "2024-04 0639.csv", DEBIT, "05/03/2024,SPEI 2,2,,", "06/03/2024,SPEI 4,2,,")
    again = w.load_statements(ledger, closed, opened, today, run_ts())
    assert rows(again["counters"].filter("table = 'debito_cerrado'")) == [("debito_cerrado", 1, 2, 0, 1)]
    assert rows(again["rejects"], "reason") == [("cargo",), ("unique_concept",)]
    assert jobs() == before


def test_rejected_and_old_files_are_never_opened(spark, accounts, tmp_path):
    folder = str(tmp_path / "open")
    names = ["0639_mov.csv", "2024 [0639] {a}*.csv", "nobody.csv", "0639 old.csv", "0639 other header.csv"]
    for name in names:
        write(folder, name, "Otra,Cosa" if "other" in name else DEBIT, "05/03/2024,SPEI 1,1,,")
    os.utime(os.path.join(folder, "0639 old.csv"), (1_600_000_000, 1_600_000_000))
    today = spark.range(1).select(F.current_date()).first()[0]
    manifest = fs.statement_manifest(spark, folder, accounts, today)
    got = statement_movements(spark, folder, manifest, "abierto", "2024-03-31")
    assert got.count() == 2
    assert len(got.inputFiles()) == 2 + len(manifest.inputFiles()) or {os.path.basename(f) for f in got.inputFiles()} >= {"0639_mov.csv"}
    scan = re.findall(r"FileScan csv .*?Location: InMemoryFileIndex\((\d+) paths\)", plan_of(got))
    assert scan == ["2"]


def test_headers_are_read_without_python(spark, rows, tmp_path):
    folder = str(tmp_path / "headers")
    write(folder, "crlf.csv", "﻿Fecha,Concepto", "1,2", end="\r\n")
    write(folder, "quoted.csv", '"a ""b"", c",,plain,"x"', "1,2")
    write(folder, "blank.csv", "", "1,2")
    found = fs.with_headers(fs.list_files(spark, folder))
    assert rows(found, "file_name", "header") == [
        ("blank.csv", []), ("crlf.csv", ["Fecha", "Concepto"]), ("quoted.csv", ['a "b", c', "", "plain", "x"]),
    ]
    assert not re.search("Python|Pandas|Arrow", plan_of(found))
    assert fs.with_headers(fs.list_files(spark, folder).filter("false")).count() == 0


def test_feed_reads_columns_by_name_however_wide(spark, rows, tmp_path):
    folder, path = str(tmp_path / "wide"), new_path(spark, "test-feed")
    wide = [f"c{i}" for i in range(1, 10)] + ["Fecha", "x", "Concepto", "x"]
    cells = [f"v{i}" for i in range(1, 10)]
    write(folder, "a.csv", ",".join(wide), ",".join([*cells, "d1", "x1", '"uno, dos"', "y1"]), ",".join([*cells, "d2"]))
    write(folder, "b.csv", "Concepto,Fecha", '"uno, dos",d1', "tres,d3", "cuatro,d4,more")
    write(folder, "c.csv", "Concepto,Otra", "x,y")
    for _ in range(2):
        w.feed_from_files(spark, folder, ("Fecha", "Concepto"), path)
    fed = store.read_table(spark, path)
    assert rows(fed, "Fecha", "Concepto", "c9", "x", "x_1", "file_name") == [
        ("d1", "uno, dos", "v9", "x1", "y1", "a.csv"), ("d2", None, "v9", None, None, "a.csv"),
        ("d3", "tres", None, None, None, "b.csv"), ("d4", "cuatro", None, None, None, "b.csv"),
    ]
    assert rows(fed.filter("line IS NOT NULL"), "line") == [("cuatro,d4,more",), (",".join([*cells, "d2"]),)]


def test_lines_with_breaks_inside_quotes(spark, rows, accounts, tmp_path):
    folder = str(tmp_path / "breaks")
    write(folder, "2024-03 0639.csv", DEBIT, '05/03/2024,"SPEI', '12",1,,')
    manifest = fs.statement_manifest(spark, folder, accounts)
    whole = statement_movements(spark, folder, manifest, "cerrado", multi_line=True)
    assert rows(whole, "unique_concept", "reason") == [("12", None)]
    assert statement_movements(spark, folder, manifest, "cerrado").count() == 2


def test_stream_keeps_what_it_cannot_load_also_when_a_batch_runs_again(spark, rows, accounts, tmp_path, monkeypatch):
    folder, root = str(tmp_path / "stream"), new_path(spark, "test-stream")
    write(folder, "2024-03 0639.csv", DEBIT, "05/03/2024,SPEI 1,1,,", '05/03/2024,SPEI 2,"1,000.00",,', "05/03/2024,NaN,3,,", "a,b,c,d,e,f")
    tables, checkpoint = {"debit": f"{root}/debit"}, f"{root}/checkpoint"
    run = lambda: ingest.ingest_statements(spark, folder, accounts, tables, checkpoint, run_ts()).awaitTermination()
    upsert = ingest.upsert_unique
    monkeypatch.setattr(ingest, "upsert_unique", lambda *args: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(ingest, "upsert_unique", upsert)
    run()
    write(folder, "2024-04 0639.csv", DEBIT, "06/03/2024,SPEI 7,x,,", "05/03/2024,SPEI 1,1,,5")
    run()
    report = ingest.report_of(checkpoint)
    assert rows(ingest.stream_rejects(spark, report), "batch_id", "reason", "file_name") == [
        (0, "cargo", "2024-03 0639.csv"), (0, "columns", "2024-03 0639.csv"), (0, "unique_concept", "2024-03 0639.csv"),
        (1, "cargo", "2024-04 0639.csv"),
    ]
    assert rows(store.read_parts(spark, tables["debit"]), "unique_concept", "file_name") == [("1", "2024-04 0639.csv")]
    counters = ingest.stream_counters(spark, report).select("batch_id", "inserted", "updated", "untouched", "rejected")
    assert rows(counters) == [(0, 1, 0, 0, 3), (1, 0, 1, 0, 1)]


# --- documents -------------------------------------------------------------------------------------------------------
def test_payloads_are_kept_once(spark, rows, tmp_path):
    folder, path = str(tmp_path / "docs"), new_path(spark, "test-payloads")
    for name, text in (("2024-01_1_debit.pdf", "same"), ("2024-02_1_debit.pdf", "same"), ("2024-03_1_debit.pdf", "other")):
        write(folder, name, text, end="")
    for _ in range(2):
        kept = ds.keep_payloads(spark, ds.newest_of_each_name(fs.list_files(spark, folder, "*.pdf")), path)
        assert rows(kept, "file_name", "content_length") == [
            ("2024-01_1_debit.pdf", 4), ("2024-02_1_debit.pdf", 4), ("2024-03_1_debit.pdf", 5),
        ]
    hashes = [r["content_hash"] for r in ds.held_hashes(spark, path).collect()]
    assert len(hashes) == len(set(hashes)) == 2
    assert sorted(bytes(r["content"]) for r in ds.payloads(spark, path, hashes).collect()) == [b"other", b"same"]
    nothing = ds.keep_payloads(spark, fs.list_files(spark, folder, "*.csv"), path)
    assert nothing.count() == 0


def test_a_file_that_changes_while_it_is_read_is_an_error(spark, tmp_path, monkeypatch):
    folder, path, read = str(tmp_path / "docs"), new_path(spark, "test-payloads"), ds._read_bytes
    write(folder, "2024-01_1_debit.pdf", "before")

    def changing(*args):
        if "binary" in args[-1]:
            write(folder, "2024-01_1_debit.pdf", "later")
        return read(*args)

    monkeypatch.setattr(ds, "_read_bytes", changing)
    with pytest.raises(RuntimeError, match="changed"):
        ds.keep_payloads(spark, fs.list_files(spark, folder, "*.pdf"), path)


def test_no_bytes_move_in_document_writes(spark, rows):
    stored = ds.by_reference(documents(spark, document("2024-01", "1", pdf_file=b"old"), document("2024-02", "1", csv_file=b"c")))
    path = new_path(spark, "test-narrow")
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    incoming = spark.createDataFrame([("2024-01", "1", "debit", "h", 1), ("2024-03", "1", "debit", None, None)], "cutoff_period string, account_number string, type string, pdf_hash string, pdf_length long").withColumn("updated_at", run_ts())
    made = document_upsert(stored, incoming)
    assert rows(ds.with_stored_flags(made), "cutoff_period", "pdf_hash", "pdf_length", "has_pdf", "has_csv") == [
        ("2024-01", "h", 1, True, False), ("2024-02", None, None, False, True), ("2024-03", None, None, False, False),
    ]
    attached = document_attach(stored, incoming, run_ts())
    assert rows(attached, "cutoff_period", "pdf_hash")[0] == ("2024-01", "h")
    for df in (made, attached):
        assert not re.search(r"binary|(pdf|csv)_file\b", plan_of(df) + df.schema.simpleString())


def test_only_wanted_files_are_opened(spark, rows, tmp_path):
    folder = str(tmp_path / "docs")
    for n in range(1, 5):
        write(folder, f"2024-0{n}_1_debit.pdf", "x" * n)
    wanted = spark.createDataFrame([("2024-03_1_debit.pdf",), ("none.pdf",)], "file_name string")
    found = ds.binary_files(spark, folder, wanted=wanted)
    assert [os.path.basename(f) for f in found.inputFiles()] == ["2024-03_1_debit.pdf"]
    assert rows(found, "file_name", "length") == [("2024-03_1_debit.pdf", 4)]
    assert ds.binary_files(spark, folder, wanted=wanted.filter("false")).count() == 0


# --- exports ---------------------------------------------------------------------------------------------------------
def test_slots_give_the_order_of_a_sort_without_sampling(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.date_sub(F.lit(D("2024-05-31")), (F.col("id") % 3 * F.col("id") % 90).cast("int"))).alias("fecha"), "id"
    )
    months = {r["m"]: r["count"] for r in df.groupBy(F.coalesce(F.date_format("fecha", "yyyy-MM"), F.lit("none")).alias("m")).count().collect()}
    want = [r["id"] for r in newest_first(df).collect()]
    for slot_rows in (100, 10_000):
        made = newest_first_in_slots(df, months, slot_rows)
        assert [r["id"] for r in made.collect()] == want
        assert "rangepartitioning" not in plan_of(made)
    sizes = [r["count"] for r in newest_first_in_slots(df, months, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200 < max(months.values())
    assert newest_first_in_slots(df.filter("false"), {}).count() == 0
