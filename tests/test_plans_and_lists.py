from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import D, TS, document, documents, movement, movements
from ledgerwise.operators import calendar as c
from ledgerwise.operators import diff as d
from ledgerwise.operators import manifests as m
from ledgerwise.operators import quality as q
from ledgerwise.operators.ranking import newest_file

ACCOUNTS = "account_number string, type string"


def run_ts():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")


# --- calendar --------------------------------------------------------------------------------------------------------
def years(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "year_value int")


def test_cutoff_days_are_zero_padded(spark, rows):
    days = rows(c.cutoff_days(years(spark, 2025)))
    assert len(days) == 12 and days[0] == (2025, D("2025-01-06"), "2025-01")


@pytest.mark.parametrize(
    ("as_of", "rule", "credit", "debit"),
    [
        ("2024-03-06", "v1", 2, 2),
        ("2024-03-07", "v1", 3, 2),
        ("2024-03-07", "v2", 3, 3),
        ("2024-04-01", "v1", 3, 3),
        ("2024-01-01", "v2", 0, 0),
        ("2025-01-01", "v1", 12, 12),
    ],
)
def test_cutoffs_due(spark, as_of, rule, credit, debit):
    accounts = spark.createDataFrame([("1", "credit"), ("1", "debit")], ACCOUNTS)
    due = c.account_cutoffs(accounts, c.cutoff_days(years(spark, 2024)), as_of, run_ts(), rule)
    counts = {r["type"]: r["count"] for r in due.groupBy("type").count().collect()}
    assert (counts.get("credit", 0), counts.get("debit", 0)) == (credit, debit)


def test_new_years_leave_moved_days_alone(spark, rows):
    known = years(spark, 2024)
    moved = c.cutoff_days(known).withColumn("cutoff_date", F.date_add("cutoff_date", 1))
    all_years, days = c.add_years(known, moved, years(spark, 2024, 2025, 2025))
    assert rows(all_years) == [(2024,), (2025,)]
    assert days.count() == 24 and days.filter("day(cutoff_date) = 7").count() == 12


def test_refresh_keeps_one_row_per_account_type_and_period(spark):
    accounts = spark.createDataFrame([("1", "credit"), ("1", "debit")], ACCOUNTS)
    days = c.cutoff_days(years(spark, 2024))
    first = c.account_cutoffs(accounts, days, "2024-03-10", F.lit("2024-03-10").cast("timestamp"))
    again = c.refresh_account_cutoffs(first, accounts, days, "2024-04-10", run_ts())
    assert again.count() == 8 and again.filter("updated_at < '2024-04-01'").count() == 0


# --- statements still to fetch ---------------------------------------------------------------------------------------
def test_download_plan(spark, rows):
    accounts = spark.createDataFrame([("1", "credit"), ("2", "debit")], ACCOUNTS)
    cutoffs = c.account_cutoffs(accounts, c.cutoff_days(years(spark, 2024)), "2024-04-10", run_ts())
    debit = movements(spark, movement("2024-03-01", "a", cuenta="2", period="2024-04"))
    credit = movements(spark, movement("2024-03-01", "b", cuenta="2", period="2024-03"))
    opened = {"debit": movements(spark, movement("2024-04-10", "c", cuenta="2", file_date=D("2024-04-10"))), "credit": movements(spark)}
    plan = rows(m.download_plan(cutoffs, accounts, {"debit": debit, "credit": credit}, opened, "2024-04-10"))
    assert plan == [
        ("credit", "2024-03", "1", "closed"),
        ("credit", "2024-04", "1", "closed"),
        ("credit", "2024-04-10", "1", "open"),
    ]
    loaded = m.loaded_pairs(debit, credit)
    closed = m.missing_closed(cutoffs, loaded)
    assert closed.join(loaded, (closed.period == loaded.period) & (closed.account == loaded.cuenta), "left_semi").count() == 0


def test_newest_of_the_new_files(spark, rows):
    listing = spark.createDataFrame(
        [("a", TS("2024-01-01")), ("b", TS("2024-01-02")), ("c", TS("2024-01-02")), ("d", TS("2024-01-03"))],
        "file_name string, file_modification_time timestamp",
    )
    known = spark.createDataFrame([("d",), ("d",)], "file_name string")
    assert rows(newest_file(listing, known), "file_name") == [("c",)]


# --- documents -------------------------------------------------------------------------------------------------------
def flags(spark):
    return m.document_flags(
        documents(
            spark,
            document("2024-01", "1", pdf_file=b"p"),
            document("2024-02", "1", csv_file=b"c"),
            document("2023-12", "1", pdf_file=b""),
            document("2023-11", "1"),
            document(None, "1"),
            document("open", "1", updated_at=TS("2024-02-15 08:00:00")),
            document("open", "2", updated_at=TS("2024-02-14 23:59:59")),
            document("open", "3"),
            document("open", "4", updated_at=TS("2024-01-01"), csv_file=b"c"),
            document("2024-01", "5"),
        )
    )


def test_pending_documents(spark, rows):
    as_of = "2024-02-15"
    csv = rows(m.pending_csv(flags(spark), as_of), "cutoff_period", "account_number")
    assert csv == [("2023-12", "1"), ("2024-01", "1"), ("2024-01", "5"), ("open", "2"), ("open", "3")]
    again = rows(m.pending_csv(flags(spark), as_of, refresh_open=True), "cutoff_period", "account_number")
    assert set(again) - set(csv) == {("open", "4")}
    assert rows(m.pending_pdf(flags(spark), as_of), "cutoff_period", "account_number") == [("2024-01", "5"), ("2024-02", "1")]
    assert rows(m.missing_open_documents(flags(spark), as_of)) == [("open", "5", "debit")]
    arrived = spark.createDataFrame([("open_3_debit.csv",), ("2024-01_5_debit.pdf",), ("2023-11_1_debit.csv",)], "file_name string")
    assert rows(m.files_to_attach(flags(spark), arrived, as_of), "filename", "filetype") == [
        ("2024-01_5_debit.pdf", "pdf"), ("open_3_debit.csv", "csv"),
    ]


def test_document_names(spark, rows):
    names = ["2024-01_0639_debit.pdf", "2024-01_0639_debit.PDF", "2024-01_0639.pdf", "a_b_c_d.pdf", "2024-01_0639_debit.csv"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert rows(m.parse_document_names(files), "cutoff_period", "account_number", "type") == [("2024-01", "0639", "debit")] * 2


def test_pending_uploads(spark, rows):
    cutoffs = spark.createDataFrame(
        [("1", "debit", p, TS("2024-02-01")) for p in ("2024-01", "2024-02", "2023-12")],
        "account_number string, type string, cutoff_period string, updated_at timestamp",
    )
    files = spark.createDataFrame([("2024-02_1_debit.pdf",), ("2024-01_1_debit.pdf",)], "file_name string")
    assert rows(m.pending_uploads(cutoffs, flags(spark), files), "filename") == [("2024-02_1_debit.pdf",)]
    to_sync = rows(m.documents_to_sync(cutoffs, flags(spark), files), "cutoff_period", "file_name")
    assert to_sync == [("2023-12", None), ("2024-02", "2024-02_1_debit.pdf")]


# --- constraints -----------------------------------------------------------------------------------------------------
def test_violations(spark, rows):
    df = movements(spark, movement("2024-03-01", "1", estado="x"), movement("2024-03-01", None, estado=None))
    rules = {"estado": q.allowed("estado", ["cerrado", "abierto"]), "key": q.given("unique_concept")}
    assert rows(q.violations(df, rules)) == [("estado", 1), ("key", 1)]
    assert rows(q.violations(movements(spark), rules)) == [("estado", 0), ("key", 0)]


def test_account_numbers(spark, rows):
    accounts = spark.createDataFrame([("0639",), ("ab",), ("123456",), ("a-b",), ("",), (None,), ("ñ12",)], "account_number string")
    assert rows(q.account_number_errors(accounts)) == [
        ("", "empty"), ("123456", "length"), ("a-b", "characters"), ("ab", "length"), (None, "empty"),
    ]
    assert accounts.filter(q.account_number_ok()).count() == 2


def test_duplicates_and_orphans(spark, rows):
    child = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y")], "g string, s string")
    parent = spark.createDataFrame([("a", "x"), ("a", "x")], "grp string, sub string")
    assert rows(q.duplicate_keys(child, ["g", "s"])) == [("a", "x", 2)]
    assert rows(q.orphans(child, parent, {"g": "grp", "s": "sub"})) == [("b", "y", 1)]
    assert rows(q.duplicate_keys(child.filter("s is null").unionByName(child), ["g", "s"])) == [("a", "x", 2), ("a", None, 2)]


def test_year_rule(spark, rows):
    days = c.cutoff_days(years(spark, 2024)).withColumn("year_value", F.lit(2023))
    assert rows(q.violations(days, {"year": q.year_matches("cutoff_date", "year_value")})) == [("year", 12)]


# --- versions --------------------------------------------------------------------------------------------------------
def test_diffs(spark, rows):
    schema = "a int, b string"
    old = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], schema)
    new = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], schema).withColumn("c", F.lit(1))
    assert rows(d.row_changes(old, new)) == [("3", "z", "removed"), ("4", "w", "added")]
    assert rows(d.row_changes(old, old)) == []
    assert rows(d.occurring_once(old, new)) == [(3, "z"), (4, "w")]
    assert rows(d.same_content(old, old.repartition(3))) == [(True,)]
    assert rows(d.same_content(old, old.distinct())) == [(False,)]
    assert rows(d.same_content(old, new)) == [(False,)]
    assert d.schema_diff(old, new) == {"added": ["c"], "removed": [], "common": ["a", "b"]}
    assert d.summary(old, new).first().asDict() == {
        "rows_added": 1, "rows_removed": 1, "rows_new": 3, "rows_old": 4, "columns_added": "c", "columns_removed": "",
    }
    assert rows(d.changed_values(old.distinct(), new, ["a"], "b")) == []
