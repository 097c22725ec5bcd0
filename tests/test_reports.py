from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from helpers import D, M, concept, concepts, movement, movements
from ledgerwise.contracts import NORMAL_LABEL, OUTLIER_LABEL
from ledgerwise.operators import reports as r
from ledgerwise.operators.enrich import enriched_table, newest_first
from ledgerwise.operators.export import as_cells, sample

ENRICHED = "categoria string, abono decimal(12,2), cargo decimal(12,2), estado string, file_date date"


def enriched(spark, *rows):
    return spark.createDataFrame([(c, M(a), M(g), e, D(d)) for c, a, g, e, d in rows], ENRICHED)


def totals(report):
    return [(x["sort_key"], x["categoria"], x["total_abono"], x["total_cargo"]) for x in r.in_report_order(report).collect()]


def test_category_report(spark):
    df = enriched(
        spark,
        ("B", "1", None, "cerrado", "2024-03-31"),
        ("A", "2", "3", "cerrado", "2024-03-31"),
        (None, "4", None, "cerrado", "2024-03-31"),
        ("Balance 0", "8", "8", "cerrado", "2024-03-31"),
    )
    full = totals(r.category_report(df))
    assert [x[:2] for x in full] == [(0, "A"), (0, "B"), (0, "Balance 0"), (0, None), (1, "Total")]
    assert full[-1][2:] == (Decimal("15.00"), Decimal("11.00"))
    assert totals(r.category_report(df, balanced=False))[-1][2:] == (Decimal("3.00"), Decimal("3.00"))


def test_empty_report_still_has_a_total(spark):
    assert totals(r.category_report(enriched(spark))) == [(1, "Total", None, None)]


def test_closed_report_takes_the_newest_snapshot(spark):
    df = enriched(
        spark,
        ("A", "1", None, "cerrado", "2024-02-29"),
        ("A", "2", None, "cerrado", "2024-03-31"),
        ("A", "4", None, "abierto", "2024-03-31"),
    )
    assert totals(r.closed_report(df)) == [(0, "A", Decimal("2.00"), None), (1, "Total", Decimal("2.00"), None)]


def test_month_to_date_counts_missing_amounts_as_zero(spark, rows):
    df = movements(spark, movement("2024-03-01", "1", "5"), movement("2024-03-31", "2"), movement("2024-02-29", "3", "9"))
    got = rows(r.month_to_date(df.withColumn("categoria", F.lit("A")), "2024-03-15", by=["categoria"]))
    assert got == [("A", Decimal("0.00"), Decimal("5.00"))]


def test_statistics_and_outliers(spark, rows):
    history = spark.createDataFrame(
        [(D("2024-01-01"), "A", M(v)) for v in ("1", "2", "3")] + [(D("2024-01-01"), "one", M("1")), (D("2023-01-01"), "A", M("99"))],
        "fecha date, categoria string, monto decimal(12,2)",
    )
    stats = r.category_stats(history, "2024-06-01")
    assert rows(stats) == [("A", 2.0, 1.0), ("one", 1.0, None)]
    recent = spark.createDataFrame(
        [(D("2024-06-01"), c, M(v)) for c, v in (("A", "4"), ("A", "4.01"), ("one", "50"), ("other", "9"), (None, "7"))]
        + [(D("2024-05-01"), "A", M("99"))],
        "fecha date, categoria string, monto decimal(12,2)",
    )
    flagged = rows(r.flag_outliers(recent, stats, "2024-06-01"), "categoria", "monto", "alerta")
    assert [x for x in flagged if x[2] == OUTLIER_LABEL] == [("A", Decimal("4.01"), OUTLIER_LABEL)]
    assert sum(x[2] == NORMAL_LABEL for x in flagged) == 4


def test_budget(spark, rows):
    budget = spark.createDataFrame(
        [("food", M("100"), "1"), ("food", M("100"), "2"), ("zero", M("0"), "3"), ("other month", M("10"), "4"), ("none", M("5"), "5")],
        "categoria string, presupuesto_mensual decimal(18,2), concepto_match string",
    )
    moves = movements(
        spark,
        movement("2024-03-01", "1", "10"),
        movement("2024-03-02", "1", "20.005"),
        movement("2024-03-02", "2"),
        movement("2024-02-02", "2", "70"),
        movement("2024-03-02", "3", "1"),
        movement("2024-02-02", "4", "1"),
    )
    got = {x[0]: tuple(map(str, x[1:])) for x in rows(r.budget_vs_actual(budget, moves, "2024-03-10"))}
    assert got == {
        "food": ("100.00", "30.01", "69.99", "30.01"),
        "zero": ("0.00", "1.00", "-1.00", "None"),
        "none": ("5.00", "0.00", "5.00", "0.00"),
    }
    everything = {x[0]: str(x[2]) for x in rows(r.budget_vs_actual(budget, moves, "2024-03-10", keep_all=True))}
    assert everything == {"food": "30.01", "zero": "1.00", "none": "0.00", "other month": "0.00"}


def test_listings(spark, rows):
    table = concepts(spark, concept("2024-03-01", "2", cuenta="b"), concept("2024-03-02", "1", cuenta=None, estado="abierto"))
    assert [x["unique_concept"] for x in r.newest_page(table, 1).collect()] == ["1"]
    assert r.pick(table, "Todos", "Todas").count() == 2
    assert rows(r.pick(table, "cerrado", "b"), "unique_concept") == [("2",)]
    assert r.pick(r.newest_page(table, 1), "cerrado").count() == 0
    assert [x[0] for x in r.choices(table, "cuenta").collect()] == ["b"]
    assert rows(r.rows_per_account(movements(spark, movement("2024-03-01", "1"), movement("2024-03-01", "2", cuenta=None)))) == [("0639", 1)]


def test_newest_first(spark):
    df = movements(spark, movement("2024-03-01", "1"), movement("2024-03-02", "2"), movement(None, "3"))
    assert [x["unique_concept"] for x in newest_first(df).collect()] == ["3", "2", "1"]


def test_unmatched_movements_have_no_category(spark, rows):
    table = enriched_table(movements(spark, movement("2024-03-01", "1", "5")), concepts(spark, concept("2024-03-01", "1", "6")))
    assert rows(table, "categoria", "grupo", "beneficiario") == [(None, None, None)]


def test_cells(spark, rows):
    df = spark.createDataFrame([(D("2024-03-01"), 1.5, None), (None, float("inf"), "x")], "fecha date, value double, note string")
    assert rows(as_cells(df)) == [("", "", "x"), ("2024-03-01", "1.5", "")]


def test_sample_is_repeatable(spark, rows):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = rows(sample(df, 20, ["k"], seed=1))
    assert len(first) == 20
    assert first == rows(sample(df.repartition(7), 20, ["k"], seed=1)) != rows(sample(df, 20, ["k"], seed=2))
