"""Category totals, month to date, statistics and outliers, budget against actual, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import BALANCED, MOVEMENT_KEY, NORMAL_LABEL, OUTLIER_LABEL, TOTAL
from ledgerwise.functions.dates import day, in_month
from ledgerwise.operators.joins import keyed_join, salted_lookup

MONEY = "decimal(22,2)"
# fixed values: rows that stand for "no filter" in the two selectors
ALL_STATES, ALL_ACCOUNTS = "Todos", "Todas"


def _totals():
    return [F.sum("abono").cast(MONEY).alias("total_abono"), F.sum("cargo").cast(MONEY).alias("total_cargo")]


def category_report(enriched: DataFrame, balanced: bool = True) -> DataFrame:
    """Totals per category, then one grand total (also when there are no rows).

    ``balanced=False`` leaves out the balanced category, and with it rows that have no category.
    """
    rows = enriched if balanced else enriched.filter(F.col("categoria") != BALANCED)
    per_category = rows.groupBy("categoria").agg(*_totals())
    # the grand total adds up the category totals: the movements are read and combined once
    grand = per_category.agg(
        F.sum("total_abono").cast(MONEY).alias("total_abono"), F.sum("total_cargo").cast(MONEY).alias("total_cargo")
    )
    detail = per_category.select(F.lit(0).alias("sort_key"), "categoria", "total_abono", "total_cargo")
    total = grand.select(F.lit(1).alias("sort_key"), F.lit(TOTAL).alias("categoria"), "total_abono", "total_cargo")
    return detail.unionByName(total)


def in_report_order(report: DataFrame) -> DataFrame:
    """Detail by category, missing category last, then the total."""
    return report.orderBy("sort_key", F.col("categoria").asc_nulls_last())


def newest_snapshot(df: DataFrame, date_column: str = "file_date") -> DataFrame:
    """Rows of the newest snapshot; the maximum is a scalar subquery that reaches the scan as a filter."""
    return df.filter(F.col(date_column) == df.agg(F.max(date_column)).scalar())


def closed_report(enriched_closed: DataFrame, balanced: bool = True) -> DataFrame:
    """Category report over the closed rows of the newest snapshot."""
    return category_report(newest_snapshot(enriched_closed).filter(F.col("estado") == "cerrado"), balanced)


def month_to_date(enriched: DataFrame, as_of, by: Sequence[str] = ("categoria", "tipo")) -> DataFrame:
    """Sums over the month of ``as_of``, missing amounts counting as zero."""
    zero = F.lit(0).cast("decimal(12,2)")
    return (
        enriched.filter(in_month(F.col("fecha"), as_of))
        .groupBy(*by)
        .agg(
            F.sum(F.coalesce("abono", zero)).cast(MONEY).alias("abonos_mtd"),
            F.sum(F.coalesce("cargo", zero)).cast(MONEY).alias("cargos_mtd"),
        )
    )


def with_amount(enriched: DataFrame) -> DataFrame:
    """Charge, or credit where there is no charge, as ``monto``."""
    return enriched.withColumn("monto", F.coalesce("cargo", "abono"))


def category_stats(amounts: DataFrame, as_of, months: int = 6, by: str = "categoria") -> DataFrame:
    """Mean and sample standard deviation of ``monto`` per category over the trailing months."""
    value = F.col("monto").cast("double")
    return (
        amounts.filter(F.col("fecha") >= F.add_months(day(as_of), -months))
        .groupBy(by)
        .agg(F.avg(value).alias("promedio"), F.stddev_samp(value).alias("desviacion"))
    )


def flag_outliers(amounts: DataFrame, stats: DataFrame, as_of, days: int = 30, by: str = "categoria") -> DataFrame:
    """Movements of the trailing days, marked where ``monto`` exceeds mean + 2 standard deviations.

    Categories without statistics are normal.  A category may hold most rows, so the lookup is salted.
    """
    recent = amounts.filter(F.col("fecha") >= F.date_sub(day(as_of), days))
    limit = F.col("promedio") + 2 * F.col("desviacion")
    label = F.when(F.col("monto").cast("double") > limit, OUTLIER_LABEL).otherwise(NORMAL_LABEL)
    return salted_lookup(recent, stats, [by]).withColumn("alerta", label)


def budget_vs_actual(budget: DataFrame, movements: DataFrame, as_of, keep_all: bool = False) -> DataFrame:
    """Monthly budget, spending in the month of ``as_of``, what is left and percent used, per budget line.

    A line whose movements all fall in other months does not appear, one without any movement does;
    ``keep_all`` keeps both.  Movements are summed per concept before the join, so a concept with very many rows
    costs one row per map task.
    """
    counts = F.coalesce(in_month(F.col("fecha"), as_of), F.lit(True))
    spending = movements.groupBy(F.col("unique_concept").alias("concepto_match")).agg(
        F.sum(F.when(counts, F.col("cargo"))).alias("_spent"), F.max(counts).alias("_counts")
    )
    lines = keyed_join(budget, spending, ["concepto_match"])
    if not keep_all:
        lines = lines.filter(F.coalesce("_counts", F.lit(True)))
    spent = F.coalesce(F.sum("_spent"), F.lit(0)).cast(MONEY)
    used = F.round(F.try_divide(100 * F.col("gasto_real"), F.col("presupuesto_mensual")), 2)
    return (
        lines.groupBy("categoria", "presupuesto_mensual")
        .agg(spent.alias("gasto_real"))
        .withColumn("diferencia", (F.col("presupuesto_mensual") - F.col("gasto_real")).cast(MONEY))
        .withColumn("porcentaje_usado", used.cast(MONEY))
    )


def rows_per_account(movements: DataFrame) -> DataFrame:
    return movements.filter(F.col("cuenta").isNotNull()).groupBy("cuenta").agg(F.count(F.lit(1)).alias("n_rows"))


def latest_file_date(movements: DataFrame) -> DataFrame:
    return movements.groupBy("cuenta").agg(F.max("file_date").alias("max_date"))


def newest_page(concepts: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` classified movements; the movement key decides between rows of one day."""
    return concepts.orderBy(
        F.col("fecha").desc_nulls_first(), *[F.col(k).asc_nulls_first() for k in MOVEMENT_KEY[1:]]
    ).limit(n)


def pick(df: DataFrame, estado: str | None = None, cuenta: str | None = None) -> DataFrame:
    """Optional equality filters; None, or the selector's "all" entry, filters nothing."""
    if estado not in (None, ALL_STATES):
        df = df.filter(F.col("estado") == estado)
    if cuenta not in (None, ALL_ACCOUNTS):
        df = df.filter(F.col("cuenta") == cuenta)
    return df


def catalogue(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column in order, without NULL."""
    return catalogue(df.filter(F.col(column).isNotNull()), column)
