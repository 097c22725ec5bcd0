"""Cutoff calendars: twelve days a year, and which of them apply to an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import CUTOFF_KEY
from ledgerwise.functions.dates import cutoff_day, day, month_start, period
from ledgerwise.operators.joins import not_in
from ledgerwise.operators.keyed import insert_ignore, update_from, upsert


def cutoff_days(years: DataFrame) -> DataFrame:
    """Twelve cutoffs for every year in ``year_value``."""
    months = years.select("year_value", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_month"))
    dated = months.withColumn("cutoff_date", cutoff_day(F.col("year_value"), F.col("_month")))
    return dated.select("year_value", "cutoff_date", period(F.col("cutoff_date")).alias("period"))


def add_years(years: DataFrame, days: DataFrame, new_years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Years and cutoff days after adding years; days come only for years that were really new, existing ones stay."""
    fresh = not_in(new_years.select("year_value").distinct(), years, ["year_value"])
    return (
        insert_ignore(years, fresh, ["year_value"]),
        insert_ignore(days, cutoff_days(fresh), ["year_value", "period"]),
    )


def move_cutoffs(days: DataFrame, edited: DataFrame) -> DataFrame:
    """Cutoff days with the edited dates."""
    return update_from(days, edited, ["year_value", "period"], ["cutoff_date"])


def eligible_cutoffs(days: DataFrame, as_of, rule: str) -> DataFrame:
    """(type, cutoff_period) that are due.

    ``rule="v1"``: credit the day after its cutoff, debit once the month is over.  ``rule="v2"``: both the day after.
    """
    passed = F.col("cutoff_date") < day(as_of)
    debit_due = {"v1": F.col("cutoff_date") < month_start(day(as_of)), "v2": passed}[rule]
    types = F.array_compact(F.array(F.when(passed, "credit"), F.when(debit_due, "debit")))
    return days.select(F.explode(types).alias("type"), F.col("period").alias("cutoff_period")).distinct()


def account_cutoffs(accounts: DataFrame, days: DataFrame, as_of, run_ts: Column, rule: str = "v2") -> DataFrame:
    """Every due cutoff period of every account.

    The OR over dates becomes an equality on type.  ``eligible_cutoffs`` is distinct on (type, yyyy-MM): at most
    2 x 12 rows per calendar year, under 240,000 rows for all years a date can hold, hence the broadcast.

    An account turns into a row per due period, a small file of accounts into very many rows.  Accounts are spread before
    that, over a number of partitions that adaptive execution leaves alone: it would size them by the accounts.
    """
    due = F.broadcast(eligible_cutoffs(days, as_of, rule))
    partitions = int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = accounts.repartition(partitions, F.xxhash64("account_number", "type"))
    return spread.join(due, "type").select(*CUTOFF_KEY, run_ts.alias("updated_at"))


def refresh_account_cutoffs(
    existing: DataFrame, accounts: DataFrame, days: DataFrame, as_of, run_ts: Column, rule: str = "v2"
) -> DataFrame:
    """Stored cutoffs with the due ones inserted or their timestamp renewed."""
    return upsert(existing, account_cutoffs(accounts, days, as_of, run_ts, rule), CUTOFF_KEY)
