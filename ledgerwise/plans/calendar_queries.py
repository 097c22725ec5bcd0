"""Cutoff calendars over the years and accounts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.operators import calendar as c
from ledgerwise.operators.diff import changed_values
from ledgerwise.operators.ranking import latest_cutoffs
from ledgerwise.plans import views as v
from ledgerwise.plans.registry import query

_DAYS = "year_value::BIGINT AS year_value, cutoff_date::VARCHAR AS cutoff_date, period"


def _long_year(df):
    return df.withColumn("year_value", F.col("year_value").cast("long"))


def _days(spark, sf):
    return c.cutoff_days(v.years(spark, sf))


@query(f"SELECT {_DAYS} FROM days", "days")
def cutoff_days(spark, sf):
    return _long_year(_days(spark, sf))


@query(
    f"""SELECT {_DAYS.replace("cutoff_date::VARCHAR", "CASE WHEN year_value < 1998 THEN cutoff_date + 3 ELSE cutoff_date END::VARCHAR")}
        FROM days""",
    "days",
)
def new_year_cutoffs(spark, sf):
    """All years of the orders arrive; the days of those already there, moved by hand, stay as they are."""
    all_years = v.years(spark, sf)
    old = all_years.filter(F.col("year_value") < 1998)
    moved = c.cutoff_days(old).withColumn("cutoff_date", F.date_add("cutoff_date", 3))
    return _long_year(c.add_years(old, moved, all_years)[1])


@query("SELECT year_value::BIGINT AS year_value FROM years", "years")
def new_years(spark, sf):
    all_years = v.years(spark, sf)
    old = all_years.filter(F.col("year_value") < 1998)
    return _long_year(c.add_years(old, c.cutoff_days(old), all_years)[0])


_CUTOFF_OUT = f"account_number, type, period AS cutoff_period, '{v.RUN_TS}' AS updated_at"


@query(
    f"""SELECT {_CUTOFF_OUT} FROM accounts, days
        WHERE (type = 'credit' AND cutoff_date < DATE '{v.AS_OF}')
           OR (type = 'debit' AND date_trunc('month', cutoff_date) < date_trunc('month', DATE '{v.AS_OF}'))""",
    "accounts",
    "days",
)
def account_cutoffs_v1(spark, sf):
    return c.account_cutoffs(v.accounts(spark, sf), _days(spark, sf), v.AS_OF, v.run_ts(), "v1")


@query(f"SELECT {_CUTOFF_OUT} FROM accounts, days WHERE cutoff_date < DATE '{v.AS_OF}'", "accounts", "days")
def account_cutoffs_v2(spark, sf):
    return c.account_cutoffs(v.accounts(spark, sf), _days(spark, sf), v.AS_OF, v.run_ts(), "v2")


@query(
    f"""SELECT account_number, type, period AS cutoff_period,
               CASE WHEN cutoff_date < DATE '2000-03-10' AND type = 'credit' OR cutoff_date < DATE '{v.AS_OF}'
                    THEN '{v.RUN_TS}' ELSE '2001-12-31 00:00:00' END AS updated_at
        FROM accounts, days WHERE cutoff_date < DATE '{v.AS_OF}' OR cutoff_date > DATE '2001-09-01'""",
    "accounts",
    "days",
)
def refresh_account_cutoffs(spark, sf):
    """Stored: periods up to 2000 and, ahead of time, the last ones of 2001; refreshed as of the usual date."""
    people, days = v.accounts(spark, sf), _days(spark, sf)
    early = c.account_cutoffs(people, days, "2000-03-10", F.lit("2000-03-10").cast("timestamp"))
    ahead = days.filter(F.col("cutoff_date") > v.day("2001-09-01"))
    late = c.account_cutoffs(people, ahead, "2002-01-01", F.lit("2001-12-31").cast("timestamp"))
    return c.refresh_account_cutoffs(early.unionByName(late), people, days, v.AS_OF, v.run_ts())


def _edited_days(days):
    """Cutoffs of the summer months moved by a week."""
    moved = F.when(F.month("cutoff_date").between(6, 8), F.date_add("cutoff_date", 7)).otherwise(F.col("cutoff_date"))
    return days.withColumn("cutoff_date", moved)


@query(
    f"""SELECT {_DAYS.replace("cutoff_date::VARCHAR", "(CASE WHEN month(cutoff_date) BETWEEN 6 AND 8 THEN cutoff_date + 7 ELSE cutoff_date END)::VARCHAR")}
        FROM days""",
    "days",
)
def update_cutoff_dates(spark, sf):
    days = _days(spark, sf)
    edits = changed_values(days, _edited_days(days), ["year_value", "period"], "cutoff_date")
    return _long_year(c.move_cutoffs(days, edits))


@query(
    """SELECT year_value::BIGINT AS year_value, period, (cutoff_date + 7)::VARCHAR AS cutoff_date FROM days
       WHERE month(cutoff_date) BETWEEN 6 AND 8""",
    "days",
)
def changed_dates(spark, sf):
    days = _days(spark, sf)
    return _long_year(changed_values(days, _edited_days(days), ["year_value", "period"], "cutoff_date"))


@query(
    """SELECT account_number, type, cutoff_period FROM account_cutoffs
       QUALIFY row_number() OVER (PARTITION BY account_number, type ORDER BY cutoff_period DESC) <= 2""",
    "account_cutoffs",
)
def top2_cutoffs(spark, sf):
    rows = c.account_cutoffs(v.accounts(spark, sf), _days(spark, sf), v.AS_OF, v.run_ts())
    return latest_cutoffs(rows).drop("updated_at")


@query("SELECT account_number, type, cutoff_period FROM account_cutoffs", "account_cutoffs")
def cutoffs_sorted(spark, sf):
    rows = c.account_cutoffs(v.accounts(spark, sf), _days(spark, sf), v.AS_OF, v.run_ts())
    return rows.drop("updated_at").orderBy("account_number", "type", F.col("cutoff_period").desc())
