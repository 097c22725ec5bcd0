"""Constraints as data-quality reports: Spark enforces none of them, so violations are counted or listed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.operators.joins import keyed_join

ACCOUNT_PATTERN = r"^[\p{L}\p{N}]{3,5}$"


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass.  A rule that is NULL holds, as for a CHECK."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_violations")) for name in rules]
    return counts.select(F.inline(F.array(*pairs)))


def allowed(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def given(column: str) -> Column:
    return F.col(column).isNotNull()


def year_matches(date_column: str, year_column: str) -> Column:
    return F.year(date_column) == F.col(year_column)


def account_number_ok(column: str = "account_number") -> Column:
    """Three to five letters or digits; a missing number is wrong."""
    return F.coalesce(F.col(column).rlike(ACCOUNT_PATTERN), F.lit(False))


def account_number_errors(accounts: DataFrame, column: str = "account_number") -> DataFrame:
    """First rule each bad account number breaks."""
    number = F.coalesce(column, F.lit(""))
    length = F.length(number)
    error = (
        F.when(length == 0, "empty")
        .when((length < 3) | (length > 5), "length")
        .when(~number.rlike(r"^[\p{L}\p{N}]+$"), "characters")
    )
    return accounts.withColumn("error", error).filter(F.col("error").isNotNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, NULLs equal, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """References without a parent and how many rows hold them; ``columns`` maps child to parent columns.

    As for a foreign key, a reference with a NULL part is not checked.  References are counted before the join, so
    one that very many rows share is one row by then.
    """
    names = list(columns)
    used = child.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(*[F.col(p).alias(c) for c, p in columns.items()]).distinct()
    return keyed_join(used, known, names, "left_anti")
