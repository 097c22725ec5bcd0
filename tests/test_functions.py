from __future__ import annotations

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwise.contracts import NULL_MARKERS
from ledgerwise.functions import dates, text


def apply(spark, values, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression(F.col("v"))).collect()]


def test_unique_concept(spark):
    given_and_wanted = {
        "SPEI 123-45": "12345",
        "PAGO NÓMINA": "PAGONÓMINA",
        "---": "",
        "": "",
        None: "",
        "a1b2": "12",
        "ñandú ª": "ñandúª",
    }
    assert apply(spark, given_and_wanted, text.unique_concept) == list(given_and_wanted.values())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24F, exclude_characters="\x00"), max_size=12), min_size=1))
def test_unique_concept_like_brute_force(spark, values):
    def brute(value):
        digits = "".join(c for c in value if c in "0123456789")
        return digits or "".join(c for c in value if c.isalpha())

    assert apply(spark, values, text.unique_concept) == [brute(v) for v in values]


def test_parse_date(spark):
    values = ["05/03/2024", "5/3/2024", "2024-03-05", "2024-03-05 10:11:12", "bad", "31/02/2024", "2024/03/05", "", None]
    day = date(2024, 3, 5)
    assert apply(spark, values, dates.parse_date) == [day, day, day, day, None, None, None, None, None]


def test_repair_date_and_count(spark):
    values = ["05/03/2024", "2024-03-05", "2024-03-05 00:00:00", "2024-03-05 10:11:12", "bad", "40/01/2024", None]
    day = date(2024, 3, 5)
    assert apply(spark, values, dates.repair_date) == [day, day, day, day, None, None, None]
    assert apply(spark, values, dates.repair_changed) == [True, True, False, True, False, False, False]


def test_null_markers(spark):
    assert apply(spark, [*NULL_MARKERS, "NaN", " none ", "N/A", "<NA>", "\tnull\n"], text.clean_text) == [None] * 12
    assert apply(spark, [" x ", "nano"], text.clean_text) == ["x", "nano"]


def test_amount(spark):
    got = apply(spark, ["12.5", " 3 ", "nan", "1,5", "", None, "99999999999999"], text.amount)
    assert [None if g is None else str(g) for g in got] == ["12.50", "3.00", None, None, None, None, None]


def test_period_from_name(spark):
    names = ["2024-05 0639.csv", "x 2023-11 2024-01.csv", "none.csv", "20245-071", None]
    assert apply(spark, names, text.period_from_name) == ["2024-05", "2023-11", None, "0245-07", None]


@pytest.mark.parametrize(
    ("uri", "masked"),
    [
        ("postgresql://me:pw@host:5432/db", "postgresql://me:***@host:5432/db"),
        ("mongodb://me@host/db", "mongodb://me@host/db"),
        ("postgresql://host/db", "postgresql://host/db"),
        ("no uri", "no uri"),
        ("a://u:p:q@h", "a://u:***@h"),
        ("a://u@b://c:d@e", "a://u@b://c:d@e"),
        ("a://u:p@h@i", "a://u:***@h@i"),
        ("", ""),
        (None, ""),
    ],
)
def test_masked_uri(spark, uri, masked):
    assert apply(spark, [uri], text.masked_uri) == [masked]


def test_open_period_rolls_over_the_year(spark):
    one = spark.range(1)
    pick = lambda kind: one.select(dates.open_period(kind, "2024-12-31")).first()[0]
    assert (pick("debit"), pick("credit")) == ("2024-12", "2025-01")


def test_in_month_keeps_the_bare_column(spark):
    frame = spark.createDataFrame([(date(2024, 2, d),) for d in (1, 29)] + [(date(2024, 3, 1),)], "fecha date")
    assert frame.filter(dates.in_month(F.col("fecha"), "2024-02-10")).count() == 2


def test_recent_periods_in_january(spark):
    assert list(spark.range(1).select(*dates.recent_periods("2024-01-31")).first()) == ["2024-01", "2023-12", "2023-11"]


def test_presence_and_display(spark):
    frame = spark.createDataFrame([(b"x", 1.5), (b"", float("nan")), (None, float("-inf")), (b"y", None)], "b binary, x double")
    assert [r[0] for r in frame.select(text.is_present(F.col("b"))).collect()] == [True, False, False, True]
    assert [r[0] for r in frame.select(text.display_text(F.col("x"), "double")).collect()] == ["1.5", "", "", ""]
