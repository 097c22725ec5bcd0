"""Text rules: movement concepts, null markers, periods in file names, URI masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwise.contracts import NULL_MARKERS, PERIOD_PATTERN


BLANKS = " \t\n\r\f\v"


def unique_concept(concept: Column) -> Column:
    """All digits of the concept; all letters if it holds no digit; empty for NULL."""
    digits = F.regexp_replace(concept, "[^0-9]+", "")
    letters = F.regexp_replace(concept, r"[^\p{L}]+", "")
    return F.coalesce(F.when(digits != "", digits).otherwise(letters), F.lit(""))


def clean_text(value: Column) -> Column:
    """Trimmed text, with the null markers turned into NULL."""
    trimmed = F.btrim(value, F.lit(BLANKS))
    return F.when(~F.lower(trimmed).isin(*NULL_MARKERS), trimmed)


def unreadable(value: Column, read: Column) -> Column:
    """True where there is text, but nothing could be read from it."""
    return clean_text(value).isNotNull() & read.isNull()


def amount(value: Column, precision: int = 12) -> Column:
    """Text to decimal(precision, 2); NULL where it is no number."""
    return clean_text(value).try_cast(f"decimal({precision},2)")


def period_from_name(file_name: Column) -> Column:
    """First ``yyyy-MM`` in a file name, else NULL."""
    return F.nullif(F.regexp_extract(file_name, PERIOD_PATTERN, 1), F.lit(""))


def masked_uri(uri: Column) -> Column:
    """``scheme://user:password@host`` with the password as ``***``; anything else unchanged, NULL as empty."""
    masked = F.regexp_replace(uri, r"(?s)^((?:(?!://).)*://[^:@]*):[^@]*@", "$1:***@")
    return F.coalesce(masked, F.lit(""))


def is_present(payload: Column) -> Column:
    """True for a payload that exists and is not empty."""
    return F.coalesce(F.length(payload) > 0, F.lit(False))


def display_text(value: Column, data_type: str) -> Column:
    """Text for a spreadsheet cell: NULL, NaN and infinities empty, everything else as its plain text."""
    text = value.cast("string")
    if data_type in ("double", "float"):
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        text = F.when(finite, text)
    return F.coalesce(text, F.lit(""))
