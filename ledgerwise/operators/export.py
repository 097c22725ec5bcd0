"""Data prepared for people: cell text, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.text import display_text


def as_cells(df: DataFrame) -> DataFrame:
    """All columns as text, missing and infinite values empty, ``fecha`` as yyyy-MM-dd."""
    cells = []
    for name, data_type in df.dtypes:
        value = F.col(name)
        if name == "fecha":
            day = F.try_to_timestamp(value) if data_type == "string" else value
            cells.append(F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")).alias(name))
        else:
            cells.append(display_text(value, data_type).alias(name))
    return df.select(*cells)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of key and seed: the same rows on every run, and a top-n per task only."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(draw, *keys).limit(n)
