"""Small literal tables."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from ledgerwise.contracts import CONCEPTS, DOCUMENTS, MOVEMENTS

D = date.fromisoformat
M = lambda text: None if text is None else Decimal(text)
TS = datetime.fromisoformat


def movement(fecha, key, cargo=None, abono=None, **more):
    row = dict.fromkeys(MOVEMENTS.names)
    row |= {"fecha": D(fecha) if fecha else None, "unique_concept": key, "cargo": M(cargo), "abono": M(abono)}
    row |= {"estado": "cerrado", "cuenta": "0639", "file_date": D("2024-03-31"), "file_name": "2024-03 0639.csv"}
    row |= more
    return tuple(row[c] for c in MOVEMENTS.names)


def movements(spark, *rows):
    return spark.createDataFrame(list(rows), MOVEMENTS)


def concept(fecha, key, cargo=None, abono=None, **more):
    row = dict.fromkeys(CONCEPTS.names)
    row |= {"fecha": D(fecha), "unique_concept": key, "cargo": M(cargo), "abono": M(abono), "cuenta": "0639"}
    row |= {"estado": "cerrado", "updated_at": TS("2024-01-01 00:00:00")} | more
    return tuple(row[c] for c in CONCEPTS.names)


def concepts(spark, *rows):
    return spark.createDataFrame(list(rows), CONCEPTS)


def document(period, account, kind="debit", **more):
    row = dict.fromkeys(DOCUMENTS.names) | {"cutoff_period": period, "account_number": account, "type": kind} | more
    return tuple(row[c] for c in DOCUMENTS.names)


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), DOCUMENTS)
