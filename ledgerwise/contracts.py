"""File headers, column maps, table schemas, keys and formats."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: statement headers, in file order -------------------------------------------------------------
HEADERS = {
    "debit": ("Fecha", "Concepto", "Cargos", "Abonos", "Saldos"),
    "credit": ("Fecha", "Concepto", "Abono", "Cargo", "Tarjeta"),
    "instalment": (
        "Fecha de operación",
        "Tasa anual",
        "Importe inicial",
        "Importe pendiente",
        "Concepto",
        "Pagos pendientes",
        "Mensualidad",
    ),
}

# --- fixed values: header name -> movement column ---------------------------------------------------------------
RENAMES = {
    "debit": {"Fecha": "fecha", "Concepto": "concepto", "Cargos": "cargo", "Abonos": "abono", "Saldos": "saldo"},
    "credit": {"Fecha": "fecha", "Concepto": "concepto", "Cargo": "cargo", "Abono": "abono", "saldo": "saldo"},
}

# --- fixed values: text that means "no value", date formats, the date that stands for "unknown" -----------------
NULL_MARKERS = ("", "nat", "nan", "none", "null", "n/a", "<na>")
# one-digit days and months are accepted, as strptime does
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "yyyy-M-d H:m:s")
UNKNOWN_DATE = "1900-01-01"
PERIOD_PATTERN = r"([0-9]{4}-[0-9]{2})"
OPEN_PERIOD = "open"
CUTOFF_DAY = 6

# --- fixed values: domains ---------------------------------------------------------------------------------------
KINDS = ("credit", "debit")
STATES = ("cerrado", "abierto")
BALANCED = "Balance 0"
TOTAL = "Total"
OUTLIER_LABEL = "🚨 ANOMALÍA"
NORMAL_LABEL = "✅ Normal"
HAS_PDF, NO_PDF = "Has PDF", "No PDF"
CLOSED_STATUS, OPEN_STATUS = "closed", "open"

# --- fixed values: keys ------------------------------------------------------------------------------------------
MOVEMENT_KEY = ("fecha", "unique_concept", "cargo", "abono")
DOCUMENT_KEY = ("cutoff_period", "account_number", "type")
CUTOFF_KEY = ("account_number", "type", "cutoff_period")

# --- fixed values: schemas of the stored tables ------------------------------------------------------------------
_date, _text, _amount, _wide = T.DateType(), T.StringType(), T.DecimalType(12, 2), T.DecimalType(14, 2)


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


MOVEMENTS = _schema(
    fecha=_date, concepto=_text, cargo=_amount, abono=_amount, saldo=_amount, file_date=_date, file_name=_text,
    estado=_text, cuenta=_text, unique_concept=_text, period=_text,
)
CONCEPTS = _schema(
    fecha=_date, unique_concept=_text, cargo=_wide, abono=_wide, concepto=_text, cuenta=_text, estado=_text,
    category_group=_text, category_subgroup=_text, beneficiario=_text, updated_at=T.TimestampType(),
)
ACCOUNTS = _schema(account_number=_text, type=_text)
CUTOFF_DAYS = _schema(year_value=T.IntegerType(), cutoff_date=_date, period=_text)
ACCOUNT_CUTOFFS = _schema(account_number=_text, type=_text, cutoff_period=_text, updated_at=T.TimestampType())
DOCUMENTS = _schema(
    cutoff_period=_text, account_number=_text, type=_text, updated_at=T.TimestampType(), pdf_file=T.BinaryType(),
    csv_file=T.BinaryType(), pdf_filename=_text, csv_filename=_text,
)
