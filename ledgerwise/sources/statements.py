"""Statement files to typed, keyed movements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.contracts import HEADERS, MOVEMENT_KEY, MOVEMENTS, RENAMES
from ledgerwise.functions.dates import is_date_name, open_period, or_unknown, parse_date
from ledgerwise.functions.text import amount, clean_text, period_from_name, unique_concept, unreadable
from ledgerwise.operators.joins import keyed_join
from ledgerwise.operators.keyed import REQUIRED
from ledgerwise.operators.ranking import keep_last
from ledgerwise.sources.files import load_paths, paths_of

# one column more than any contract has shows what a line holds beyond it
WIDTH = max(len(header) for header in HEADERS.values()) + 1
RAW = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(WIDTH)])


def raw_reader(reader, schema: T.StructType = RAW, multi_line: bool = False):
    """Positional text columns.  One pass reads all contracts; the header line of every file is skipped.

    Quotes inside quotes are doubled, as in the header.  A line break ends a line even inside quotes: the halves have
    too few or too many columns to be read and end up among the rejects.  With ``multi_line`` it belongs to the cell, and a
    file is read by one task.
    """
    return reader.schema(schema).options(
        header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", quote='"', escape='"', multiLine=multi_line
    )


def raw_rows(spark: SparkSession, manifest: DataFrame, multi_line: bool = False) -> DataFrame:
    """Lines of the files of a manifest, and of no others."""
    paths = paths_of(manifest)
    if not paths:
        return spark.createDataFrame([], T.StructType([*RAW.fields, T.StructField("file_path", T.StringType())]))
    path = F.col("_metadata.file_path").alias("file_path")
    return load_paths(raw_reader(spark.read.format("csv"), RAW, multi_line), paths, *RAW.names, path)


def with_files(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Raw rows of accepted files, with the columns of their file.

    Stage the manifest first (``shared.staged``): its real size then decides between broadcast and merge, and the
    merge side is a plain shuffle that adaptive execution can split when one file holds most rows.
    """
    return keyed_join(raw, manifest.drop("raw_path"), ["file_path"], "inner")


def by_meaning(rows: DataFrame, column: str) -> Column:
    """Raw column that holds a movement column, which depends on the contract of the row's file."""
    places = [
        F.when(F.col("contract") == kind, F.col(f"c{HEADERS[kind].index(name)}"))
        for kind, names in RENAMES.items()
        for name, target in names.items()
        if target == column and name in HEADERS[kind]
    ]
    return F.coalesce(*places)


def normalize_columns(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, list[str], list[str]]:
    """Renamed and reduced to the mapped columns; also the mapped columns it lacks and the extra ones it had."""
    kept = {source: target for source, target in mapping.items() if source in df.columns}
    present = set(kept.values())
    kept |= {t: t for t in mapping.values() if t in df.columns and t not in present}
    missing = [target for target in mapping.values() if target not in kept.values()]
    extra = [c for c in df.columns if c not in kept]
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in kept.items()]), missing, extra


def concat_files(frames: list[DataFrame], spark: SparkSession | None = None, schema: T.StructType = MOVEMENTS) -> DataFrame:
    """All frames under each other over the union of their columns; an empty frame with ``schema`` if there is none."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def typed_movements(rows: DataFrame, estado: str, as_of=None, null_date: bool = True) -> DataFrame:
    """Typed movements of all kinds out of raw rows with their file's contract, name, date and account.

    ``reason`` names the first amount that holds text but no number, or says ``columns`` where a line has more columns
    than its contract; such rows keep their text in ``raw`` and must not be loaded (``readable``).

    Closed rows take their period from the file name, open rows from ``as_of``.  Credit statements have no balance.
    ``null_date`` writes unknown dates as the fixed unknown date; without it such rows end up among the rejects.
    """
    movements = rows.filter(F.col("contract").isin(*RENAMES))
    kind, concepto = F.col("contract"), by_meaning(rows, "concepto")
    if estado == "cerrado":
        period = period_from_name(F.col("file_name"))
    else:
        period = F.coalesce(*[F.when(kind == k, open_period(k, as_of)) for k in RENAMES])
    columns = {
        "fecha": parse_date(clean_text(by_meaning(rows, "fecha"))),
        "concepto": clean_text(concepto),
        **{c: amount(by_meaning(rows, c)) for c in ("cargo", "abono", "saldo")},
        "file_date": F.col("file_date"),
        "file_name": F.col("file_name"),
        "estado": F.lit(estado),
        "cuenta": F.col("cuenta"),
        "unique_concept": F.nullif(unique_concept(clean_text(concepto)), F.lit("")),
        "period": period,
    }
    if null_date:
        columns |= {c: or_unknown(columns[c]) for c in MOVEMENTS.names if is_date_name(c)}
    bad = [F.when(unreadable(by_meaning(rows, c), columns[c]), F.lit(c)) for c in ("cargo", "abono", "saldo")]
    surplus = [
        F.when((kind == k) & F.coalesce(*[F.col(f"c{i}") for i in range(len(HEADERS[k]), WIDTH)]).isNotNull(), "columns")
        for k in RENAMES
    ]
    reason = F.coalesce(*surplus, *bad)
    raw = F.when(reason.isNotNull(), F.concat_ws(",", *RAW.names))
    return movements.select(
        kind.alias("kind"), *[columns[c].alias(c) for c in MOVEMENTS.names], reason.alias("reason"), raw.alias("raw")
    )


def readable(movements: DataFrame) -> DataFrame:
    """Rows without a reason against them."""
    return movements.filter(F.col("reason").isNull()).drop("reason", "raw")


def last_of_each_key(movements: DataFrame) -> DataFrame:
    """One movement per kind and key: the one from the newest file.  Rows that cannot be loaded all stay."""
    whole = F.col("reason").isNull()
    for column in REQUIRED:
        whole = whole & F.col(column).isNotNull()
    own = F.when(~whole, F.monotonically_increasing_id())
    keyed = movements.withColumn("_own", own)
    return keep_last(keyed, ["kind", *MOVEMENT_KEY, "_own"], ["file_date", "file_name"]).drop("_own")


def refusal() -> Column:
    """Why a row cannot be loaded: unreadable, or a missing key column; NULL if it can."""
    return F.coalesce("reason", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])


def refused(movements: DataFrame) -> DataFrame:
    """Rows that cannot be loaded, with the reason."""
    return movements.withColumn("reason", refusal()).filter(F.col("reason").isNotNull())


def statement_movements(
    spark: SparkSession,
    folder: str,
    manifest: DataFrame,
    estado: str,
    as_of=None,
    null_date: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """All movements in the accepted files of a folder, in one pass over these files; no other file is opened."""
    return typed_movements(with_files(raw_rows(spark, manifest, multi_line), manifest), estado, as_of, null_date)
