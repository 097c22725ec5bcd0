"""File manifest: one row per statement file, with its header contract, date and account.

The manifest is small next to the rows, but it grows with the number of files, so it stays a DataFrame.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ledgerwise.contracts import HEADERS
from ledgerwise.functions.dates import day
from ledgerwise.operators.joins import by_merge
from ledgerwise.shared import staged


def file_name_of(path: Column) -> Column:
    """Name of a statement out of its encoded path.

    A statement is a file, or, where Spark wrote it in parts, a folder ``file=<name>``.
    """
    as_folder = F.regexp_extract(path, r"/file=([^/]+)/[^/]*$", 1)
    as_file = F.regexp_extract(path, r"([^/]+)$", 1)
    # a plus sign is itself in a path, not a blank
    name = F.when(as_folder != "", as_folder).otherwise(as_file)
    decoded = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    # names of partition folders are escaped once more
    return F.when(as_folder != "", F.url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B")))).otherwise(decoded)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Files below ``folder`` from the listing alone; no content is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return listing.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"),
        F.col("path").alias("raw_path"),
    ).withColumn("file_name", file_name_of(F.col("file_path")))


def created_on(files: DataFrame, as_of) -> DataFrame:
    """Files of one day, by modification time."""
    return files.filter(F.to_date("file_modification_time") == day(as_of))


def file_date_from_name(file_name: Column) -> Column:
    """Date before the first underscore, else NULL."""
    return F.try_to_date(F.split_part(file_name, F.lit("_"), F.lit(1)), "yyyy-MM-dd")


def paths_of(files: DataFrame) -> list[str]:
    """Paths of listed files, for a reader that is to open these and no others.

    The driver holds the listing of a folder anyway, as every file source does.
    """
    return [row[0] for row in files.select("raw_path").distinct().collect()]


# a reader is given so many paths at once
PATHS_AT_ONCE = 10_000


def load_paths(reader: DataFrameReader, paths: list[str], *columns: str | Column) -> DataFrame:
    """``columns`` (``_metadata`` included) of what ``reader`` finds in exactly these files, one at least; signs that patterns
    are made of stand for themselves."""
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path in paths]
    parts = [reader.load(plain[at : at + PATHS_AT_ONCE]).select(*columns) for at in range(0, len(plain), PATHS_AT_ONCE)]
    return reduce(DataFrame.union, parts)


# a cell of a line that begins with a comma: quoted, quotes inside doubled, or plain
_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)[^,]*+'


def cells_of(line: Column) -> Column:
    """Cells of one line of a CSV file; an empty line has none."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    inside = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), inside(c)).otherwise(c))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(plain)


def with_headers(files: DataFrame) -> DataFrame:
    """Files with their header, the cells of the first line, as an array; none for a file without lines.

    The first line is the one at the lowest position of a file's first block: one row per file leaves the tasks that read
    the lines, and no other file is opened.
    """
    spark, files = files.sparkSession, staged(files, "files")
    paths, none = paths_of(files), F.array().cast("array<string>")
    if not paths:
        return files.withColumn("header", none)
    start = F.col("_metadata.file_block_start").alias("start")
    lines = load_paths(spark.read.format("text"), paths, F.col("_metadata.file_path").alias("_path"), "value", start)
    placed = lines.where(F.col("start") == 0).withColumn("place", F.monotonically_increasing_id())
    first = placed.groupBy("_path").agg(F.min_by("value", "place").alias("line"))
    found = first.select("_path", cells_of(F.regexp_replace("line", "^\ufeff", "")).alias("header"))
    joined = files.join(by_merge(found), F.col("file_path") == F.col("_path"), "left").drop("_path")
    return joined.withColumn("header", F.coalesce("header", none))


def distinct_names(header: list[str]) -> list[str]:
    """Names of a header, with a number where one repeats, upper and lower case being the same; a blank one by its place."""
    out: list[str] = []
    for place, name in enumerate(header):
        base, n = name.strip() or f"column {place + 1}", 0
        name = base
        while name.lower() in {o.lower() for o in out} or name.lower() in ("line", "file_name", "file_date", "part", "version"):
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def exact_contract(header: Column) -> Column:
    """Name of the contract whose header is exactly this one, order included; else NULL."""
    return F.coalesce(*[F.when(header == _literal(columns), name) for name, columns in HEADERS.items()])


def holds_columns(header: Column, required: tuple[str, ...] | list[str]) -> Column:
    """True where every required column is in the header, in any order."""
    return F.size(F.array_except(_literal(required), header)) == 0


def _literal(columns) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def tag_accounts(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """Files with the account whose number occurs in their name (lowest number if several); others are dropped.

    "Occurs in" becomes an equi-join: every name is cut into its substrings of the lengths that account numbers
    have, and those are matched.  Names have at most a few hundred characters, so this grows with the number of
    files and not with files x accounts.  Neither accounts nor names go through the driver.
    """
    numbers = accounts.filter(F.length("account_number") > 0)
    lengths = numbers.agg(F.collect_set(F.length("account_number"))).scalar()
    # pieces with signs that no account number has, most of them, are dropped where they are cut
    each = numbers.select(F.explode(F.split("account_number", "")).alias("sign"))
    signs = each.agg(F.array_join(F.collect_set("sign"), "")).scalar()
    sized = files.select("file_name").distinct().select("file_name", F.explode(lengths).alias("_length"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("file_name") - F.col("_length") + 1, F.lit(1)))
    pieces = F.transform(starts, lambda start: F.substring(F.col("file_name"), start, F.col("_length")))
    cut = sized.select("file_name", F.explode(F.array_distinct(pieces)).alias("account_number"))
    cut = cut.filter(F.call_function("translate", F.col("account_number"), signs, F.lit("")) == "")
    matched = (
        cut.join(by_merge(accounts.select("account_number")), "account_number")
        .groupBy("file_name")
        .agg(F.min("account_number").alias("cuenta"))
    )
    return files.join(by_merge(matched), "file_name")


def statement_manifest(spark: SparkSession, folder: str, accounts: DataFrame, as_of=None) -> DataFrame:
    """Accepted statements of a folder; ``as_of`` limits them to files of that day, for the open statements."""
    files = list_files(spark, folder)
    return accepted(files if as_of is None else created_on(files, as_of), accounts)


def accepted(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """Files with a known account in their name and exactly the header of a known contract."""
    # the account comes from the name alone, so only files that have one are opened
    tagged = with_headers(tag_accounts(files, accounts)).withColumn("contract", exact_contract(F.col("header")))
    return (
        tagged.filter(F.col("contract").isNotNull())
        .withColumn("file_date", F.to_date("file_modification_time"))
        .select("file_path", "raw_path", "file_name", "file_date", "contract", "cuenta")
    )
