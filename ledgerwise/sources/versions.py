"""Tables whose content is switched by a pointer.

A table is a folder of parts, ``part=<name>``, and every write adds a folder ``version=<id>`` to each part it has rows for.
What counts is said by the newest file in ``_pointers``: for each part the versions that make it up.  It is written last, so
a reader sees a write whole or not at all, and a write that ends before it changes nothing; when it is repeated, it starts
from the old content.  Rows are written once and nothing is deleted before its successor counts.

Replaced versions stay for ``RETAINED`` further writes: a plan made before a switch can still be run after it.  Two writers
cannot both succeed from the same content, the later one gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.shared import file_system

PART, VERSION = "part", "version"
POINTERS = "_pointers"
RETAINED = 1
#: The part of a table that is replaced as a whole.
WHOLE = "all"


class ConcurrentWrite(RuntimeError):
    """Another writer switched the table meanwhile; this write has changed nothing and can be repeated."""


@dataclass(frozen=True)
class Content:
    """What a pointer says: folders of versions by folder of the part.  Number 0: never written."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f"{part}/{version}" for part, versions in self.parts.items() for version in versions}


def _numbers(spark: SparkSession, path: str) -> list[int]:
    system, folder = file_system(spark, f"{path}/{POINTERS}")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def _pointer(path: str, number: int) -> str:
    return f"{path}/{POINTERS}/{number:010d}.json"


def _read_pointer(spark: SparkSession, path: str, number: int) -> Content | None:
    """None if its writer ended in the middle."""
    system, file = file_system(spark, _pointer(path, number))
    stream = system.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Content(number, json.loads(text))
    except ValueError:
        return None


def current(spark: SparkSession, path: str) -> Content:
    """The content that counts now."""
    for number in reversed(_numbers(spark, path)):
        found = _read_pointer(spark, path, number)
        if found is not None:
            return found
    return Content()


def switch(spark: SparkSession, path: str, before: Content, parts: dict[str, list[str]]) -> None:
    """Let ``parts`` count in place of ``before``, then remove what no retained pointer names."""
    numbers = _numbers(spark, path)
    if current(spark, path).number != before.number:
        raise ConcurrentWrite(path)
    system, file = file_system(spark, _pointer(path, (numbers or [0])[-1] + 1))
    try:
        stream = system.create(file, False)  # fails if it is there
    except Exception as error:
        raise ConcurrentWrite(path) from error
    stream.write(bytearray(json.dumps(parts).encode()))
    stream.close()
    _remove_replaced(spark, path)


def _remove_replaced(spark: SparkSession, path: str) -> None:
    known = [(n, _read_pointer(spark, path, n)) for n in _numbers(spark, path)]
    whole = [n for n, content in known if content is not None]
    first_kept = whole[-1 - RETAINED] if len(whole) > RETAINED else 0
    kept = set().union(*(content.folders() for n, content in known if content is not None and n >= first_kept))
    for number, content in known:
        if number < first_kept:
            for folder in (content.folders() if content else set()) - kept:
                _delete(spark, f"{path}/{folder}")
            _delete(spark, _pointer(path, number))


def _delete(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove versions that no pointer names: left behind by writes that ended early.  Not while a write is going on."""
    known = [_read_pointer(spark, path, n) for n in _numbers(spark, path)]
    named = set().union(*(content.folders() for content in known if content is not None))
    left = sorted(set(_folders(spark, path, "*")) - named)
    for folder in left:
        _delete(spark, f"{path}/{folder}")
    return left


def _folders(spark: SparkSession, path: str, version: str) -> list[str]:
    """Folders ``part=../version=..`` of a version; ``*``: of any."""
    system, pattern = file_system(spark, f"{path}/{PART}=*/{VERSION}={version}")
    found = [status.getPath() for status in system.globStatus(pattern) or []]
    return [f"{p.getParent().getName()}/{p.getName()}" for p in found]


def part_name(folder: str) -> str:
    """Value of ``part`` in the name of its folder, where the writer escapes some characters."""
    return unquote(folder.split("=", 1)[1])


def _add(df: DataFrame, path: str) -> dict[str, list[str]]:
    """Write the rows of ``df`` (with its column ``part``) into new folders that do not count yet."""
    version = f"v{uuid.uuid4().hex}"
    df.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(PART, VERSION).parquet(path)
    return {folder.split("/")[0]: [folder.split("/")[1]] for folder in _folders(df.sparkSession, path, version)}


def replace(df: DataFrame, path: str) -> None:
    """``df`` becomes the whole content; it may read the old one."""
    before = current(df.sparkSession, path)
    switch(df.sparkSession, path, before, _add(df, path))


def replace_parts(df: DataFrame, path: str, names: Collection[str]) -> None:
    """``df`` becomes the content of the named parts, which may leave some of them without rows; the others stay."""
    before = current(df.sparkSession, path)
    added = _add(df, path)
    stray = {part_name(folder) for folder in added} - set(names)
    if stray:
        raise ValueError(f"rows of parts that are not to be replaced: {sorted(stray)}")
    stay = {folder: versions for folder, versions in before.parts.items() if part_name(folder) not in names}
    switch(df.sparkSession, path, before, stay | added)


def append(df: DataFrame, path: str) -> None:
    """Add the rows of ``df``, which may read the table."""
    before = current(df.sparkSession, path)
    added = _add(df, path)
    both = {f: [*before.parts.get(f, []), *added.get(f, [])] for f in [*before.parts, *(set(added) - set(before.parts))]}
    switch(df.sparkSession, path, before, both)


def read(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    only: Sequence[str] | None = None,
    since: str | None = None,
) -> DataFrame | None:
    """The content with its column ``part``, all of it, the named parts, or those from one on; None if there is none.

    Folders of other parts are not even listed.  Without ``schema`` the columns are those of all versions together.
    """
    content = current(spark, path)

    def wanted(folder: str) -> bool:
        name = part_name(folder)
        return (only is None or name in only) and (since is None or name >= since)

    folders = [f"{path}/{part}/{v}" for part, versions in sorted(content.parts.items()) if wanted(part) for v in versions]
    if not folders:
        return None
    reader = spark.read.option("basePath", path)
    if schema is None:
        return reader.option("mergeSchema", "true").parquet(*folders).drop(VERSION)
    stored = T.StructType([*schema.fields, T.StructField(PART, T.StringType()), T.StructField(VERSION, T.StringType())])
    return reader.schema(stored).parquet(*folders).drop(VERSION)
