"""Movements joined to their classification, and the classification table kept in step with the movements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.contracts import MOVEMENT_KEY, STATES
from ledgerwise.functions.text import period_from_name
from ledgerwise.operators.joins import by_merge, keyed_join, salted_lookup
from ledgerwise.operators.ranking import keep_last

AMOUNTS = ("cargo", "abono")
MOVEMENT_ID = "movement_id"
CLASSIFICATION = ("category_group", "category_subgroup", "beneficiario")
# columns that some classification tables hold in addition; carried through when present
OPTIONAL = ("id_presupuesto", "concepto_procesado", "ubicacion")


def enrich(
    movements: DataFrame,
    concepts: DataFrame,
    null_safe: bool = True,
    how: str = "left",
    columns: Sequence[str] = CLASSIFICATION,
) -> DataFrame:
    """Movements with their classification, matched on the whole movement key.

    ``null_safe`` lets a missing amount match a missing amount; plain equality never does.  fecha and unique_concept
    are always compared by plain equality.  Where both tables carry ``movement_id`` (``store.save_bucketed``), it joins
    too, and tables bucketed by it meet without a shuffle.
    """
    if how == "left" and not null_safe:
        # rows without one of the amounts, in practice most of them, can match nothing: they skip the shuffle
        complete = F.col("cargo").isNotNull() & F.col("abono").isNotNull()
        matched = enrich(movements.filter(complete), concepts, True, how, columns)
        nothing = {c: F.lit(None).cast(concepts.schema[c].dataType) for c in columns}
        return matched.unionByName(movements.filter(~complete).withColumns(nothing))
    stored_id = [MOVEMENT_ID] if MOVEMENT_ID in movements.columns and MOVEMENT_ID in concepts.columns else []
    keys = [*stored_id, *MOVEMENT_KEY]
    lookup = by_merge(concepts.select(*keys, *columns))
    return keyed_join(movements, lookup, keys, how, AMOUNTS if null_safe else ())


def with_movement_id(df: DataFrame) -> DataFrame:
    """Hash of the movement key: equal keys have equal ids, and ids spread evenly whatever the keys look like."""
    amounts = [F.col(c).cast("decimal(14,2)") for c in AMOUNTS]
    return df.withColumn(MOVEMENT_ID, F.xxhash64("fecha", "unique_concept", *amounts))


def enriched_table(movements: DataFrame, concepts: DataFrame) -> DataFrame:
    """Report table: movement columns, categoria / grupo / beneficiario, optional columns, file_date."""
    extra = [c for c in OPTIONAL if c in concepts.columns]
    joined = enrich(movements, concepts, columns=[*CLASSIFICATION, *extra])
    return joined.select(
        *MOVEMENT_KEY,
        "concepto",
        "estado",
        "beneficiario",
        F.col("category_group").alias("categoria"),
        F.col("category_subgroup").alias("grupo"),
        *extra,
        "file_date",
    )


def export_rows(closed: DataFrame, opened: DataFrame, concepts: DataFrame) -> DataFrame:
    """Closed and open movements together with their classification, matched by plain equality."""
    return enrich(closed.unionByName(opened), concepts, null_safe=False)


def newest_first(df: DataFrame) -> DataFrame:
    """Newest day first, undated rows before all; a hash of the row splits and orders the rows of one day."""
    return df.orderBy(F.col("fecha").desc_nulls_first(), F.xxhash64(*df.columns))


def newest_first_in_slots(df: DataFrame, month_rows: dict[str, int], slot_rows: int = 1_000_000) -> DataFrame:
    """The order of ``newest_first`` without a look at the rows: ``month_rows`` says how many each month has (``none``: undated).

    Every month is dealt to slots of its own, newest month first; one of more than ``slot_rows`` rows day by day, and each
    of its days by ranges of the hash that orders a day, so that no day is too large.  Partitions come out in order.
    """
    first, total, splits = {}, 0, {}
    for month in sorted(month_rows, key=lambda m: (m == "none", m), reverse=True):
        splits[month] = -(-month_rows[month] // slot_rows)
        first[month] = total
        total += 31 * splits[month] if splits[month] > 1 else 1
    if not total:
        return newest_first(df)
    of_month = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    month = F.coalesce(F.date_format("fecha", "yyyy-MM"), F.lit("none"))
    order = F.xxhash64(*df.columns)
    n = F.element_at(of_month(splits), month)
    place = F.least(((order / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)
    day = 31 - F.coalesce(F.dayofmonth("fecha"), F.lit(31))
    slot = F.element_at(of_month(first), month) + F.when(n > 1, day * n + place).otherwise(0)
    ordered = df.withColumns({"_order": order, "_slot": slot}).repartitionById(total, F.col("_slot"))
    return ordered.sortWithinPartitions("_slot", F.col("fecha").desc_nulls_first(), "_order").drop("_slot", "_order")


def of_known_accounts(movements: DataFrame, accounts: DataFrame, kind: str) -> DataFrame:
    """Movements whose account exists with the type of the table they came from; one account may hold most of them."""
    owners = accounts.filter(F.col("type") == kind).select(F.col("account_number").alias("cuenta")).distinct()
    return salted_lookup(movements, owners, ["cuenta"], "left_semi")


def ignored_movements(movements: DataFrame, accounts: DataFrame, kind: str) -> DataFrame:
    """Movements the classification table does not follow, with the reason."""
    owners = accounts.groupBy(F.col("account_number").alias("cuenta")).agg(
        F.max(F.col("type") == kind).alias("_fits"), F.lit(True).alias("_known")
    )
    per_account = movements.groupBy("cuenta").count()
    bad = (
        keyed_join(per_account, owners, ["cuenta"])
        .filter(~F.coalesce("_fits", F.lit(False)))
        .select("cuenta", F.when(F.col("_known"), "wrong type").otherwise("unknown account").alias("reason"))
    )
    return salted_lookup(movements, bad, ["cuenta"], "inner", null_safe=True)


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that a sync has to see: key not there before, or estado not the same."""
    old = before.select(*MOVEMENT_KEY, F.col("estado").alias("_old"), F.lit(True).alias("_was"))
    joined = keyed_join(after, by_merge(old), MOVEMENT_KEY, "left", null_safe=True)
    changed = F.col("_was").isNull() | ~F.col("estado").eqNullSafe(F.col("_old"))
    return joined.filter(changed).select(*after.columns)


def sync_concepts(
    concepts: DataFrame, movements: DataFrame, accounts: DataFrame, kind: str, run_ts: Column
) -> DataFrame:
    """Classification table after a load of ``movements``.

    New keys come in unclassified; known keys only take estado and updated_at.  Closed rows load before open ones, so
    a key found in both ends as open.
    """
    load_order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("estado"))
    eligible = of_known_accounts(movements, accounts, kind).withColumn("_load_order", load_order)
    incoming = keep_last(eligible, MOVEMENT_KEY, ["_load_order", "file_date", "file_name"]).select(
        *[F.col(k).alias(f"_new_{k}") for k in (*MOVEMENT_KEY, "concepto", "cuenta", "estado")],
        F.lit(True).alias("_hit"),
    )
    matches = F.lit(True)
    for k in MOVEMENT_KEY:
        matches = matches & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
    stored = concepts.withColumn("_stored", F.lit(True))
    both = stored.join(incoming, matches, "full")
    inserted = F.col("_stored").isNull()
    values = {c: F.when(inserted, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in (*MOVEMENT_KEY, "concepto", "cuenta")}
    values["estado"] = F.when(F.col("_hit"), F.col("_new_estado")).otherwise(F.col("estado"))
    values["updated_at"] = F.when(F.col("_hit"), run_ts).otherwise(F.col("updated_at"))
    return both.withColumns(values).select(*concepts.columns)


def fill_period(movements: DataFrame) -> DataFrame:
    """Period from the file name where none is given."""
    return movements.withColumn("period", F.coalesce("period", period_from_name(F.col("file_name"))))
