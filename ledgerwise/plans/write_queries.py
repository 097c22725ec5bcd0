"""Keyed writes: the new content of a table after a load, an edit or a change of its parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.contracts import MOVEMENT_KEY, MOVEMENTS
from ledgerwise.operators import diff
from ledgerwise.operators import enrich as en
from ledgerwise.operators import keyed as k
from ledgerwise.operators.calendar import cutoff_days
from ledgerwise.operators.ranking import keep_last
from ledgerwise.plans import views as v
from ledgerwise.plans import workflows
from ledgerwise.plans.registry import query
from ledgerwise.shared import new_path
from ledgerwise.sources import store, versions
from ledgerwise.sources.statements import concat_files, normalize_columns

_OUT = """fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono, file_name, estado,
          cuenta, period"""
_COLUMNS = ("fecha", "unique_concept", "cargo", "abono", "file_name", "estado", "cuenta", "period")
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in MOVEMENT_KEY)


@query(
    f"""SELECT {_OUT} FROM loaded
        UNION ALL SELECT {_OUT} FROM stored a WHERE NOT EXISTS (SELECT 1 FROM loaded b WHERE {_SAME})""",
    "stored",
    "loaded",
)
def upsert_closed(spark, sf):
    return k.upsert(v.stored(spark, sf), v.loaded(spark, sf)).select(*_COLUMNS)


@query(
    f"""SELECT {_OUT} FROM stored
        UNION ALL SELECT {_OUT} FROM loaded a WHERE NOT EXISTS (SELECT 1 FROM stored b WHERE {_SAME})""",
    "stored",
    "loaded",
)
def upsert_ignore(spark, sf):
    return k.upsert(v.stored(spark, sf), v.loaded(spark, sf), on_conflict="ignore").select(*_COLUMNS)


@query(
    f"""SELECT {_OUT} FROM loaded
        UNION ALL SELECT {_OUT} FROM stored a WHERE NOT EXISTS (SELECT 1 FROM loaded b WHERE {_SAME})""",
    "stored",
    "loaded",
)
def upsert_stored_table(spark, sf):
    """The same upsert through the table on storage, month by month; loading twice changes nothing."""
    path = new_path(spark, "closed")
    store.overwrite_parts(v.stored(spark, sf), path)
    for _ in range(2):
        store.upsert_movements(v.loaded(spark, sf), path)
    return store.read_parts(spark, path).select(*_COLUMNS)


@query(f"SELECT {_OUT} FROM movements WHERE estado = 'abierto'", "movements")
def overwrite_open(spark, sf):
    """The open table holds the last load only."""
    path = new_path(spark, "open")
    store.overwrite_parts(v.movements(spark, sf, estado="cerrado"), path)
    store.overwrite_parts(v.movements(spark, sf, estado="abierto"), path)
    return store.read_parts(spark, path).select(*_COLUMNS)


@query(
    f"""SELECT 'inserted' AS action, count(*) AS n_keys FROM loaded a
        WHERE NOT EXISTS (SELECT 1 FROM stored b WHERE {_SAME})
        UNION ALL SELECT 'updated', count(*) FROM loaded a WHERE EXISTS (SELECT 1 FROM stored b WHERE {_SAME})
        UNION ALL SELECT 'untouched', count(*) FROM stored a WHERE NOT EXISTS (SELECT 1 FROM loaded b WHERE {_SAME})""",
    "stored",
    "loaded",
)
def load_counters(spark, sf):
    return k.load_counters(v.stored(spark, sf), v.loaded(spark, sf))


@query(
    f"""SELECT 'inserted' AS action, count(*) AS n_keys FROM loaded a
        WHERE NOT EXISTS (SELECT 1 FROM stored b WHERE {_SAME})
        UNION ALL SELECT 'updated', count(*) FROM loaded a WHERE EXISTS (SELECT 1 FROM stored b WHERE {_SAME})
        UNION ALL SELECT 'untouched', count(*) FROM stored a WHERE NOT EXISTS (SELECT 1 FROM loaded b WHERE {_SAME})
                  AND strftime(fecha, '%Y-%m') IN (SELECT strftime(fecha, '%Y-%m') FROM loaded)
        UNION ALL SELECT 'updated again', count(*) FROM loaded""",
    "stored",
    "loaded",
)
def load_report(spark, sf):
    """The counters that a load brings back from its write; all keys are updates when it is repeated."""
    path = new_path(spark, "closed")
    store.overwrite_parts(v.stored(spark, sf), path)
    first, again = (store.upsert_movements(v.loaded(spark, sf), path) for _ in range(2))
    rows = [*first.items(), ("updated again", again["updated"])]
    return spark.createDataFrame(rows, "action string, n_keys long")


@query(
    f"""SELECT {_OUT} FROM stored
        UNION ALL SELECT {_OUT} FROM loaded a WHERE NOT EXISTS (SELECT 1 FROM stored b WHERE {_SAME})""",
    "stored",
    "loaded",
)
def append_new(spark, sf):
    return k.append_new(v.stored(spark, sf), v.loaded(spark, sf), MOVEMENT_KEY).select(*_COLUMNS)


@query("""
    SELECT event_type, user_id, min(event_id // 1000)::BIGINT AS file, count(*) AS n_rows
    FROM events e
    WHERE event_id // 1000 = (SELECT min(event_id // 1000) FROM events f
                              WHERE f.event_type = e.event_type AND f.user_id = e.user_id)
    GROUP BY event_type, user_id""")
def append_new_copies(spark, sf):
    """Events as files of a thousand rows: copies within the first file of a pair stay, later files add none."""
    events = v.table(spark, sf, "events").select(
        "event_type", "user_id", F.lpad(F.floor(F.col("event_id") / 1000).cast("string"), 12, "0").alias("file_name")
    )
    added = k.append_new(events.filter(F.lit(False)), events, ["event_type", "user_id"])
    return added.groupBy("event_type", "user_id").agg(
        F.min(F.col("file_name").cast("long")).alias("file"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    """SELECT DISTINCT category_group, category_subgroup FROM concepts
       WHERE category_group IS NOT NULL AND category_subgroup IS NOT NULL""",
    "concepts",
)
def insert_ignore(spark, sf):
    """Catalogue of the open months extended by that of all months."""
    pairs = ["category_group", "category_subgroup"]
    found = v.concepts(spark, sf).dropna(subset=pairs)
    known = found.filter(F.col("estado") == "abierto").select(*pairs).distinct()
    return k.insert_ignore(known, found.select(*pairs), pairs)


@query("""
    SELECT ts::DATE::VARCHAR AS fecha, user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
    FROM events GROUP BY ALL""")
def dedup_keep_last(spark, sf):
    events = v.table(spark, sf, "events").withColumn("fecha", F.to_date("ts"))
    last = keep_last(events, ["fecha", "user_id", "event_type"], ["event_id"])
    return last.select("fecha", "user_id", "event_type", "event_id", "value")


@query(
    """SELECT o_orderkey::VARCHAR AS concepto, fecha::VARCHAR AS fecha, price::DOUBLE AS cargo, NULL::DOUBLE AS saldo,
              cuenta FROM priced""",
    "priced",
)
def normalize_columns_credit(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Concepto"),
        F.col("o_orderdate").cast("date").alias("Fecha"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("Cargo"),
        F.lit(None).cast("decimal(12,2)").alias("saldo"),
        F.col("o_orderpriority").alias("Tarjeta"),
        v.account_number("o_custkey").alias("cuenta"),
    )
    mapping = {"Fecha": "fecha", "Concepto": "concepto", "Cargo": "cargo", "Abono": "abono", "saldo": "saldo"}
    normalized, missing, extra = normalize_columns(orders, mapping | {"cuenta": "cuenta"})
    assert (missing, extra) == (["abono"], ["Tarjeta"])
    return normalized


@query(
    """SELECT 'orders' AS origin, o_orderkey AS id, o_orderdate::DATE::VARCHAR AS fecha, NULL AS value FROM orders
       UNION ALL SELECT 'events', event_id, NULL, value FROM events"""
)
def union_files(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("fecha")
    )
    events = v.table(spark, sf, "events").select(F.lit("events").alias("origin"), F.col("event_id").alias("id"), "value")
    return concat_files([orders, events])


@query(f"SELECT {_OUT} FROM movements", "movements")
def union_with_nothing(spark, sf):
    """No files found: an empty table of the right shape, which adds nothing to the stored one."""
    return concat_files([v.movements(spark, sf), concat_files([], spark, MOVEMENTS)]).select(*_COLUMNS)


@query(
    f"""SELECT {_OUT}, CASE WHEN unique_concept IS NULL THEN 'unique_concept' ELSE '' END AS missing
        FROM (SELECT * REPLACE (CASE WHEN estado = 'abierto' THEN NULL ELSE unique_concept END AS unique_concept)
              FROM movements) m""",
    "movements",
)
def rejects(spark, sf):
    """Rows without key apart from the rest; nothing gets lost between the two."""
    blanked = v.movements(spark, sf).withColumn(
        "unique_concept", F.when(F.col("estado") == "cerrado", F.col("unique_concept"))
    )
    good = k.loadable(blanked).withColumn("missing", F.lit(""))
    return good.unionByName(k.rejected(blanked)).select(*_COLUMNS, "missing")


# --- versions of a stored table ---------------------------------------------------------------------------------------
def _two_versions(spark, sf):
    """A stored table, before and after a load of one month that gives some of its movements another account."""
    path = new_path(spark, "versions")
    store.overwrite_parts(v.movements(spark, sf), path)
    before, content = store.read_parts(spark, path, keep_part=True), versions.current(spark, path)
    moved = v.movements(spark, sf).filter((F.col("period") == "2000-03") & (F.col("estado") == "cerrado"))
    store.upsert_movements(moved.withColumn("cuenta", F.concat(F.lit("x"), F.col("cuenta"))), path)
    assert store.changed_parts(spark, path, content) == ["2000-03"]
    return before, store.read_parts(spark, path, keep_part=True)


@query(
    """, marked AS (SELECT fecha::VARCHAR AS fecha, unique_concept, cuenta, period FROM movements)
       SELECT fecha, unique_concept, cuenta, 'removed' AS change FROM marked WHERE period = '2000-03'
       UNION ALL SELECT fecha, unique_concept, 'x' || cuenta, 'added' FROM marked WHERE period = '2000-03'""",
    "movements",
)
def diff_by_digest(spark, sf):
    """Changed rows between two versions of a stored table, of which one month differs."""
    before, after = _two_versions(spark, sf)
    return diff.row_changes_by_digest(before, after, "part").select("fecha", "unique_concept", "cuenta", "change")


@query("""SELECT 'changed' AS pair, false AS equal FROM orders HAVING count(*) > 0
          UNION ALL SELECT 'turned', true FROM orders HAVING count(*) > 0""")
def datasets_by_digest(spark, sf):
    """Do two versions hold the same rows?  Digests tell; also of a table and its rows in another order."""
    before, after = _two_versions(spark, sf)
    pairs = {"changed": after, "turned": before.repartition(3, "unique_concept")}
    found = [diff.same_content_by_digest(before, df, "part").select(F.lit(n).alias("pair"), "equal") for n, df in pairs.items()]
    return concat_files(found)


# --- edits and referential actions -----------------------------------------------------------------------------------
_CONCEPT_KEY = "fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono"
_CONCEPT_OUT = ("fecha", "unique_concept", "cargo", "abono", "category_group", "category_subgroup", "beneficiario")


@query(
    f"""SELECT {_CONCEPT_KEY},
               CASE WHEN edited THEN 'Editado' ELSE category_group END AS category_group,
               CASE WHEN edited THEN new_subgroup ELSE category_subgroup END AS category_subgroup,
               CASE WHEN edited THEN NULL ELSE beneficiario END AS beneficiario
        FROM (SELECT c.*, e.fecha IS NOT NULL AS edited, new_subgroup
              FROM concepts c LEFT JOIN (SELECT fecha AS f, unique_concept AS u, fecha, max(cuenta) AS new_subgroup
                                         FROM movements WHERE estado = 'abierto' GROUP BY ALL) e
                ON c.fecha = e.f AND c.unique_concept = e.u) x""",
    "concepts",
    "movements",
)
def update_classification(spark, sf):
    """One edit per open movement; edits of one key compete and the last account wins."""
    edits = v.movements(spark, sf, estado="abierto").select(
        "fecha",
        "unique_concept",
        F.lit("Editado").alias("category_group"),
        F.col("cuenta").alias("category_subgroup"),
        F.lit("").alias("beneficiario"),
    )
    return k.classify(v.concepts(spark, sf), edits, ["category_subgroup"]).select(*_CONCEPT_OUT)


@query(
    f"""SELECT {_CONCEPT_KEY},
               CASE WHEN category_subgroup = 'MACHINERY' THEN 'Maquinaria ' || category_group
                    ELSE category_group END AS category_group,
               CASE WHEN category_subgroup = 'MACHINERY' THEN 'Equipo' ELSE category_subgroup END AS category_subgroup,
               beneficiario
        FROM concepts""",
    "concepts",
)
def cascade_rename(spark, sf):
    pair = ["category_group", "category_subgroup"]
    found = v.concepts(spark, sf)
    renames = found.filter(F.col("category_subgroup") == "MACHINERY").select(*pair).distinct().withColumns(
        {
            "new_category_group": F.concat(F.lit("Maquinaria "), F.col("category_group")),
            "new_category_subgroup": F.lit("Equipo"),
        }
    )
    return k.rename_cascade(found, renames, pair).select(*_CONCEPT_OUT)


@query(
    f"""SELECT {_CONCEPT_KEY}, category_group, category_subgroup,
               CASE WHEN n_regionkey = 0 THEN NULL ELSE beneficiario END AS beneficiario
        FROM concepts JOIN nation ON beneficiario = n_name""",
    "concepts",
)
def delete_set_null(spark, sf):
    gone = v.table(spark, sf, "nation").filter(F.col("n_regionkey") == 0).select(F.col("n_name").alias("beneficiario"))
    return k.delete_set_null(v.concepts(spark, sf), gone, ["beneficiario"]).select(*_CONCEPT_OUT)


@query(
    """SELECT period AS cutoff_period, cutoff_date::VARCHAR AS cutoff_date, year_value::BIGINT AS year_value FROM days
       WHERE year_value NOT IN (SELECT year(fecha) FROM movements WHERE estado = 'abierto')""",
    "days",
)
def delete_cascade(spark, sf):
    gone = v.movements(spark, sf, estado="abierto").select(F.year("fecha").alias("year_value")).distinct()
    left = k.delete_cascade(cutoff_days(v.years(spark, sf)), gone, ["year_value"])
    return left.select(F.col("period").alias("cutoff_period"), "cutoff_date", F.col("year_value").cast("long").alias("year_value"))


# --- classification table in step with the movements ------------------------------------------------------------------
_SYNC = f"""
    SELECT coalesce(n.fecha, o.fecha)::VARCHAR AS fecha, coalesce(n.unique_concept, o.unique_concept) AS unique_concept,
           coalesce(n.cargo, o.cargo)::DOUBLE AS cargo, coalesce(n.abono, o.abono)::DOUBLE AS abono,
           coalesce(o.concepto, n.concepto) AS concepto, coalesce(o.cuenta, n.cuenta) AS cuenta,
           coalesce(n.estado, o.estado) AS estado, category_group, category_subgroup, beneficiario,
           CASE WHEN n.fecha IS NULL THEN o.updated_at ELSE TIMESTAMP '{v.RUN_TS}' END::VARCHAR AS updated_at
    FROM (SELECT * FROM concepts WHERE fecha < DATE '{v.STORED_UNTIL}') o
    FULL JOIN (SELECT l.* FROM loaded l JOIN accounts ON cuenta = account_number AND type = 'debit') n
      ON o.fecha = n.fecha AND o.unique_concept = n.unique_concept
     AND o.cargo IS NOT DISTINCT FROM n.cargo AND o.abono IS NOT DISTINCT FROM n.abono"""


@query(_SYNC, "concepts", "loaded", "accounts")
def sync_concepts(spark, sf):
    known = v.concepts(spark, sf).filter(F.col("fecha") < v.day(v.STORED_UNTIL))
    return en.sync_concepts(known, v.loaded(spark, sf), v.accounts(spark, sf), "debit", v.run_ts())


@query(
    """SELECT m.fecha::VARCHAR AS fecha, m.unique_concept, m.cuenta, 'wrong type' AS reason
       FROM loaded m JOIN accounts ON cuenta = account_number WHERE type <> 'debit'""",
    "loaded",
    "accounts",
)
def sync_ignored(spark, sf):
    ignored = en.ignored_movements(v.loaded(spark, sf), v.accounts(spark, sf), "debit")
    return ignored.select("fecha", "unique_concept", "cuenta", "reason")


@query(
    f"""SELECT {_OUT} FROM (SELECT * REPLACE (CASE WHEN fecha >= DATE '2000-12-01' THEN 'abierto' ELSE estado END AS estado)
                            FROM loaded) a
        WHERE NOT EXISTS (SELECT 1 FROM stored b WHERE {_SAME} AND a.estado = b.estado)""",
    "stored",
    "loaded",
)
def sync_state_changes(spark, sf):
    reopened = F.when(F.col("fecha") >= v.day("2000-12-01"), "abierto").otherwise(F.col("estado"))
    after = v.loaded(spark, sf).withColumn("estado", reopened)
    return en.state_changes(v.stored(spark, sf), after).select(*_COLUMNS)


@query(
    """SELECT CASE WHEN type = 'credit' THEN 'credito' ELSE 'debito' END
              || CASE WHEN estado = 'cerrado' THEN '_cerrado' ELSE '_abierto' END AS source,
              fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono, estado,
              beneficiario, categoria, grupo
       FROM enriched JOIN accounts ON cuenta = account_number""",
    "enriched",
    "accounts",
)
def rebuild_enriched(spark, sf):
    """The four enriched tables, rebuilt and published together, read back under each other."""
    names = {"debit": "debito", "credit": "credito"}
    states = ("cerrado", "abierto")
    tables = {f"{n}_{s}": v.movements(spark, sf, kind, s) for kind, n in names.items() for s in states}
    concepts = v.concepts(spark, sf)
    root = new_path(spark, "enriched")
    workflows.rebuild_enriched(tables, {n: concepts for n in names.values()}, root, "1")
    parts = [store.read_published(spark, root, t).withColumn("source", F.lit(t)) for t in tables]
    return concat_files(parts).select(
        "source", "fecha", "unique_concept", "cargo", "abono", "estado", "beneficiario", "categoria", "grupo"
    )
