"""Constraints and version differences over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.contracts import KINDS, MOVEMENT_KEY
from ledgerwise.operators import diff as d
from ledgerwise.operators import quality as q
from ledgerwise.operators.calendar import cutoff_days
from ledgerwise.operators.export import head, sample
from ledgerwise.plans import views as v
from ledgerwise.plans.registry import query


@query(
    """SELECT unnest(['estado is known', 'fecha is given', 'cargo is given', 'period is in 2001']) AS rule,
              unnest([count(*) FILTER (estado <> 'cerrado'), 0, count(*) FILTER (cargo IS NULL),
                      count(*) FILTER (year(fecha) <> 2001)]) AS n_violations
       FROM movements""",
    "movements",
)
def dq_domain(spark, sf):
    """Rules over movements in one pass; one of them names too few states on purpose."""
    rules = {
        "estado is known": q.allowed("estado", ["cerrado"]),
        "fecha is given": q.given("fecha"),
        "cargo is given": q.given("cargo"),
        "period is in 2001": F.col("period").startswith("2001-"),
    }
    return q.violations(v.movements(spark, sf), rules)


@query(
    """SELECT 'type is known' AS rule, 0::BIGINT AS n_violations
       UNION ALL SELECT 'number is well formed', count(*) FILTER (length(account_number) > 5) FROM accounts""",
    "accounts",
)
def dq_account_format(spark, sf):
    rules = {"type is known": q.allowed("type", KINDS), "number is well formed": q.account_number_ok()}
    return q.violations(v.accounts(spark, sf), rules)


@query("""
    SELECT c_name, CASE WHEN length(c_mktsegment) > 5 THEN 'length' WHEN c_mktsegment ~ '[^A-Z]' THEN 'characters' END AS error
    FROM customer""")
def dq_account_errors(spark, sf):
    """Segment names are no account numbers."""
    named = v.table(spark, sf, "customer").select("c_name", "c_mktsegment")
    return q.account_number_errors(named, "c_mktsegment").select("c_name", "error")


@query("""
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n_rows FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""")
def dq_keys(spark, sf):
    lines = v.table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return q.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT cuenta, count(*) AS n_rows FROM movements
       WHERE cuenta NOT IN (SELECT account_number FROM accounts WHERE type = 'debit') GROUP BY cuenta""",
    "movements",
    "accounts",
)
def dq_orphans(spark, sf):
    debit = v.accounts(spark, sf).filter(F.col("type") == "debit")
    return q.orphans(v.movements(spark, sf), debit, {"cuenta": "account_number"})


@query(
    """SELECT category_group, category_subgroup, count(*) AS n_rows FROM concepts
       WHERE category_group IS NOT NULL AND category_subgroup IS NOT NULL
         AND category_group NOT IN ('1-URGENT', '2-HIGH')
       GROUP BY ALL""",
    "concepts",
)
def dq_orphan_categories(spark, sf):
    """Two-column reference; a NULL part is not checked."""
    rows = v.concepts(spark, sf)
    pairs = rows.filter(F.col("category_group").isin("1-URGENT", "2-HIGH")).select(
        F.col("category_group").alias("group"), F.col("category_subgroup").alias("subgroup")
    )
    return q.orphans(rows, pairs, {"category_group": "group", "category_subgroup": "subgroup"})


@query(
    "SELECT 'year matches' AS rule, count(*) FILTER (year_value = 1999) AS n_violations FROM days",
    "days",
)
def dq_year(spark, sf):
    days = cutoff_days(v.years(spark, sf)).withColumn(
        "cutoff_date", F.when(F.col("year_value") == 1999, F.add_months("cutoff_date", 12)).otherwise(F.col("cutoff_date"))
    )
    return q.violations(days, {"year matches": q.year_matches("cutoff_date", "year_value")})


_ROW = "fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono, file_name"
_TEXT = "fecha::VARCHAR AS fecha, unique_concept, cargo::VARCHAR AS cargo, abono::VARCHAR AS abono, file_name"
_COLUMNS = (*MOVEMENT_KEY, "file_name")


@query(f"SELECT {_TEXT} FROM loaded EXCEPT SELECT {_TEXT} FROM stored", "stored", "loaded")
def diff_added(spark, sf):
    changes = d.row_changes(v.stored(spark, sf).select(*_COLUMNS), v.loaded(spark, sf).select(*_COLUMNS))
    return changes.filter(F.col("change") == "added").drop("change")


@query(f"SELECT {_TEXT} FROM stored EXCEPT SELECT {_TEXT} FROM loaded", "stored", "loaded")
def diff_removed(spark, sf):
    changes = d.row_changes(v.stored(spark, sf).select(*_COLUMNS), v.loaded(spark, sf).select(*_COLUMNS))
    return changes.filter(F.col("change") == "removed").drop("change")


_KEYS = "fecha, unique_concept, cargo, abono"


@query(
    f"""SELECT fecha::VARCHAR AS fecha, unique_concept, cargo::DOUBLE AS cargo, abono::DOUBLE AS abono
        FROM (SELECT {_KEYS} FROM stored UNION ALL SELECT {_KEYS} FROM loaded) u
        GROUP BY u.fecha, unique_concept, u.cargo, u.abono HAVING count(*) = 1""",
    "stored",
    "loaded",
)
def diff_once(spark, sf):
    return d.occurring_once(v.stored(spark, sf).select(*MOVEMENT_KEY), v.loaded(spark, sf).select(*MOVEMENT_KEY))


@query("""
    SELECT event_type, user_id, fecha::VARCHAR AS fecha
    FROM (SELECT event_type, user_id, ts::DATE AS fecha FROM events UNION ALL
          SELECT event_type, user_id, ts::DATE FROM events WHERE event_type = 'view') u
    GROUP BY event_type, user_id, u.fecha HAVING count(*) = 1""")
def diff_once_copies(spark, sf):
    """Rows that may occur many times within and across the two versions."""
    rows = v.table(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("fecha"))
    return d.occurring_once(rows, rows.filter(F.col("event_type") == "view"))


@query(
    f"""SELECT NOT EXISTS (SELECT {_KEYS} FROM stored EXCEPT ALL SELECT {_KEYS} FROM loaded)
           AND NOT EXISTS (SELECT {_KEYS} FROM loaded EXCEPT ALL SELECT {_KEYS} FROM stored) AS equal""",
    "stored",
    "loaded",
)
def datasets_differ(spark, sf):
    return d.same_content(v.stored(spark, sf).select(*MOVEMENT_KEY), v.loaded(spark, sf).select(*MOVEMENT_KEY))


@query("SELECT count(*) > 0 AS equal FROM movements", "movements")
def datasets_equal(spark, sf):
    """The same rows, once as they come and once in two halves the other way round."""
    rows = v.movements(spark, sf)
    halves = rows.filter(F.col("estado") == "abierto").unionByName(rows.filter(F.col("estado") == "cerrado"))
    return d.same_content(rows, halves)


@query(
    f"""SELECT (SELECT count(*) FROM loaded) AS rows_new, (SELECT count(*) FROM stored) AS rows_old,
               'extra' AS columns_added, 'concepto,cuenta,estado,file_date,period,saldo' AS columns_removed,
               (SELECT count(*) FROM (SELECT {_TEXT} FROM loaded EXCEPT SELECT {_TEXT} FROM stored) a) AS rows_added,
               (SELECT count(*) FROM (SELECT {_TEXT} FROM stored EXCEPT SELECT {_TEXT} FROM loaded) b) AS rows_removed""",
    "stored",
    "loaded",
)
def snapshot_summary(spark, sf):
    return d.summary(v.stored(spark, sf), v.loaded(spark, sf).select(*_COLUMNS).withColumn("extra", F.lit(1)))


@query("""
    SELECT event_id, event_type, value FROM events
    ORDER BY md5('7|' || event_id), event_id LIMIT 500""")
def preview_sample(spark, sf):
    return sample(v.table(spark, sf, "events").select("event_id", "event_type", "value"), 500, ["event_id"], seed=7)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def preview_head(spark, sf):
    ordered = v.table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return head(ordered).select("o_orderkey")
