"""Enrichment joins, reports and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.operators import enrich as en
from ledgerwise.operators import reports as r
from ledgerwise.plans import views as v
from ledgerwise.plans.registry import query
from ledgerwise.shared import staged

_KEY = "m.fecha::VARCHAR AS fecha, m.unique_concept, m.cargo::DOUBLE AS cargo, m.abono::DOUBLE AS abono"
_ON_NULL_SAFE = (
    "m.fecha = k.fecha AND m.unique_concept = k.unique_concept"
    " AND m.cargo IS NOT DISTINCT FROM k.cargo AND m.abono IS NOT DISTINCT FROM k.abono"
)
_ON_PLAIN = "m.fecha = k.fecha AND m.unique_concept = k.unique_concept AND m.cargo = k.cargo AND m.abono = k.abono"
_CLASS = "k.category_group, k.category_subgroup, k.beneficiario"
_CLASS_COLUMNS = ("category_group", "category_subgroup", "beneficiario")


def _sums(rows: str) -> str:
    return f"""
        SELECT 0 AS sort_key, categoria, sum(abono)::DOUBLE AS total_abono, sum(cargo)::DOUBLE AS total_cargo
        FROM {rows} GROUP BY categoria
        UNION ALL SELECT 1, 'Total', sum(abono)::DOUBLE, sum(cargo)::DOUBLE FROM {rows}"""


@query(_sums("enriched"), "enriched")
def category_report_credit(spark, sf):
    return r.in_report_order(r.category_report(v.enriched(spark, sf)))


@query(_sums("(SELECT * FROM enriched WHERE categoria <> 'Balance 0') e"), "enriched")
def category_report_debit(spark, sf):
    return r.in_report_order(r.category_report(v.enriched(spark, sf), balanced=False))


_NEWEST_CLOSED = """(SELECT * FROM enriched WHERE estado = 'cerrado' AND file_date =
    (SELECT max(file_date) FROM enriched WHERE estado = 'cerrado')) c"""


@query(_sums(_NEWEST_CLOSED), "enriched")
def closed_report_credit(spark, sf):
    return r.in_report_order(r.closed_report(v.enriched(spark, sf, estado="cerrado")))


@query(_sums(f"(SELECT * FROM {_NEWEST_CLOSED} WHERE categoria <> 'Balance 0') b"), "enriched")
def closed_report_debit(spark, sf):
    return r.in_report_order(r.closed_report(v.enriched(spark, sf, estado="cerrado"), balanced=False))


@query(
    f"""SELECT categoria, type AS tipo, sum(coalesce(abono, 0))::DOUBLE AS abonos_mtd,
               sum(coalesce(cargo, 0))::DOUBLE AS cargos_mtd
        FROM (SELECT m.*, k.category_group AS categoria FROM movements m LEFT JOIN concepts k ON {_ON_PLAIN}) e
        JOIN accounts ON cuenta = account_number
        WHERE date_trunc('month', fecha) = DATE '2001-07-01' GROUP BY ALL""",
    "movements",
    "concepts",
    "accounts",
)
def mtd_by_concept(spark, sf):
    kinds = [v.movements(spark, sf, kind).withColumn("tipo", F.lit(kind)) for kind in ("debit", "credit")]
    classified = en.enrich(kinds[0].unionByName(kinds[1]), v.concepts(spark, sf), null_safe=False)
    return r.month_to_date(classified.withColumn("categoria", F.col("category_group")), v.AS_OF)


def _classified(spark, sf):
    """Movements with a classification, matched by equality, and their one amount."""
    both = en.enrich(v.movements(spark, sf), v.concepts(spark, sf), null_safe=False, how="inner")
    columns = ("fecha", "unique_concept", "cuenta", "estado", "monto", F.col("category_group").alias("categoria"))
    return r.with_amount(both).select(*columns)


@query(
    f"""SELECT k.category_group AS categoria, round(avg(coalesce(m.cargo, m.abono)::DOUBLE), 4) AS promedio,
               round(stddev_samp(coalesce(m.cargo, m.abono)::DOUBLE), 4) AS desviacion
        FROM movements m JOIN concepts k ON {_ON_PLAIN}
        WHERE m.fecha >= DATE '2001-01-31' GROUP BY 1""",
    "movements",
    "concepts",
)
def category_stats(spark, sf):
    return _rounded(r.category_stats(_classified(spark, sf), v.AS_OF))


def _rounded(df):
    """Statistics at four decimals: sums of doubles depend on the order of addition beyond that."""
    return df.withColumns({c: F.round(c, 4) for c in ("promedio", "desviacion")})


def _outlier_sql(rows: str, history: str, as_of: str, key: str) -> str:
    return f"""
        SELECT {key}, r.fecha::VARCHAR AS fecha, r.categoria, r.monto::DOUBLE AS monto, round(promedio, 4) AS promedio,
               round(desviacion, 4) AS desviacion,
               CASE WHEN r.monto::DOUBLE > promedio + 2 * desviacion THEN '🚨 ANOMALÍA' ELSE '✅ Normal' END AS alerta
        FROM {rows} r LEFT JOIN (
            SELECT categoria, avg(monto::DOUBLE) AS promedio, stddev_samp(monto::DOUBLE) AS desviacion
            FROM {history} h WHERE fecha >= (DATE '{as_of}' - INTERVAL 6 MONTH)::DATE GROUP BY categoria
        ) stats ON r.categoria = stats.categoria
        WHERE r.fecha >= DATE '{as_of}' - 30"""


@query(
    _outlier_sql(
        f"(SELECT * FROM amounts WHERE fecha >= DATE '{v.EVENTS_OPEN_FROM}')",
        f"(SELECT * FROM amounts WHERE fecha < DATE '{v.EVENTS_OPEN_FROM}')",
        v.EVENTS_AS_OF,
        "event_id",
    ),
    "amounts",
)
def outliers(spark, sf):
    amounts, opened = v.event_amounts(spark, sf), v.day(v.EVENTS_OPEN_FROM)
    stats = r.category_stats(amounts.filter(F.col("fecha") < opened), v.EVENTS_AS_OF)
    return _rounded(r.flag_outliers(amounts.filter(F.col("fecha") >= opened), stats, v.EVENTS_AS_OF))


_MONTO = f"""(SELECT m.*, k.category_group AS categoria, coalesce(m.cargo, m.abono) AS monto
              FROM movements m JOIN concepts k ON {_ON_PLAIN})"""


@query(
    _outlier_sql(
        f"(SELECT * FROM {_MONTO} o WHERE estado = 'abierto')",
        f"(SELECT * FROM {_MONTO} c WHERE estado = 'cerrado')",
        v.AS_OF,
        "r.unique_concept, r.cuenta",
    ),
    "movements",
    "concepts",
)
def outliers_of_movements(spark, sf):
    # the join is made once, over the months that statistics or marks look at
    recent = F.col("fecha") >= F.add_months(v.day(v.AS_OF), -6)
    rows = staged(_classified(spark, sf).filter(recent), "classified")
    stats = r.category_stats(rows.filter(F.col("estado") == "cerrado"), v.AS_OF)
    flagged = r.flag_outliers(rows.filter(F.col("estado") == "abierto"), stats, v.AS_OF)
    columns = ("unique_concept", "cuenta", "fecha", "categoria", "monto", "promedio", "desviacion", "alerta")
    return _rounded(flagged).select(*columns)


def _priced(spark, sf):
    """Movements whose concept is the order priority, so that budget lines match many of them."""
    orders = v.table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("unique_concept"),
        F.col("o_orderdate").cast("date").alias("fecha"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice").cast("decimal(12,2)")).alias("cargo"),
    )


def _budget_sql(lines: str) -> str:
    return f"""
        SELECT categoria, presupuesto_mensual::DOUBLE AS presupuesto_mensual, gasto::DOUBLE AS gasto_real,
               (presupuesto_mensual - gasto)::DOUBLE AS diferencia,
               round(100.0 * gasto::DOUBLE / nullif(presupuesto_mensual, 0)::DOUBLE, 2) AS porcentaje_usado
        FROM (SELECT categoria, presupuesto_mensual, coalesce(sum(cargo), 0) AS gasto FROM ({lines}) l GROUP BY ALL) s"""


_SPENDING = "SELECT CASE WHEN o_orderstatus <> 'O' THEN price END AS cargo, fecha, o_orderpriority AS concept FROM priced"


@query(
    _budget_sql(f"""SELECT b.*, s.cargo FROM budget b LEFT JOIN ({_SPENDING}) s ON concepto_match = concept
                    WHERE date_trunc('month', fecha) = DATE '2001-07-01' OR fecha IS NULL"""),
    "budget",
    "priced",
)
def budget_vs_actual(spark, sf):
    return r.budget_vs_actual(v.budget(spark, sf), _priced(spark, sf), v.AS_OF)


@query(
    _budget_sql(f"""SELECT b.*, CASE WHEN date_trunc('month', fecha) = DATE '2001-08-01' THEN s.cargo END AS cargo
                    FROM budget b LEFT JOIN ({_SPENDING}) s ON concepto_match = concept"""),
    "budget",
    "priced",
)
def budget_keep_all(spark, sf):
    return r.budget_vs_actual(v.budget(spark, sf), _priced(spark, sf), "2001-08-01", keep_all=True)


@query("SELECT cuenta, count(*) AS n_rows FROM movements WHERE cuenta IS NOT NULL GROUP BY cuenta", "movements")
def count_by_account(spark, sf):
    return r.rows_per_account(v.movements(spark, sf))


@query("SELECT cuenta, max(file_date)::VARCHAR AS max_date FROM movements GROUP BY cuenta", "movements")
def latest_file_date(spark, sf):
    return r.latest_file_date(v.movements(spark, sf))


@query("SELECT max(file_date)::VARCHAR AS max_date FROM movements", "movements")
def newest_file_date(spark, sf):
    return v.movements(spark, sf).agg(F.max("file_date").alias("max_date"))


_EXPORT = (
    "m.fecha::VARCHAR AS fecha, m.concepto, m.cargo::DOUBLE AS cargo, m.abono::DOUBLE AS abono, "
    "m.saldo::DOUBLE AS saldo, m.file_date::VARCHAR AS file_date, m.file_name, m.estado, m.cuenta, m.unique_concept, "
    "m.period, k.category_group, k.category_subgroup, k.beneficiario"
)


@query(f"SELECT {_EXPORT} FROM movements m LEFT JOIN concepts k ON {_ON_PLAIN}", "movements", "concepts")
def export_newest_first(spark, sf):
    closed, opened = (v.movements(spark, sf, estado=e) for e in ("cerrado", "abierto"))
    return en.newest_first(en.export_rows(closed, opened, v.concepts(spark, sf)))


@query(f"SELECT {_KEY}, m.cuenta, {_CLASS} FROM movements m LEFT JOIN concepts k ON {_ON_NULL_SAFE}", "enriched")
def enrich_nullsafe(spark, sf):
    joined = en.enrich(v.movements(spark, sf), v.concepts(spark, sf))
    return joined.select("fecha", "unique_concept", "cargo", "abono", "cuenta", *_CLASS_COLUMNS)


@query(f"SELECT {_KEY}, m.cuenta, {_CLASS} FROM movements m LEFT JOIN concepts k ON {_ON_PLAIN}", "enriched")
def enrich_plain(spark, sf):
    joined = en.enrich(v.movements(spark, sf), v.concepts(spark, sf), null_safe=False)
    return joined.select("fecha", "unique_concept", "cargo", "abono", "cuenta", *_CLASS_COLUMNS)


@query(
    f"""SELECT {_KEY}, m.cuenta, {_CLASS} FROM movements m LEFT JOIN concepts k ON {_ON_PLAIN}
        WHERE m.estado = 'cerrado'""",
    "enriched",
)
def enrich_row_value(spark, sf):
    """Row-value equality: a NULL part never matches (some engines compare rows null-safe, so the SQL spells it out)."""
    closed = v.movements(spark, sf, estado="cerrado")
    joined = en.enrich(closed, v.concepts(spark, sf), null_safe=False)
    return joined.select("fecha", "unique_concept", "cargo", "abono", "cuenta", *_CLASS_COLUMNS)


@query(f"SELECT {_KEY}, m.cuenta, {_CLASS} FROM movements m JOIN concepts k ON {_ON_PLAIN}", "enriched")
def enrich_inner(spark, sf):
    joined = en.enrich(v.movements(spark, sf), v.concepts(spark, sf), null_safe=False, how="inner")
    return joined.select("fecha", "unique_concept", "cargo", "abono", "cuenta", *_CLASS_COLUMNS)


_PAGE = """SELECT * FROM concepts
           ORDER BY fecha DESC, unique_concept, cargo NULLS FIRST, abono NULLS FIRST LIMIT 1000"""
_PAGE_OF_CLOSED = _PAGE.replace("FROM concepts", "FROM concepts WHERE estado = 'cerrado'")
_PAGE_OUT = """fecha::VARCHAR AS fecha, unique_concept, concepto, cuenta, estado, cargo::DOUBLE AS cargo,
               abono::DOUBLE AS abono, category_group, category_subgroup, beneficiario"""
_PAGE_COLUMNS = ("fecha", "unique_concept", "concepto", "cuenta", "estado", "cargo", "abono", *_CLASS_COLUMNS)


@query(f"SELECT {_PAGE_OUT} FROM ({_PAGE}) p", "concepts")
def top_newest(spark, sf):
    return r.newest_page(v.concepts(spark, sf), 1000).select(*_PAGE_COLUMNS)


@query(f"SELECT {_PAGE_OUT} FROM ({_PAGE_OF_CLOSED}) p", "concepts")
def filtered_page(spark, sf):
    """The filter first, then the page, so that no matching row is lost to others."""
    return r.newest_page(r.pick(v.concepts(spark, sf), "cerrado", "Todas"), 1000).select(*_PAGE_COLUMNS)


@query(f"SELECT {_PAGE_OUT} FROM concepts WHERE estado = 'abierto'", "concepts")
def filtered_movements(spark, sf):
    """The filter over everything."""
    return r.pick(v.concepts(spark, sf), "abierto").select(*_PAGE_COLUMNS)


@query("SELECT DISTINCT category_group, category_subgroup FROM concepts", "concepts")
def catalog_list(spark, sf):
    return r.catalogue(v.concepts(spark, sf), "category_group", "category_subgroup")


@query("SELECT DISTINCT beneficiario FROM concepts WHERE beneficiario IS NOT NULL", "concepts")
def beneficiary_choices(spark, sf):
    return r.choices(v.concepts(spark, sf), "beneficiario")


@query("SELECT DISTINCT cuenta FROM concepts WHERE cuenta IS NOT NULL", "concepts")
def account_choices(spark, sf):
    return r.choices(v.concepts(spark, sf), "cuenta")


@query("SELECT account_number, type FROM accounts", "accounts")
def account_list(spark, sf):
    return v.accounts(spark, sf).orderBy("account_number")
