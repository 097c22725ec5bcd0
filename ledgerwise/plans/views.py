"""The given tables seen as a ledger, once as DataFrames and once as SQL for an independent engine.

customer -> accounts, orders -> movements, orders + customer + nation -> classification, documents and budgets,
events -> amounts with a category.  All rows of the tables take part; roles (closed or open, classified or not,
stored before or loaded now) follow from status, priority, segment, balance and date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.functions.dates import day
from ledgerwise.functions.text import unique_concept
from ledgerwise.operators.enrich import enriched_table, of_known_accounts
from ledgerwise.operators.joins import by_merge

AS_OF = "2001-07-31"
RUN_TS = "2001-07-31 06:00:00"
OPEN_FROM = "2001-07-01"
# movements before this day are stored already, movements from the earlier day on are loaded (again)
STORED_UNTIL, LOADED_FROM = "2001-01-01", "2000-07-01"
EVENTS_AS_OF, EVENTS_OPEN_FROM = "2024-01-31", "2024-01-24"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_ts():
    return F.lit(RUN_TS).cast("timestamp")


def account_number(key) -> F.Column:
    text = F.col(key).cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def account_type():
    return F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "credit").otherwise("debit")


def accounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        account_number("c_custkey").alias("account_number"), account_type().alias("type")
    )


def _from_orders(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(12,2)")
    fecha = F.col("o_orderdate").cast("date")
    concepto = F.when(F.col("o_orderpriority") == "5-LOW", "PAGO NÓMINA").otherwise(
        F.concat(F.lit("SPEI "), F.col("o_orderkey").cast("string"))
    )
    zero = F.lit(0).cast("decimal(12,2)")
    return orders.withColumns(
        {
            "fecha": fecha,
            "concepto": concepto,
            "cargo": F.when(F.col("o_orderstatus") != "O", price),
            "abono": F.when(F.col("o_orderstatus") == "O", price).when(F.col("o_orderstatus") == "P", zero),
            "saldo": F.lit(None).cast("decimal(12,2)"),
            "file_date": F.last_day(fecha),
            "estado": F.when(fecha < day(OPEN_FROM), "cerrado").otherwise("abierto"),
            "cuenta": account_number("o_custkey"),
            "unique_concept": unique_concept(concepto),
            "period": F.date_format(fecha, "yyyy-MM"),
        }
    ).withColumn("file_name", F.concat(F.concat_ws(" ", "period", "cuenta"), F.lit(".csv")))


MOVEMENT_COLUMNS = (
    "fecha", "concepto", "cargo", "abono", "saldo", "file_date", "file_name", "estado", "cuenta", "unique_concept",
    "period",
)


def movements(spark, sf_dir, kind: str | None = None, estado: str | None = None) -> DataFrame:
    """All movements, or those of one account type, or of one state."""
    rows = _from_orders(table(spark, sf_dir, "orders")).select(*MOVEMENT_COLUMNS)
    if estado:
        rows = rows.filter(F.col("estado") == estado)
    return of_known_accounts(rows, accounts(spark, sf_dir), kind) if kind else rows


def concepts(spark, sf_dir) -> DataFrame:
    """Classification of every movement whose priority is specified."""
    rows = _from_orders(table(spark, sf_dir, "orders")).filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = rows.join(by_merge(people), F.col("o_custkey") == F.col("c_custkey"))
    unclassified = (F.col("c_mktsegment") == "FURNITURE") & (F.col("o_orderpriority") == "5-LOW")
    group = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Balance 0").otherwise(F.col("o_orderpriority"))
    return joined.select(
        "fecha",
        "unique_concept",
        F.col("cargo").cast("decimal(14,2)").alias("cargo"),
        F.col("abono").cast("decimal(14,2)").alias("abono"),
        "concepto",
        "cuenta",
        "estado",
        F.when(~unclassified, group).alias("category_group"),
        F.when(~unclassified, F.col("c_mktsegment")).alias("category_subgroup"),
        F.col("n_name").alias("beneficiario"),
        F.col("file_date").cast("timestamp").alias("updated_at"),
    )


def enriched(spark, sf_dir, kind: str | None = None, estado: str | None = None) -> DataFrame:
    return enriched_table(movements(spark, sf_dir, kind, estado), concepts(spark, sf_dir))


def stored(spark, sf_dir) -> DataFrame:
    """Movements that an earlier load brought."""
    return movements(spark, sf_dir).filter(F.col("fecha") < day(STORED_UNTIL))


def loaded(spark, sf_dir) -> DataFrame:
    """Movements that this load brings, some of them again under another file name."""
    rows = movements(spark, sf_dir).filter(F.col("fecha") >= day(LOADED_FROM))
    return rows.withColumn("file_name", F.concat(F.lit("reload "), F.col("file_name")))


def documents(spark, sf_dir) -> DataFrame:
    """One document per account and month with movements, and open ones for accounts below a balance."""
    customer = table(spark, sf_dir, "customer").select(
        account_number("c_custkey").alias("account_number"),
        account_type().alias("type"),
        "c_mktsegment",
        "c_acctbal",
        F.col("c_name").cast("binary").alias("_bytes"),
    )
    months = movements(spark, sf_dir).select(
        F.col("period").alias("cutoff_period"), F.col("cuenta").alias("account_number"), "file_date"
    )
    dated = months.distinct().join(by_merge(customer), "account_number").withColumns(
        {
            "updated_at": F.col("file_date").cast("timestamp"),
            "pdf_file": F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.col("_bytes")).when(
                F.col("c_mktsegment") == "MACHINERY", F.lit("").cast("binary")
            ),
            "csv_file": F.when(F.col("c_acctbal") > 3000, F.col("_bytes")),
        }
    )
    opened = customer.filter(F.col("c_acctbal") < 5000).withColumns(
        {
            "cutoff_period": F.lit("open"),
            "updated_at": F.when(F.col("c_acctbal") >= 2500, F.lit(RUN_TS).cast("timestamp"))
            .when(F.col("c_acctbal") >= 0, F.lit("2001-07-30 23:59:59").cast("timestamp")),
            "pdf_file": F.lit(None).cast("binary"),
            "csv_file": F.when(F.col("c_mktsegment") == "MACHINERY", F.col("_bytes")),
        }
    )
    columns = ("cutoff_period", "account_number", "type", "updated_at", "pdf_file", "csv_file")
    both = dated.select(*columns).unionByName(opened.select(*columns))
    names = {f"{p}_filename": F.lit(None).cast("string") for p in ("pdf", "csv")}
    return both.withColumns(names)


def years(spark, sf_dir) -> DataFrame:
    return movements(spark, sf_dir).select(F.year("fecha").alias("year_value")).distinct()


def budget(spark, sf_dir) -> DataFrame:
    """One line per order priority plus lines that no movement matches or that are zero."""
    priority = F.col("o_orderpriority")
    lines = table(spark, sf_dir, "orders").select(priority.alias("concepto_match")).distinct()
    monthly = F.length("concepto_match") * F.lit(100000) - F.lit(500000)
    return lines.select(
        F.concat(F.lit("Presupuesto "), F.col("concepto_match")).alias("categoria"),
        monthly.cast("decimal(18,2)").alias("presupuesto_mensual"),
        "concepto_match",
    )


def event_amounts(spark, sf_dir) -> DataFrame:
    """Events as movements with a category and one amount."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("fecha"),
        F.col("event_type").alias("categoria"),
        F.col("value").cast("decimal(12,2)").alias("monto"),
    )


def comparable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, decimals as doubles: types two engines hand out the same way."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            columns.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("decimal"):
            columns.append(F.col(name).cast("double").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


# --- the same views for the other engine -----------------------------------------------------------------------------
def sql_concept(text: str) -> str:
    """SQL of the unique concept rule."""
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    letters = rf"regexp_replace({text}, '[^\p{{L}}]', '', 'g')"
    return f"CASE WHEN {text} IS NULL THEN '' WHEN {digits} <> '' THEN {digits} ELSE {letters} END"


def _sql_account(key: str) -> str:
    return f"CASE WHEN {key} < 10000 THEN lpad({key}::VARCHAR, 5, '0') ELSE {key}::VARCHAR END"


_TYPE = "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'credit' ELSE 'debit' END"

SQL_VIEWS = {
    "accounts": f"SELECT {_sql_account('c_custkey')} AS account_number, {_TYPE} AS type FROM customer",
    "priced": f"""
        SELECT *, o_orderdate::DATE AS fecha, o_totalprice::DECIMAL(12,2) AS price,
               CASE o_orderpriority WHEN '5-LOW' THEN 'PAGO NÓMINA' ELSE 'SPEI ' || o_orderkey END AS concepto,
               {_sql_account("o_custkey")} AS cuenta
        FROM orders""",
    "ledger": f"""
        SELECT *,
               CASE WHEN o_orderstatus <> 'O' THEN price END AS cargo,
               CASE o_orderstatus WHEN 'O' THEN price WHEN 'P' THEN 0::DECIMAL(12,2) END AS abono,
               NULL::DECIMAL(12,2) AS saldo,
               last_day(fecha) AS file_date,
               CASE WHEN fecha < DATE '{OPEN_FROM}' THEN 'cerrado' ELSE 'abierto' END AS estado,
               {sql_concept("concepto")} AS unique_concept,
               strftime(fecha, '%Y-%m') AS period,
               strftime(fecha, '%Y-%m') || ' ' || cuenta || '.csv' AS file_name
        FROM priced""",
    "movements": f"SELECT {', '.join(MOVEMENT_COLUMNS)} FROM ledger",
    "concepts": """
        SELECT fecha, unique_concept, cargo, abono, concepto, cuenta, estado,
               CASE WHEN c_mktsegment = 'FURNITURE' AND o_orderpriority = '5-LOW' THEN NULL
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Balance 0' ELSE o_orderpriority END AS category_group,
               CASE WHEN c_mktsegment = 'FURNITURE' AND o_orderpriority = '5-LOW' THEN NULL
                    ELSE c_mktsegment END AS category_subgroup,
               n_name AS beneficiario, file_date::TIMESTAMP AS updated_at
        FROM ledger JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "enriched": """
        SELECT m.*, k.beneficiario, k.category_group AS categoria, k.category_subgroup AS grupo
        FROM movements m LEFT JOIN concepts k
          ON m.fecha = k.fecha AND m.unique_concept = k.unique_concept
         AND m.cargo IS NOT DISTINCT FROM k.cargo AND m.abono IS NOT DISTINCT FROM k.abono""",
    "stored": f"SELECT * FROM movements WHERE fecha < DATE '{STORED_UNTIL}'",
    "loaded": f"""
        SELECT * REPLACE ('reload ' || file_name AS file_name) FROM movements WHERE fecha >= DATE '{LOADED_FROM}'""",
    "documents_t": f"""
        SELECT DISTINCT m.period AS cutoff_period, a.account_number, a.type, m.file_date::TIMESTAMP AS updated_at,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_name
                    WHEN c_mktsegment = 'MACHINERY' THEN '' END AS pdf_file,
               CASE WHEN c_acctbal > 3000 THEN c_name END AS csv_file
        FROM movements m JOIN accounts a ON m.cuenta = a.account_number
        JOIN customer ON {_sql_account("c_custkey")} = a.account_number
        UNION ALL
        SELECT 'open', {_sql_account("c_custkey")}, {_TYPE},
               CASE WHEN c_acctbal >= 2500 THEN TIMESTAMP '{RUN_TS}'
                    WHEN c_acctbal >= 0 THEN TIMESTAMP '2001-07-30 23:59:59' END,
               NULL, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name END
        FROM customer WHERE c_acctbal < 5000""",
    "flags": """
        SELECT cutoff_period, account_number, type, updated_at,
               coalesce(length(pdf_file) > 0, false) AS has_pdf, coalesce(length(csv_file) > 0, false) AS has_csv
        FROM documents_t""",
    "years": "SELECT DISTINCT year(fecha)::INTEGER AS year_value FROM movements",
    "days": """
        SELECT year_value, make_date(year_value, m::INTEGER, 6) AS cutoff_date,
               year_value || '-' || lpad(m::VARCHAR, 2, '0') AS period
        FROM years, range(1, 13) r(m)""",
    "account_cutoffs": f"""
        SELECT account_number, type, period AS cutoff_period FROM accounts, days
        WHERE cutoff_date < DATE '{AS_OF}'""",
    "budget": """
        SELECT DISTINCT 'Presupuesto ' || o_orderpriority AS categoria, o_orderpriority AS concepto_match,
               (length(o_orderpriority) * 100000 - 500000)::DECIMAL(18,2) AS presupuesto_mensual
        FROM orders""",
    "amounts": """
        SELECT event_id, ts::DATE AS fecha, event_type AS categoria, value::DECIMAL(12,2) AS monto FROM events""",
}
_NEEDS = {
    "priced": [], "accounts": [], "ledger": ["priced"], "movements": ["ledger"], "concepts": ["ledger"],
    "enriched": ["movements", "concepts"], "stored": ["movements"], "loaded": ["movements"],
    "documents_t": ["movements", "accounts"], "flags": ["documents_t"], "years": ["movements"], "days": ["years"],
    "account_cutoffs": ["accounts", "days"], "budget": [], "amounts": [],
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in ordered)
    return f"WITH {ctes}\n{sql}"
