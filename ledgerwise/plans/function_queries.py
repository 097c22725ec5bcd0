"""Scalar rules over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwise.functions import dates, text
from ledgerwise.operators.enrich import fill_period
from ledgerwise.operators.export import as_cells
from ledgerwise.plans import views as v
from ledgerwise.plans.registry import query


@query(f"SELECT doc_id, {v.sql_concept('text')} AS unique_concept FROM documents")
def unique_concept(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.unique_concept(F.col("text")).alias("unique_concept"))


def _written_dates(spark, sf):
    """Order dates as text: a different notation per priority, one of them no date at all."""
    when = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(when, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(when, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("x"), F.date_format(when, "yyyy")))
    )
    return v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", written.alias("written"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                            THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha
    FROM orders""")
def parse_dates(spark, sf):
    return _written_dates(spark, sf).select("o_orderkey", dates.parse_date(F.col("written")).alias("fecha"))


@query("""
    SELECT o_orderkey,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha,
           o_orderpriority IN ('1-URGENT', '2-HIGH') AS changed
    FROM orders""")
def repair_dates(spark, sf):
    written = F.col("written")
    return _written_dates(spark, sf).select(
        "o_orderkey", dates.repair_date(written).alias("fecha"), dates.repair_changed(written).alias("changed")
    )


@query("SELECT count(*) AS n_changed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def repair_dates_changed(spark, sf):
    return _written_dates(spark, sf).agg(F.count_if(dates.repair_changed(F.col("written"))).alias("n_changed"))


@query("""
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props
    FROM events""")
def null_markers(spark, sf):
    kind = F.col("event_type")
    marked = F.when(kind == "error", " NaN ").when(kind == "view", "N/A").otherwise(F.concat(F.lit("  "), kind))
    props = F.when(kind == "view", "<na>").otherwise(F.concat("props", F.lit("\t")))
    return v.table(spark, sf, "events").select(
        "event_id", text.clean_text(marked).alias("event_type"), text.clean_text(props).alias("props")
    )


@query(
    """SELECT cuenta, unique_concept,
              CASE WHEN estado = 'abierto' THEN '1900-01-01' ELSE fecha::VARCHAR END AS fecha
       FROM movements""",
    "movements",
)
def sentinel_dates(spark, sf):
    closed_only = F.when(F.col("estado") == "cerrado", F.col("fecha"))
    return v.movements(spark, sf).select("cuenta", "unique_concept", dates.or_unknown(closed_only).alias("fecha"))


@query(
    """SELECT fecha::VARCHAR AS fecha, cuenta, unique_concept,
              CASE estado WHEN 'cerrado' THEN strftime(fecha, '%Y-%m') ELSE 'given' END AS period
       FROM movements""",
    "movements",
)
def period_from_name(spark, sf):
    unset = F.when(F.col("estado") == "abierto", "given")
    return fill_period(v.movements(spark, sf).withColumn("period", unset)).select(
        "fecha", "cuenta", "unique_concept", "period"
    )


@query(
    """SELECT m.unique_concept, m.cuenta,
              CASE a.type WHEN 'debit' THEN '2001-07' ELSE '2001-08' END AS period
       FROM movements m JOIN accounts a ON m.cuenta = a.account_number WHERE m.estado = 'abierto'""",
    "movements",
    "accounts",
)
def open_period(spark, sf):
    def rows(kind):
        opened = v.movements(spark, sf, kind, "abierto")
        return opened.select("unique_concept", "cuenta", dates.open_period(kind, v.AS_OF).alias("period"))

    return rows("debit").unionByName(rows("credit"))


@query(r"""
    SELECT page_id, replace(url, '://', '://user' || page_id || ':***@') AS masked, url AS open_url FROM pages""")
def mask_uri(spark, sf):
    secret = F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":s3cr:et@"))
    pages = v.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        text.masked_uri(F.replace(F.col("url"), F.lit("://"), secret)).alias("masked"),
        text.masked_uri(F.col("url")).alias("open_url"),
    )


@query(
    """SELECT fecha::VARCHAR AS fecha, unique_concept, cuenta,
              strftime(fecha, '%Y-%m') AS period, make_date(year(fecha), month(fecha), 6)::VARCHAR AS cutoff,
              date_trunc('month', fecha)::DATE::VARCHAR AS month_start, year(fecha)::BIGINT AS year,
              (fecha + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_month,
              (fecha - INTERVAL 2 MONTH)::DATE::VARCHAR AS two_months_before,
              (fecha - 1)::VARCHAR AS day_before,
              strftime(fecha, '%Y-%m') >= '2000-05' AS from_may_2000,
              starts_with(strftime(fecha, '%Y-%m'), '2001-') AS in_2001
       FROM movements""",
    "movements",
)
def date_parts(spark, sf):
    fecha = F.col("fecha")
    period = dates.period(fecha)
    return v.movements(spark, sf).select(
        "fecha",
        "unique_concept",
        "cuenta",
        period.alias("period"),
        dates.cutoff_day(F.year(fecha), F.month(fecha)).alias("cutoff"),
        dates.month_start(fecha).alias("month_start"),
        F.year(fecha).cast("long").alias("year"),
        F.add_months(fecha, 1).alias("next_month"),
        F.add_months(fecha, -2).alias("two_months_before"),
        F.date_sub(fecha, 1).alias("day_before"),
        (period >= "2000-05").alias("from_may_2000"),
        dates.in_year(period, v.AS_OF).alias("in_2001"),
    )


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS fecha, ts < TIMESTAMP '2024-01-15' AS before,
           CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed
    FROM events""")
def safe_timestamps(spark, sf):
    written = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = F.try_to_timestamp(written)
    return v.table(spark, sf, "events").select(
        "event_id",
        F.to_date("ts").alias("fecha"),
        (F.to_date("ts") < v.day("2024-01-15")).alias("before"),
        F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"),
    )


@query("""
    SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey,
           l_suppkey::VARCHAR AS l_suppkey, l_quantity::DECIMAL(12,2)::VARCHAR AS quantity,
           strftime(l_shipdate, '%Y-%m-%d') AS fecha,
           CASE WHEN l_tax = 0 OR l_discount = 0 THEN '' ELSE l_discount::VARCHAR END AS rate,
           CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag
    FROM lineitem""")
def export_prep(spark, sf):
    rate = (
        F.when(F.col("l_tax") == 0, F.lit(float("nan")))
        .when(F.col("l_discount") == 0, F.lit(float("-inf")))
        .otherwise(F.col("l_discount"))
    )
    return as_cells(
        v.table(spark, sf, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
            F.col("l_shipdate").alias("fecha"),
            rate.alias("rate"),
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        )
    )
