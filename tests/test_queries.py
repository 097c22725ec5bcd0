"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ledgerwise.operators.joins import salted_lookup
from ledgerwise.plans import registry
from ledgerwise.plans import views as v

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# these write files first; tests/test_files.py covers the same operators on small folders
WRITES_FILES = {"daily_load", "stream_ingest", "statement_scan", "today_statements", "binary_scan", "header_contract"}
NAMES = [n for n in registry.QUERIES if n not in WRITES_FILES]


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf, oracle, name):
    df = driver.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert got == want
    assert got, "a check on no rows shows nothing"


def test_entry(spark):
    assert driver.entry(spark).count() > 1


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert set(registry.QUERIES) <= set(driver.queries()) and set(registry.ORACLE_SQL) <= set(driver.oracle_sql())


# --- plans -----------------------------------------------------------------------------------------------------------
def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables beyond the broadcast threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LAZY = [n for n in NAMES if n not in {"today_files", "upsert_stored_table", "overwrite_open", "rebuild_enriched",
                                      "snapshot_fed", "snapshot_of_yesterday", "export_sets", "load_rejects",
                                      "feed_job", "export_job"}]


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, sf, no_broadcast, name):
    plan = plan_of(driver.queries()[name](spark, sf))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|InPandas|InArrow|ArrowEval", plan)


@pytest.mark.parametrize("name", ["top2_cutoffs", "dedup_keep_last", "update_classification"])
def test_ranks_are_limited_before_the_shuffle(spark, sf, name):
    plan = plan_of(driver.queries()[name](spark, sf))
    assert re.search(r"WindowGroupLimit[^\n]*Final.*Exchange hashpartitioning.*WindowGroupLimit[^\n]*Partial", plan, re.S)


@pytest.mark.parametrize("name", ["category_report_credit", "budget_vs_actual", "diff_added", "dq_orphans", "load_counters"])
def test_groups_are_combined_before_the_shuffle(spark, sf, name):
    plan = plan_of(driver.queries()[name](spark, sf))
    assert "partial_" in plan


@pytest.mark.parametrize("name", ["diff_added", "diff_once", "datasets_differ", "load_counters", "dedup_keep_last"])
def test_one_shuffle_is_enough(spark, sf, no_broadcast, name):
    plan = plan_of(driver.queries()[name](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == (2 if name == "load_counters" else 1)


def test_month_filter_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(driver.queries()["outliers"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "props" not in plan


def test_newest_snapshot_is_a_subquery_in_the_scan(spark, tmp_path):
    from ledgerwise.operators.reports import newest_snapshot

    path = str(tmp_path / "t")
    spark.range(10).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("file_date")).write.parquet(path)
    df = newest_snapshot(spark.read.parquet(path))
    assert "EqualTo(file_date,ScalarSubquery" in plan_of(df)
    assert df.count() == 1


def test_salted_lookup_spreads_a_hot_key(spark, no_broadcast):
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"))
    lookup = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = salted_lookup(hot, lookup, ["k"], salts=16)
    assert joined.count() == 3000
    assert joined.filter(F.col("twice") != F.col("k") * 2).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sizes = [r["count"] for r in joined.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 1500


def test_bucketed_tables_enrich_without_a_shuffle(spark, sf, no_broadcast):
    from ledgerwise.operators.enrich import enrich
    from ledgerwise.shared import new_path
    from ledgerwise.sources.store import COLOCATED_JOINS, save_bucketed

    for name, df in (("moves", v.movements(spark, sf)), ("known", v.concepts(spark, sf))):
        save_bucketed(df, f"bucketed_{name}", new_path(spark, name), 4)
    columns = ("fecha", "unique_concept", "cargo", "abono", "category_group")
    want = Counter(map(tuple, enrich(v.movements(spark, sf), v.concepts(spark, sf)).select(*columns).collect()))
    spark.conf.set(*COLOCATED_JOINS)
    try:
        joined = enrich(spark.table("bucketed_moves"), spark.table("bucketed_known")).select(*columns)
        assert "Exchange" not in plan_of(joined)
        assert Counter(map(tuple, joined.collect())) == want
    finally:
        spark.conf.unset(COLOCATED_JOINS[0])


def test_job_folder_removes_what_it_staged(spark):
    import os

    from ledgerwise.shared import job_folder, staged

    with job_folder(spark) as folder:
        assert staged(spark.range(3), "x").count() == 3
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_shared_folder_comes_from_the_session(spark):
    from ledgerwise.shared import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_mapping_is_whole(spark, sf):
    assert v.movements(spark, sf).count() == v.table(spark, sf, "orders").count()
    assert v.stored(spark, sf).unionByName(v.loaded(spark, sf)).select("fecha", "cuenta", "concepto").distinct().count() == (
        v.movements(spark, sf).select("fecha", "cuenta", "concepto").distinct().count()
    )
