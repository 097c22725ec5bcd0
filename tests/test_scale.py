"""Plans that must hold at size: nothing large goes through the driver or one task."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from ledgerwise.operators import calendar as c
from ledgerwise.operators import keyed
from ledgerwise.operators.enrich import CLASSIFICATION, enrich, of_known_accounts
from ledgerwise.operators.joins import not_in, present_in, salted_lookup
from ledgerwise.operators.ranking import latest_cutoffs
from ledgerwise.plans import file_queries, manifest_queries, registry
from ledgerwise.plans import views as v
from ledgerwise.sources import documents
from ledgerwise.sources import files as fs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_a_repeated_lookup_is_never_broadcast(spark, how):
    """Its size after the repetition is unknown to Catalyst, however small it takes the lookup to be."""
    facts = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("x", 4)], "k string, n int")
    lookup = spark.sql("SELECT * FROM VALUES ('a', 10), ('b', 20), (NULL, 30) AS t(k, m)")  # of known size
    joined = salted_lookup(facts, lookup, ["k"], how, null_safe=True)
    assert "Broadcast" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
    assert joined.count() == {"left": 4, "inner": 3, "left_semi": 3}[how]


def test_known_accounts_do_not_go_through_the_driver(spark):
    movements = spark.createDataFrame([("1", 1), ("1", 1), ("2", 2), (None, 3)], "cuenta string, n int")
    known = "('1', 'debit'), ('1', 'debit'), ('2', 'credit'), (NULL, 'debit')"
    accounts = spark.sql(f"SELECT * FROM VALUES {known} AS t(account_number, type)")
    found = of_known_accounts(movements, accounts, "debit")
    assert "Broadcast" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("1", 1), ("1", 1)]


def test_accounts_are_spread_before_they_get_their_cutoffs(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ids = spark.range(400, numPartitions=1)
        accounts = ids.select(F.col("id").cast("string").alias("account_number"), F.lit("debit").alias("type"))
        days = c.cutoff_days(spark.range(2020, 2022).select(F.col("id").cast("int").alias("year_value")))
        due = c.account_cutoffs(accounts.unionByName(accounts.limit(1)), days, "2022-01-01", F.lit("2022-01-01").cast("timestamp"))
        sizes = [r["count"] for r in due.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 401 * 24 and len(sizes) == 8 and max(sizes) < 401 * 24 / 4
        # a repeated account has its newest cutoff twice, and no more rows than any other
        newest = latest_cutoffs(due).groupBy("account_number").agg(F.count("*").alias("n"), F.min("cutoff_period").alias("first"))
        assert {tuple(r) for r in newest.groupBy("first", "n").count().collect()} == {("2021-12", 2, 1), ("2021-11", 2, 399)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "join, rows",
    [
        (lambda a, b: keyed.upsert(a, b, ["k"]), [("a", 1), ("a", 1), ("x", 4), (None, 9)]),
        (lambda a, b: keyed.upsert(b, a, ["k"], "ignore"), [("a", 1), ("a", 1), ("x", 4), (None, 9)]),
        (lambda a, b: keyed.new_rows(b, a.withColumn("file_name", F.lit("f")), ["k"]).select("k", "n"), [("a", 1), ("a", 1), ("x", 4)]),
        (lambda a, b: not_in(a, b, ["k"]), [("a", 1), ("a", 1), ("x", 4)]),
        (lambda a, b: present_in(a, b, ["k"]), [(None, 3)]),
    ],
)
def test_keys_that_grow_with_the_input_are_never_broadcast(spark, tmp_path, join, rows):
    """Files of keys say next to nothing about their rows; keys repeat and are missing."""
    spark.createDataFrame([("a", 1), ("a", 1), (None, 3), ("x", 4)], "k string, n int").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(None, 9)], "k string, n int").write.parquet(f"{tmp_path}/b")
    joined = join(*(spark.read.parquet(f"{tmp_path}/{t}") for t in "ab"))
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(rows, key=str)
    assert "Broadcast" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)


@pytest.mark.parametrize("null_safe, how, n", [(True, "left", 2), (False, "left", 2), (False, "inner", 0)])
def test_a_classification_is_never_broadcast(spark, null_safe, how, n):
    row = spark.sql("SELECT date'2024-01-02' AS fecha, 'c' AS unique_concept, 1.00BD AS cargo, CAST(NULL AS decimal(12,2)) AS abono")
    groups = {c: F.lit("g") for c in CLASSIFICATION}
    found = enrich(row.unionByName(row), row.withColumns(groups), null_safe, how)
    assert found.count() == n and found.filter("category_group = 'g'").count() == (2 if null_safe else 0)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


@pytest.fixture
def compressed(spark, tmp_path):
    """Tables whose files say next to nothing about their rows; a customer without key, one twice, orders of neither."""
    people = spark.range(3000).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "1.0D AS c_acctbal", "'MACHINERY' AS c_mktsegment")
    odd = people.limit(1).unionByName(people.limit(1).withColumn("c_custkey", F.lit(None).cast("long")))
    people.unionByName(odd).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(40).selectExpr(
        "id AS o_orderkey", "CASE WHEN id = 1 THEN NULL WHEN id = 2 THEN 9999 ELSE id % 4 END AS o_custkey", "'F' AS o_orderstatus",
        "id + 0.5D AS o_totalprice", "timestamp'2001-06-05' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(
    "build, rows, nations",
    [
        (lambda spark, sf: file_queries._by_nation(spark, sf, "debit", "cerrado"), 48, 0),  # customer 0 is there twice
        (lambda spark, sf: v.concepts(spark, sf), 48, 1),
        (lambda spark, sf: v.documents(spark, sf), 5 + 3002, 0),
        (lambda spark, sf: manifest_queries._files(spark, sf), 4, 0),
    ],
)
def test_customers_do_not_go_through_the_driver(spark, compressed, build, rows, nations):
    built = build(spark, compressed)
    plan = plan_of(built)
    # nations may: they do not grow
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == nations
    assert built.count() == rows


def test_an_upsert_of_documents_makes_them_once(spark, compressed, monkeypatch):
    made, documents = [], v.documents
    monkeypatch.setattr(v, "documents", lambda *a: made.append(1) or documents(*a))
    upserted = manifest_queries.doc_upsert(spark, compressed)
    found = upserted.groupBy(F.col("cutoff_period") == "open", "pdf_length").count().collect()
    # open ones as stored; cutoffs of 3002 customers in 7 months, of which the 2 of customer 0 meet 2 documents each
    assert {tuple(r) for r in found} == {(True, -1, 3002), (False, 23, 7), (False, -1, 7 * 3002 + 2 - 7)}
    assert len(made) == 1


def test_accounts_and_names_do_not_go_through_the_driver(spark, tmp_path):
    """Names and accounts repeat and are missing; their files say next to nothing about their rows."""
    names = spark.createDataFrame([("x 00012.csv", 1), ("x 00012.csv", 2), ("00012 y 00007.csv", 3), ("none.csv", 4), (None, 5)], "file_name string, n int")
    known = spark.createDataFrame([("00012",), ("00012",), ("00007",), ("",), (None,)], "account_number string")
    for table, df in (("names", names), ("known", known)):
        df.write.parquet(f"{tmp_path}/{table}")
    tagged = fs.tag_accounts(*(spark.read.parquet(f"{tmp_path}/{t}") for t in ("names", "known")))
    assert sorted((r["n"], r["cuenta"]) for r in tagged.collect()) == [(1, "00012"), (2, "00012"), (3, "00007")]
    assert "Broadcast" not in plan_of(tagged) and "SortMergeJoin" in plan_of(tagged)


def test_headers_do_not_go_through_the_driver(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "z\n"), ("c.csv", "")):
        (tmp_path / name).write_text(text)
    found = fs.with_headers(fs.list_files(spark, str(tmp_path)))
    assert {(r["file_name"], *r["header"]) for r in found.collect()} == {("a.csv", "x", "y"), ("b.csv", "z")}
    assert "Broadcast" not in plan_of(found) and "SortMergeJoin" in plan_of(found)


def test_kept_payloads_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    """Hashes are as many as documents: neither what is to be written nor what is known is broadcast."""
    folder, plans, staged = tmp_path / "in", [], documents.staged
    folder.mkdir()
    for name, text in (("a.pdf", "one"), ("b.pdf", "one"), ("c.pdf", "two")):
        (folder / name).write_text(text)
    monkeypatch.setattr(documents, "staged", lambda df, label: plans.append(plan_of(df)) or staged(df, label))
    for _ in range(2):
        kept = documents.keep_payloads(spark, fs.list_files(spark, str(folder), "*.pdf"), f"{tmp_path}/store")
        assert len({r["content_hash"] for r in kept.collect()}) == 2 and kept.count() == 3
        plans.append(plan_of(kept))
    assert documents.held_hashes(spark, f"{tmp_path}/store").count() == 2
    assert not [p for p in plans if "Broadcast" in p] and sum("SortMergeJoin" in p for p in plans) == 4


def broadcast_parts(plan: str) -> list[str]:
    """What lies below each broadcast of a plan: deeper lines, up to the next one that is not."""
    lines, parts = plan.split("\n"), []
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = next((i for i in range(at + 1, len(lines)) if len(re.match(r"[\s:|+-]*", lines[i])[0]) <= depth), len(lines))
            parts.append("\n".join(lines[at:below]))
    return parts


@pytest.fixture
def ledger_tables(spark, tmp_path):
    """Customers in files that say next to nothing about their rows; closed and open orders of some of them."""
    spark.range(3000).selectExpr(
        "id AS c_custkey", "'n' AS c_name", "CAST(id % 3 AS int) AS c_nationkey", "1.0D AS c_acctbal",
        "IF(id % 2 = 0, 'MACHINERY', 'BUILDING') AS c_mktsegment",
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "IF(id % 5 = 0, 'O', IF(id % 5 = 1, 'P', 'F')) AS o_orderstatus", "id + 1000.5D AS o_totalprice",
        "IF(id % 3 = 0, timestamp'2001-07-05', timestamp'2001-06-05') AS o_orderdate", "IF(id % 4 = 0, '5-LOW', '1-URGENT') AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT CAST(id AS int) AS n_nationkey, concat('N', id) AS n_name, 0 AS n_regionkey FROM range(3)").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["missing_open", "mtd_by_concept", "open_period", "download_plan", "export_sets", "today_files", "load_rejects", "today_statements", "statement_scan", "payload_store"])
def test_a_whole_query_keeps_customers_off_the_driver(spark, ledger_tables, monkeypatch, name):
    """In what it returns and in what it writes on the way; the rows are those of its SQL."""
    plans = []
    for kind in ("csv", "text", "parquet"):
        write = getattr(DataFrameWriter, kind)
        monkeypatch.setattr(DataFrameWriter, kind, lambda self, *a, _write=write, **b: plans.append(plan_of(self._df)) or _write(self, *a, **b))
    registry.load_all()
    found = registry.QUERIES[name](spark, ledger_tables)
    plans.append(plan_of(found))
    assert any("c_custkey" in p for p in plans)
    assert not [p for plan in plans for p in broadcast_parts(plan) if "c_custkey" in p]
    columns, con = sorted(found.columns), duckdb.connect()
    for table in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ledger_tables}/{table}.parquet/*.parquet'")
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert wanted and Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(wanted)
