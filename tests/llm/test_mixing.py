from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import mixing
from ledgerwise.llm.queries import QUERIES
from ledgerwise.llm.running import running_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def brute(rows, share=1.5, repeats=2, weights=(5, 2, 1)):
    """``rows`` of (doc_id, source, text), one queue in one list."""
    made = []
    for doc_id, source, text in rows:
        name = f"{'' if doc_id is None else doc_id}:{text or ''}"
        made.append((doc_id, source, len(WORD.findall(text or "")), int(hashlib.md5(name.encode()).hexdigest()[:15], 16)))
    sizes = defaultdict(int)
    for _, source, size, _ in made:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget = int(sum(sizes.values()) * Fraction(share))
    full, rate = set(), 0.0
    while True:
        left = [s for s in order if s not in full]
        if not left:
            break
        rate = (budget - sum(repeats * sizes[s] for s in full)) / sum(weight[s] for s in left)
        more = {s for s in left if weight[s] * rate > repeats * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: float(repeats * sizes[s]) if s in full else weight[s] * rate for s in order}
    queue = []
    for rank, source in enumerate(order):
        sent, own = 0, sorted((h, size, i) for i, (_, s, size, h) in enumerate(made) if s == source)
        for epoch in range(repeats):
            for h, size, i in own:
                sent += size
                queue.append((sent / target[source] if target[source] else 0.0, rank, epoch, h, size, i))
    taken, total = Counter(), 0
    for *_, size, i in sorted(queue):
        total += size
        if total > budget:
            break
        taken[i] += size
    return sorted(((d, size, sizes[s], target[s], taken[i]) for i, (d, s, size, _) in enumerate(made)), key=repr)


def test_the_query_agrees_with_one_queue(spark, sf):
    made = QUERIES["op13_fair_queue_mixing"](spark, sf)
    assert made.columns == COLUMNS
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert sorted(map(tuple, made.collect()), key=repr) == brute(docs)


def test_sources_end_within_a_document_of_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = mixing.mix(docs).groupBy("source_size", "target")
    rows = made.agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    for r in rows:
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["target"] <= 2 * r["source_size"]
    total = sum(r["source_size"] for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(1.5 * total)
    assert 0 <= 1.5 * total - sum(r["taken"] for r in rows) <= max(r["largest"] for r in rows)


def test_odd_rows_null_sources_repeats_and_clashing_names(spark, odd):
    docs = odd.withColumnRenamed("lang", "source").withColumn("target", odd.text).withColumn("rank", odd.text)
    want = brute([tuple(r) for r in docs.select("doc_id", "source", "text").collect()])
    for n in (1, 5):
        assert sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=repr) == want


def test_one_row_repeated_a_hot_source_and_empty_sources(spark):
    rows = [("k", "hot", "two words")] * 400 + [(f"d{i}", None if i % 3 else "", "a b c " * i) for i in range(30)] + [("e", "void", None), ("f", "void", " \n")]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == brute(rows)
    again = mixing.mix(docs, share=0.5, repeats=3, weights=(1, 4))
    assert sorted(map(tuple, again.collect()), key=repr) == brute(rows, 0.5, 3, (1, 4))


def test_without_rows_and_without_words(spark, none):
    empty = none.withColumnRenamed("lang", "source")
    assert mixing.mix(empty).columns == COLUMNS and mixing.mix(empty).count() == 0
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")
    assert sorted(map(tuple, mixing.mix(docs).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_running_sums_cross_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("place"), (F.col("id") % 5).alias("n"))
    made = {r["place"]: r["n_so_far"] for r in running_sums(df, ["place"], ["n"], "sums").collect()}
    rows, so_far = sorted(map(tuple, df.collect())), 0
    for place, n in rows:
        so_far += n
        assert made[place] == so_far
