from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerwise.llm import filter_audit as fa
from ledgerwise.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
ids = st.lists(st.integers(0, 60), max_size=40).map(lambda x: sorted(set(x)))


@given(st.lists(ids, min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_merges_are_those_of_sets(lists):
    assert fa.union(lists) == sorted(set().union(*lists))
    assert fa.difference(lists[0], lists[-1]) == sorted(set(lists[0]) - set(lists[-1]))
    for (k, before), (gone, removed, redundant) in fa.sizes(lists).items():
        earlier = set().union(*(x for j, x in enumerate(lists) if before >> j & 1))
        assert gone == len(earlier | set(lists[k]))
        assert removed == len(set(lists[k]) - earlier) and removed + redundant == len(lists[k])


def test_seek_gallops_from_any_place():
    numbers = sorted(random.Random(1).sample(range(10_000), 900))
    for at in (0, 5, 899):
        for key in (0, numbers[5], numbers[5] + 1, 9_999, 20_000):
            want = next((i for i in range(at, 900) if numbers[i] >= key), 900)
            assert fa.seek(numbers, key, at) == want


def brute(rows, labels):
    """Every order applied to every row, one after the other."""
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for doc_id, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words)}
        own["C"] = 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)
        own["D"] = bool(re.search("[#$%&*|]", text))
        own["E"] = doc_id is not None and doc_id > smallest[text]
        fails.append((part or "", frozenset(k for k, v in own.items() if v), doc_id in good, doc_id in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        here, shapley = [f for f in fails if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order, 1):
                away = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                failing = [f for f in here if letter in f[1]]
                alone = sum(f[1] == {letter} for f in here)
                shapley[letter] += len(away)
                out[part, "".join(order), step] = [
                    len(left), len(away), len(failing) - len(away), alone, sum(f[2] for f in away), sum(f[3] for f in away),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_the_query_agrees_with_every_order_applied(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    made = QUERIES["op11_posting_list_audit"](spark, sf)
    assert made.columns == COLUMNS
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, labels)


def odd_labels(spark):
    rows = [(4, 1, 0), (4, 0, 1), (5, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_repeats_and_clashing_names(spark, odd):
    docs = odd.withColumnRenamed("lang", "source")
    for c in ("rows", "bits", "digest", "range", "before", "letter"):
        docs = docs.withColumn(c, docs.source)
    labels = odd_labels(spark)
    rows = {tuple(r) for r in fa.audit(docs, labels).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.collect()])
    assert rows == want


def test_one_row_repeated_many_times_and_text_ids(spark):
    rows = [("k7", "the same text", "s")] * 500 + [("k8", "the same text", None), (None, "the same text", "s"), ("k1", None, "s"), ("k2", "", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(4)
    labels = spark.createDataFrame([("k7", 1, 1)], "doc_id string, quality int, toxic int")
    made = {tuple(r) for r in fa.audit(docs, labels).collect()}
    assert made == brute(rows, [("k7", 1, 1)])


def test_without_rows(spark, none):
    assert fa.audit(none.withColumnRenamed("lang", "source"), odd_labels(spark)).count() == 0


def test_lists_are_sorted_and_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = fa.facts(docs)
    lists = fa.posting_lists(made.select("row", "part", "bits"), {"A": 0, "C": 2}).collect()
    assert sum(len(r["A"]) for r in lists) == made.where("bits & 1 = 1").count() > 0
    for r in lists:
        assert r["A"] == sorted(r["A"]) and all(x >> fa.RANGE_BITS == r["range"] for x in r["A"] + r["C"])
