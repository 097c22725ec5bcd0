from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerwise import shared
from ledgerwise.llm import components, simhash
from ledgerwise.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents_against_brute_force(real):
    docs, texts = real
    prints = {i: plain_fingerprint(x) for i, x in texts.items()}
    groups = plain_components(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
        assert r["component_id"] == groups[r["doc_id"]]


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    values = set(rng.integers(-(1 << 63), 1 << 63, 60).tolist())
    for v in list(values):
        for flips in (1, 2, 4, 5):
            mask = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            values.add(simhash._signed((v % (1 << 64)) ^ mask))
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for distance, groups in ((4, None), (4, 9), (2, 6)):
        got = sorted((r["a"], r["b"]) for r in simhash.links(df, distance, groups).collect())
        want = sorted((a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= distance)
        assert got == want


def test_embedding_is_a_lower_bound(spark):
    rows = spark.range(0, 2000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    codes = rows.select("a", "b", simhash.embedding(F.col("a")).alias("x"), simhash.embedding(F.col("b")).alias("y"))
    for a, b, x, y in codes.collect():
        counts = [[(v >> (2 * s) & 3).bit_count() for s in range(32)] for v in (a % (1 << 64), b % (1 << 64))]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert ((x ^ y) % (1 << 64)).bit_count() == manhattan <= ((a ^ b) % (1 << 64)).bit_count()


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    of = {r["doc_id"]: r for r in rows}
    assert of[0]["fingerprint"] == of[1]["fingerprint"] == of[2]["fingerprint"] == 0
    assert of[0]["component_id"] == of[1]["component_id"] == of[2]["component_id"] == 0
    assert of[4]["component_id"] == of[5]["component_id"] == 4
    assert of[3]["component_id"] == 3 and of[None]["component_id"] is None
    assert simhash.near_duplicates(none).collect() == []


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_groups_follow_the_number_of_fingerprints():
    """Few layouts for small tables, finer cells for large ones; the pairs met stay within reach of the rows sent."""
    assert simhash.groups_for(0, 4) == simhash.groups_for(300_000, 4) == 7
    chosen = [simhash.groups_for(10**k, 4) for k in range(5, 12)]
    assert chosen == sorted(chosen) and chosen[-1] > 8
    for k in range(5, 12):
        groups = simhash.groups_for(10**k, 4)
        assert 10**k / 2 ** (48 * (groups - 4) / groups) < 2000


def test_nothing_that_grows_with_the_documents_is_broadcast(spark, monkeypatch):
    """Exploded fingerprints are many times what Catalyst takes them for, and files say little of the rows they hold."""
    plans = []

    def staged(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.staged(df, label)

    monkeypatch.setattr(simhash, "staged", staged)
    monkeypatch.setattr(components, "staged", staged)
    base = 0x0123456789ABCDEF
    prints = {1: base, 2: base ^ 1, 3: base ^ 3, 4: base, 5: ~base, 6: 77, None: 77}
    docs = spark.createDataFrame([(i, str(p)) for i, p in prints.items()], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_, **__: df.select("doc_id", F.col("text").cast("long").alias("fingerprint")))
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (None, 6)}
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
