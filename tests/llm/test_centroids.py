from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerwise.llm import centroids as ce
from ledgerwise.llm.queries import QUERIES

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def nearest(points, x):
    return min((sum((a - b) ** 2 for a, b in zip(p, x)), k) for k, p in enumerate(points))[::-1]


@given(
    st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=9),
    st.lists(st.lists(st.integers(-4, 4), min_size=4, max_size=4), min_size=1, max_size=30),
)
@settings(max_examples=200, deadline=None)
def test_search_is_exact_and_ties_go_to_the_smaller_number(points, vectors):
    which, distance = ce.Centroids(points).nearest(np.array(vectors, np.int64))
    assert [(int(a), int(b)) for a, b in zip(which, distance)] == [nearest(points, x) for x in vectors]


def test_search_is_exact_for_large_numbers():
    rng = np.random.default_rng(3)
    points = rng.integers(-ce.LARGEST, ce.LARGEST + 1, (20, 64))
    vectors = np.vstack([points, points + rng.integers(-2, 3, points.shape), rng.integers(-ce.LARGEST, ce.LARGEST, (50, 64))])
    which, distance = ce.Centroids(points.tolist()).nearest(vectors)
    for x, k, d in zip(vectors.tolist(), which, distance):
        assert (int(k), int(d)) == nearest(points.tolist(), x)


def test_inequalities_leave_most_centroids_unmeasured():
    rng = np.random.default_rng(4)
    points = (rng.normal(0, 20, (200, 1)) + rng.normal(0, 1, (200, 16)) * rng.uniform(1, 30, (200, 1))).astype(np.int64)
    search = ce.Centroids(points.tolist())
    vectors = points[rng.integers(0, 200, 2000)] + rng.integers(-2, 3, (2000, 16))
    which, _ = search.nearest(vectors)
    assert [int(k) for k in which[:50]] == [nearest(points.tolist(), x)[0] for x in vectors[:50].tolist()]
    assert search.measured < 0.2 * 200 * 2000


def brute(rows, size, count, rounds, scale=256, salt="2"):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    points = [p for _, p in sorted(kept, key=key)[:count]]
    for _ in range(rounds):
        of = [[] for _ in points]
        for _, p in kept:
            of[nearest(points, p)[0]].append(p)
        points = [[sum(c) // len(x) for c in zip(*x)] if x else p for x, p in zip(of, points)]
    found = [(v, *nearest(points, p)) for v, p in kept]
    spread = [sum(d for _, k, d in found if k == j) for j in range(len(points))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((v, k, d, spread[k], sum(spread), digest[k]) for v, k, d in found), key=repr)


def test_the_query_agrees_with_plain_rounds(spark, sf):
    made = QUERIES["op12_equal_variance_clustering"](spark, sf)
    assert made.columns == COLUMNS
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, made.collect()), key=repr) == brute(rows, 64, 40, 5)


def test_odd_vectors_ties_repeats_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, 0.001]), (None, [7.0, 7.0]), (None, [0.25, 0.5]),
        (4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [-inf, 0.0]),
    ]
    df = spark.createDataFrame([(*r, *"????") for r in rows], "vec_id long, embedding array<float>, cluster string, distance string, point string, inertia string")
    for count in (1, 3, 40):
        made = ce.clustered(df.repartition(3), size=2, count=count, rounds=3)
        assert sorted(map(tuple, made.collect()), key=repr) == brute(rows, 2, count, 3)


def test_no_vector_and_too_large_ones(spark):
    schema = "vec_id string, embedding array<double>"
    made = ce.clustered(spark.createDataFrame([], schema), size=2)
    assert made.columns == COLUMNS and made.count() == 0
    with pytest.raises(Exception, match="would not fit a long"):
        ce.clustered(spark.createDataFrame([("a", [1e30, 1.0])], schema), size=2).collect()


def test_result_does_not_depend_on_the_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = (sorted(map(tuple, ce.clustered(df.repartition(n), count=7, rounds=2).collect())) for n in (1, 9))
    assert one == many
