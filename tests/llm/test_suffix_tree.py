from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import suffix_tree
from ledgerwise.llm.common import fold


def test_scores_equal_the_definition():
    """Grams, states and scores against longest retained suffixes looked up byte by byte."""
    rng, depth = random.Random(2), 3
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [b"", b"abcabcabc" * 700, "ñé".encode()]
    keys, counts = suffix_tree.grams(texts, depth)
    plain: Counter = Counter()
    for text in texts:
        padded = b"\xff" * depth + text + b"\xff"
        for i in range(len(text) + 1):
            plain[int.from_bytes(padded[i : i + depth + 1], "big")] += 1
    assert dict(zip(keys.tolist(), counts.tolist())) == plain
    table: dict = {}
    for gram, n in plain.items():
        for level in range(depth + 1):
            table.setdefault((level, (gram >> 8) & ((1 << 8 * level) - 1)), Counter())[gram & 255] += n
    kept = {c for c, v in table.items() if c[0] == 0 or (v.total() >= 10 and rng.random() < 0.5)}
    rows = [(*c, s, n) for c in kept for s, n in table[c].items()]
    model = suffix_tree.automaton(dict(zip(("level", "context", "symbol", "n"), map(list, zip(*rows)))), depth)

    def odds(level, context):
        above = np.full(256, 1 / 256) if not level else odds(level - 1, context & ((1 << 8 * (level - 1)) - 1))
        if (level, context) not in kept:
            return above
        own = np.zeros(256)
        for symbol, n in table[level, context].items():
            own[symbol] = n
        return (own + 8 * above) / (own.sum() + 8)

    got = suffix_tree.log10_probabilities(texts, model)
    for text, score in zip(texts, got):
        padded, want = b"\xff" * depth + text + b"\xff", 0.0
        for i in range(len(text) + 1):
            want += math.log10(odds(depth, int.from_bytes(padded[i : i + depth], "big"))[padded[i + depth]])
        assert score == pytest.approx(want, abs=1e-3)
    sums = (10.0 ** model["log"] * model["alike"]).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_divergence_tests(spark):
    """A context stays if it is frequent and tells something; grams of one byte of context."""
    grams = [(ord("a"), ord("x"), 500), (ord("b"), ord("x"), 250), (ord("b"), ord("y"), 250), (ord("c"), ord("y"), 3)]
    df = spark.createDataFrame([((a << 8) | s, n) for a, s, n in grams], "gram long, n long")
    rows = suffix_tree.contexts(df, 1, 0.01, 10.0).collect()
    assert {(r["level"], r["context"]) for r in rows} == {(0, 0), (1, ord("a")), (1, ord("b"))}
    assert {(r["level"], r["context"]) for r in suffix_tree.contexts(df, 1, 0.01, 1e9).collect()} == {(0, 0)}


def plain_base(texts, learn):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower()) + ["end"] for i, x in enumerate(texts)}
    counts = Counter(w for i in words if learn[i] for w in words[i])
    room = counts.total() + len(counts) + 1
    for i in words:
        base = sum(math.log10((counts[w] + 1) / room) for w in words[i])
        yield len(words[i]), sum(counts[w] > 0 for w in words[i]), counts.total(), base


def test_base_scores_and_odd_rows(real, odd, none):
    docs = real[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = suffix_tree.scored(docs, fold(F.col("doc_id"), 7) != 2, block_bytes=60_000).collect()
    source = docs.select("doc_id", "text", (fold(F.col("doc_id"), 7) != 2).alias("learn")).collect()
    want = plain_base([r["text"] for r in source], [r["learn"] for r in source])
    want = sorted((str(r["doc_id"]), *w[:3], round(w[3], 4)) for r, w in zip(source, want))
    got = sorted(
        (str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows
    )
    assert got == want
    assert all(r["score"] < 0 for r in rows)
    assert suffix_tree.scored(none, F.lit(True)).collect() == []
    untaught = suffix_tree.scored(odd, F.lit(False)).collect()
    assert len(untaught) == 10 and {r["train_tokens"] for r in untaught} == {0}
    one = next(r for r in untaught if r["doc_id"] == 1)
    assert one["score"] == pytest.approx(-math.log10(256)) and (one["n_tokens"], one["n_known"]) == (1, 0)
