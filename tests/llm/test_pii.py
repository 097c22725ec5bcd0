from __future__ import annotations

import random
import re

import numpy as np
import pytest

from ledgerwise.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        if 12 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0:
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_patterns_against_plain_expressions(real):
    rng = random.Random(3)
    texts = list(real[1].values())
    texts += ["".join(rng.choice("0123456789..+- ()@@aZ-_%\n") for _ in range(80)) for _ in range(3000)]
    texts += ["".join(rng.choice("12.@a") for _ in range(40)) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 10**6, "1" * 10**6, "+1" + "(" * 10**6, "a@" * 10**5, "1." * 10**5, "1 " * 10**5):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model(real):
    return pii.fit(real[0])


def test_messages_equal_enumeration(model):
    """On a graph without cycles, message passing gives the exact marginals."""
    graph = pii.Graph(["call +1 (826) 555-4081 or 555-4081 now"], [[]])
    graph.edges = [(i, i + 1, kind) for i, kind in zip(range(len(graph.doc) - 1), (0, 1, 2))]
    values = np.array(graph.values) + np.concatenate(([0], np.cumsum(pii.SIZES)))[:-1]
    unary = model["unary"][values].sum(1) + model["unary"][-1]
    odds = np.zeros((len(values), pii.LABELS))
    for labels in np.ndindex(*(pii.LABELS,) * len(values)):
        weight = sum(unary[i, a] for i, a in enumerate(labels))
        weight = np.exp(weight + sum(model["edge"][k][labels[i], labels[j]] for i, j, k in graph.edges))
        for i, a in enumerate(labels):
            odds[i, a] += weight
    odds /= odds.sum(1, keepdims=True)
    assert np.allclose(pii.marginals(graph, model, rounds=60), odds, atol=1e-4)


def test_like_tokens_take_over_labels():
    """A phone number that the pattern spoils is found because the same one stands elsewhere."""
    known = {"unary": np.zeros((sum(pii.SIZES) + 1, pii.LABELS)), "edge": np.zeros((3, pii.LABELS, pii.LABELS))}
    known["edge"][pii.SAME] = 4 * np.eye(pii.LABELS)
    text = "tel +49-170-1234567 here, and far away again 49-170-1234567/x but never 77-881-99"
    base, added = pii.spans_of([text, "x 49-170-1234567"], known, least=0.8)
    assert [text[a:b] for _, a, b in base[0]] == ["+49-170-1234567"]
    assert added[1] == []
    known["unary"][-1, 0] = 1.0
    text = "mail ann.lee@example.com and later ann.lee@example.com, ann_lee@example"
    base, added = pii.spans_of([text], known)
    assert len(base[0]) == 2 and added == [[]]


@pytest.mark.parametrize("before", [0, 150, 300])
def test_labels_reach_every_repeat(before):
    """A number that the patterns find once and miss three hundred times, at the rounds and the bound of production."""
    known = {"unary": np.zeros((sum(pii.SIZES) + 1, pii.LABELS)), "edge": np.zeros((3, pii.LABELS, pii.LABELS))}
    known["edge"][pii.SAME] = 4 * np.eye(pii.LABELS)
    known["unary"][-1, 0] = 1.0
    repeats = ["and 14155550101 again"] * 300
    text = " ".join([*repeats[:before], "call +14155550101 or 77-881-9942", *repeats[before:]])
    base, added = pii.spans_of([text, "far 14155550101 away"], known)
    assert len(base[0]) == 1 and len(added[0]) == 300 and added[1] == []
    assert {text[a:b] for _, a, b in added[0]} == {"14155550101"} and {k for k, _, _ in added[0]} == {3}
    graph = pii.Graph([text], [pii.base_spans(text)])
    assert len(graph.edges) + len(graph.anchors) <= 6 * len(graph.doc)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(docs), [r["text"] for r in docs.select("text").collect()]


def test_fitted_potentials_find_masked_repeats(learned):
    """Numbers that the patterns find once, repeated in a form that they miss; and numbers that look like them."""
    model, texts = learned
    rng, found, repeats, strangers = random.Random(8), 0, 0, 0
    clean = [x for x in texts if x and not pii.base_spans(x)][:200]
    cases = []
    for i in range(200):
        digits = "1" + "".join(rng.choice("0123456789") for _ in range(10))
        other = "2" + "".join(rng.choice("0123456789") for _ in range(10))
        filler = clean[i % len(clean)][:400]
        cases.append((f"call +{digits} {filler} and {digits} again {filler} or {digits} but not {other}", digits, other))
    _, added = pii.spans_of([c[0] for c in cases], model)
    for (text, digits, other), spans in zip(cases, added):
        parts = [text[a:b] for k, a, b in spans]
        repeats += 2
        found += parts.count(digits)
        strangers += parts.count(other)
    assert found >= 0.9 * repeats and strangers == 0


def test_fitted_potentials_leave_clean_texts_alone(learned):
    """Nothing is added where the patterns find nothing, and little elsewhere."""
    model, texts = learned
    base, added = pii.spans_of(texts, model)
    assert sum(len(a) for b, a in zip(base, added) if not b) == 0
    assert sum(map(len, added)) <= 0.05 * sum(map(len, base))
    bare = " and ".join(["14155550101 again"] * 50)
    assert pii.spans_of([bare], model)[1] == [[]]


def test_odd_rows(odd, none, model):
    rows = pii.find(odd, model).collect()
    assert len(rows) == 10
    for r in rows:
        want = plain_spans(r["text"] or "")
        assert r["base_spans"] == pii.listed(want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))
    assert pii.find(none, model).collect() == []
    assert pii.fit(none)["unary"][-1, 0] > 0


def test_redaction(odd, none):
    out = pii.redact(odd)
    assert out.columns == odd.columns
    of = {r["doc_id"]: r["text"] for r in out.collect()}
    assert of[4] == "Mail <EMAIL> or <EMAIL> at <IP>, please. Thanks for all of it." == of[5]
    assert of[0] is None and of[1] == "" and of[6] == "x" * 200_000
    assert pii.redact(none).collect() == []
    assert pii.redacted("a 1.2.3.4.5 b", [(1, 2, 9), (3, 6, 11)]) == "a <IP> b"
