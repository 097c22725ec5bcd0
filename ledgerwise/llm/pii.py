"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that carries labels to like tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, per_batch, sliced

#: Kinds in the order in which spans with one start are listed (fixed values).
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGIT_SIGNS = frozenset("0123456789")
_EDGES = re.compile(r"[^\W_]|\+(?=[0-9(])")

#: Words before a token that hint at its kind (fixed values).
CUES = {
    "email": 1, "e-mail": 1, "mail": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "card": 3, "visa": 3,
    "credit": 3, "payment": 3, "phone": 4, "tel": 4, "call": 4, "mobile": 4, "fax": 4,
}
#: Number of values of each discrete property of a token.
SIZES = (3, 7, 5, 2, 3, 2, 2, 2, 5, 2)
_DIGIT_STEPS = (1, 4, 6, 9, 12, 20)
SAME, SIMILAR = 1, 2
#: What an observed label adds to its token's log odds; what it can add to, or take from, those of a like token.
SURE, ANCHOR = 20.0, 12.0
#: Pairs of each two labels that count as seen among masked repeats.
MASKED_PRIOR = 0.02


def luhn(digits: str) -> bool:
    """Does the check digit hold?"""
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str | None) -> list[Span]:
    """``(kind, start, end)`` of the fixed patterns, leftmost and non-overlapping within a kind, by start and kind.

    Linear in the length of the text, whatever is in it.
    """
    if not text:
        return []
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0]))


class Graph:
    """Tokens that may be personal data in a list of texts: properties, labels by the patterns, and edges.

    A token is what stands between blanks and holds a digit or ``@``, without punctuation around it; all other words are
    taken as observed outside, which splits the chain there.  Edges: next to each other (kind 0), the same letters and
    digits (``SAME``) or the same beginning (``SIMILAR``) as the last such token before, however far away.  ``anchors`` are
    edges of the same kinds from a token without label to the nearest observed ones on either side, whatever is between, so
    that evidence needs one hop; training counts ``edges`` alone.
    """

    def __init__(self, texts: list, spans: list[list[Span]]):
        self.doc, self.start, self.end, self.label = [], [], [], []
        self.values: list[tuple] = []
        self.edges: list[tuple[int, int, int]] = []
        self.anchors: list[tuple[int, int, int]] = []
        for row, text in enumerate(texts):
            if text and ("@" in text or _DIGITS.search(text)):
                self._add(row, text, spans[row])

    def _add(self, row: int, text: str, spans: list[Span]) -> None:
        last: dict = {}
        known: dict = {}
        waiting: dict = {}
        before, at = -9, 0
        for found in _TOKEN.finditer(text):
            inner = [m.start() for m in _EDGES.finditer(found[0])]
            if not inner:
                continue
            start, end = found.start() + inner[0], found.start() + inner[-1] + 1
            node = len(self.doc)
            while at < len(spans) and spans[at][2] <= start:
                at += 1
            label = 0
            for k, a, b in spans[max(0, at - len(KINDS)) :]:
                if a >= end:
                    break
                if b > start:
                    label = 1 + k
                    break
            beside = found.start() - before <= 1
            token = text[start:end]
            digits = sum(map(_DIGIT_SIGNS.__contains__, token))
            self.values.append(self._properties(token, digits, beside, text, found.start(), found.end()))
            self.doc.append(row)
            self.start.append(start)
            self.end.append(end)
            self.label.append(label)
            if beside:
                self.edges.append((node - 1, node, 0))
            for key, kind in _keys(token, digits):
                like = kind, key
                if like in last:
                    self.edges.append((last[like], node, kind))
                if label:
                    self.anchors += [(other, node, kind) for other in waiting.pop(like, ()) if other != last[like]]
                    known[like] = node
                else:
                    if like in known and known[like] != last[like]:
                        self.anchors.append((known[like], node, kind))
                    waiting.setdefault(like, []).append(node)
                last[like] = node
            before = found.end()

    def _properties(self, token: str, digits: int, beside: bool, text: str, start: int, end: int) -> tuple:
        letters = sum(map(str.isalpha, token))
        ahead = text[end : end + 2]
        words = text[max(0, start - 24) : start].split()
        return (
            min(token.count("@"), 1) + ("." in token.rpartition("@")[2] if "@" in token else 0),
            sum(digits >= s for s in _DIGIT_STEPS),
            min(token.count("."), 4),
            int(token[0] == "+" or text[max(0, start - 1) : start] == "+"),
            0 if not letters else 1 if letters < digits else 2,
            int("-" in token),
            int(beside),
            int(len(ahead) == 2 and ahead[0].isspace() and (ahead[1].isdigit() or ahead[1] in "+(")),
            CUES.get(words[-1].strip(":#=.,").lower(), 0) if words else 0,
            int(12 <= digits <= 19 and luhn("".join(c for c in token if c in _DIGIT_SIGNS))),
        )


def _keys(token: str, digits: int) -> Iterator[tuple[str, int]]:
    plain = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    if len(plain) >= 6:
        yield plain, SAME
    if "@" in token:
        local = token.lower().partition("@")[0]
        if len(local) >= 3:
            yield local, SIMILAR
    elif digits >= 9:
        yield "".join(c for c in token if c in _DIGIT_SIGNS)[: digits - 3], SIMILAR


def _codes(values: list[tuple]) -> np.ndarray:
    return np.ravel_multi_index(np.array(values, np.int64).reshape(-1, len(SIZES)).T, SIZES)


def unobserved(graph: Graph) -> set[int]:
    """Tokens that the patterns miss although they have the letters and digits of one that they find: what they are is not
    known, so they teach nothing."""
    pairs = [(i, j) for i, j, kind in graph.edges + graph.anchors if kind == SAME]
    label = graph.label
    return {i if label[j] else j for i, j in pairs if (label[i] > 0) != (label[j] > 0)}


def fit(docs: DataFrame, rounds: int = 300, penalty: float = 1e-3) -> dict:
    """The field's potentials, by piecewise training on what the patterns find in all of ``docs(text)``.

    Tasks count (properties, label), and label pairs along each kind of edge; the sums are as many as property values and
    labels there are, not as documents.  Unary: multinomial logistic regression on the counts.  Edges: how much more often
    two labels meet than they would by chance, as a logarithm.

    The patterns' silence is no label: tokens that are the same as a found one but were missed are ``unobserved`` and left
    out of all counts.  What an observed label says about a like token (``anchor``) is learned from masked repeats: every token
    is taken as repeated once with its label hidden, and pairs of like tokens of which both are found are counted with either
    one hidden.  The logarithm there is against how rare the label is among all tokens, as a like token is no chance meeting.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("what", "a", "b", "n")])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            graph = Graph(texts, [base_spans(x) for x in texts])
            if not graph.doc:
                continue
            label, away = graph.label, unobserved(graph)
            for node, (code, of_code) in enumerate(zip(_codes(graph.values).tolist(), label)):
                if node not in away:
                    counts[-1, code, of_code] = counts.get((-1, code, of_code), 0) + 1
            for i, j, kind in graph.edges:
                if i not in away and j not in away:
                    key = kind, label[i], label[j]
                    counts[key] = counts.get(key, 0) + 1
        rows = [(*key, n) for key, n in counts.items()]
        columns = list(zip(*rows)) or [[]] * len(target)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=target)

    totals = in_batches(docs.select("text"), run, schema).groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    seen: dict[int, np.ndarray] = {}
    pairs = np.ones((3, LABELS, LABELS))
    for what, a, b, n in sorted(map(tuple, totals)):
        if what < 0:
            seen.setdefault(a, np.zeros(LABELS))[b] = n
        else:
            pairs[what, a, b] += n
            pairs[what, b, a] += n
    share = pairs / pairs.sum((1, 2), keepdims=True)
    edge = np.log(share / (share.sum(2, keepdims=True) * share.sum(1, keepdims=True)))
    rare = sum(seen.values(), np.ones(LABELS))
    masked = pairs - 1 + MASKED_PRIOR
    masked[SAME] += np.diag(rare - 1)
    masked[SIMILAR] += np.diag(rare - 1) * np.diag(masked[SIMILAR]) / masked[SIMILAR].sum(1)  # as often as similar ones agree
    masked /= masked.sum(2, keepdims=True)  # the label of one, given that of the other
    anchor = np.log(masked / (rare / rare.sum()))
    return {"unary": _unary(seen, rounds, penalty), "edge": np.clip(edge, -4, 4), "anchor": np.clip(anchor, -ANCHOR, ANCHOR)}


def _unary(seen: dict[int, np.ndarray], rounds: int, penalty: float) -> np.ndarray:
    """Weights of each property value and label, by gradient steps with momentum; nothing seen: all is outside."""
    offsets = np.concatenate(([0], np.cumsum(SIZES)))
    weights = np.zeros((offsets[-1] + 1, LABELS))
    weights[-1, 0] = 2.0
    if not seen:
        return weights
    values = np.stack(np.unravel_index(np.array(list(seen)), SIZES), 1) + offsets[:-1]
    values = np.hstack([values, np.full((len(values), 1), offsets[-1])])
    x = np.zeros((len(values), len(weights)))
    np.put_along_axis(x, values, 1.0, 1)
    y = np.stack(list(seen.values()))
    y = y / y.sum()
    mass, moved = y.sum(1, keepdims=True), np.zeros_like(weights)
    for _ in range(rounds):
        odds = np.exp(x @ weights - (x @ weights).max(1, keepdims=True))
        slope = x.T @ (mass * odds / odds.sum(1, keepdims=True) - y) + penalty * weights / len(weights)
        moved = 0.9 * moved - 0.5 * slope
        weights += moved
    return weights


def marginals(graph: Graph, model: dict, rounds: int = 200, settled: float = 1e-4) -> np.ndarray:
    """Label probabilities of every token by loopy message passing, all texts' messages at once, half damped.

    What the patterns have found is observed; its messages reach the like tokens that they have missed.  Rounds go on until
    no message moves by ``settled``; ``rounds`` ends messages that go round in circles.
    """
    offsets = np.concatenate(([0], np.cumsum(SIZES)))
    values = np.array(graph.values, np.int64) + offsets[:-1]
    unary = model["unary"][values].sum(1) + model["unary"][-1]
    label = np.array(graph.label)
    unary[label > 0, label[label > 0]] += SURE
    unary -= _log_sum(unary)
    belief = unary
    if graph.edges:
        i, j, kind = np.array(graph.edges + graph.anchors).T
        source, sink = np.concatenate([i, j]), np.concatenate([j, i])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        # between an observed token and a like one that is not: what masked repeats have taught
        taught = (kind > 0) & ((label[i] > 0) != (label[j] > 0)) if "anchor" in model else np.zeros(len(kind), bool)
        both = np.concatenate([model["edge"], model.get("anchor", model["edge"])])
        edge = both[np.concatenate([kind + 3 * taught] * 2)]
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            fresh = _log_sum((belief[source] - message[back])[:, :, None] + edge, 1)[:, 0]
            moved = 0.5 * (fresh - _log_sum(fresh) - message)
            moved[label[sink] > 0] = 0  # whatever the many say, what is observed stays
            message = message + moved
            belief = unary.copy()
            np.add.at(belief, sink, message)
            if np.abs(moved).max() < settled:
                break
    return np.exp(belief - _log_sum(belief))


def _log_sum(x: np.ndarray, axis: int = 1) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis, keepdims=True))


def spans_of(texts: list, model: dict, least: float = 0.95) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of each text.  A token is added if it touches no base span and a label reaches ``least``."""
    base = [base_spans(x) for x in texts]
    added: list[list[Span]] = [[] for _ in texts]
    graph = Graph(texts, base)
    if graph.doc:
        odds = marginals(graph, model)
        best = odds.argmax(1)
        for node in np.flatnonzero((best > 0) & (odds.max(1) >= least) & (np.array(graph.label) == 0)):
            added[graph.doc[node]].append((int(best[node]) - 1, graph.start[node], graph.end[node]))
    return base, added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


SPAN_FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
]


def find(docs: DataFrame, model: dict, keep: list[str] | None = None, least: float = 0.95) -> DataFrame:
    """Spans of every row of ``docs(text)``: number of base spans of each kind, ``base_spans``, all ``spans``, ``n_added``.

    Spans are ``kind:start:end`` in code points, end exclusive, comma-joined.  Null and empty texts have none; repeated rows
    have the same.
    """

    def work():
        def of_texts(texts):
            base, added = spans_of(texts, model, least)
            made = {f"n_{name}": [sum(s[0] == k for s in spans) for spans in base] for k, name in enumerate(KINDS)}
            made["base_spans"] = [listed(x) for x in base]
            made["spans"] = [listed(x + y) for x, y in zip(base, added)]
            made["n_added"] = [len(x) for x in added]
            return made

        return of_texts

    return per_batch(docs, work, SPAN_FIELDS, keep=keep)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``<KIND>`` for each span; of overlapping ones the first gives the name and all of them go."""
    if not spans:
        return text
    parts, at = [], 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2], s[0]))
    for k, a, b in ordered:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, least: float = 0.95) -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text`` replaced, ``n_chars`` (if there) made to follow.

    The model is learned from the same documents.  A null text stays null.
    """
    model = fit(docs)

    def work():
        def of_texts(texts):
            base, added = spans_of(texts, model, least)
            made = [redacted(x, a + b) for x, a, b in zip(texts, base, added)]
            return {"redacted_text": made}

        return of_texts

    named = docs.toDF(*(f"kept_{c}" for c in docs.columns))
    made = per_batch(named, work, [T.StructField("redacted_text", T.StringType())], text="kept_text")
    out = {c: F.col(f"kept_{c}") for c in docs.columns} | {"text": F.col("redacted_text")}
    if "n_chars" in out:
        kind, size = docs.schema["n_chars"].dataType, F.length("redacted_text")
        out["n_chars"] = F.when(F.col("redacted_text") == F.col("kept_text"), F.col("kept_n_chars")).otherwise(size.cast(kind))
    return made.select(*(value.alias(name) for name, value in out.items()))
