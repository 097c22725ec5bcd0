"""Language identification in two steps: family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.llm.common import per_batch, sampled

#: Families of ISO 639-1 codes (fixed values).  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"
BUCKETS = 4096
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed byte trigrams, a vector of length one; None without letters."""
    if not text or not _LETTER.search(text):
        return None
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" ", np.uint8)
    raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))].astype(np.uint32)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(1, len(mixed))).astype(np.float32)


def fit(train: DataFrame, per_language: int = 500, rounds: int = 300) -> dict:
    """The model, from ``train(text, lang)`` and whatever columns keep its rows apart.

    Languages are counted over all rows; the classifiers are fitted on about ``per_language`` documents of each language
    (whole texts, chosen by a hash of the row), which bounds what the driver gets.  Rows without language or letters teach
    nothing.  No rows: a model that answers ``und``.
    """
    train = train.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = []
    if counts:
        chosen = sampled(train, F.col("lang"), counts, per_language).select("lang", "text")

        def work():
            def of_texts(texts):
                made = [features(x) for x in texts]
                return {"vector": [None if x is None else x.astype("<f2").tobytes() for x in made]}

            return of_texts

        field = [T.StructField("vector", T.BinaryType())]
        rows = per_batch(chosen, work, field, keep=["lang"]).where("vector is not null").collect()
    rows = sorted(((r["lang"], bytes(r["vector"])) for r in rows))
    if not rows:
        return {"families": [], "members": {}, "family_weights": None, "pairs": {}}
    names = np.array([r[0] for r in rows])
    x = np.stack([np.frombuffer(r[1], "<f2") for r in rows]).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    family = np.array([FAMILY_OF.get(n, n) for n in names])
    families = sorted(set(family))
    members = {f: sorted(set(names[family == f])) for f in families}
    weights = None
    if len(families) > 1:
        weights = np.stack([_svm(x, np.where(family == f, 1.0, -1.0), rounds) for f in families])
    pairs = {}
    for f in families:
        for a, b in combinations(members[f], 2):
            of_pair = (names == a) | (names == b)
            pairs[a, b] = _svm(x[of_pair], np.where(names[of_pair] == a, 1.0, -1.0), rounds)
    return {"families": families, "members": members, "family_weights": weights, "pairs": pairs}


def _svm(x: np.ndarray, y: np.ndarray, rounds: int, penalty: float = 1e-4) -> np.ndarray:
    """Linear support vector machine, squared hinge loss, classes weighted alike, accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w, ahead, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1 / (4.0 + penalty)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        moved = ahead - step * (penalty * ahead - 2 * ((share * slack * y) @ x))
        ahead, w = moved + i / (i + 3) * (moved - w), moved
    return w


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * margin)))


def predict(vector: np.ndarray | None, model: dict) -> tuple[str, float]:
    """Language and certainty: the family's share times the weakest duel the winner has won."""
    if vector is None or not model["families"]:
        return UNDETERMINED, 0.0
    x = np.append(vector, np.float32(1))
    family, certain = model["families"][0], 1.0
    if model["family_weights"] is not None:
        odds = np.array([_sure(m) for m in model["family_weights"] @ x])
        best = int(np.argmax(odds))
        family, certain = model["families"][best], float(odds[best] / odds.sum())
    members = model["members"][family]
    won, least = dict.fromkeys(members, 0), dict.fromkeys(members, 1.0)
    for a, b in combinations(members, 2):
        sure = _sure(float(model["pairs"][a, b] @ x))
        won[a if sure >= 0.5 else b] += 1
        least[a], least[b] = min(least[a], sure), min(least[b], 1 - sure)
    winner = max(members, key=lambda m: (won[m], least[m], m))
    return winner, certain * least[winner]


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``lang_pred`` and ``score`` for every row of ``docs``, from its whole text.

    Null, empty or letterless texts give ``und`` with score 0.  Repeated rows get the same answer each.
    """

    def work() -> Callable[[list], dict]:
        def of_texts(texts):
            answers = [predict(features(x), model) for x in texts]
            return {"lang_pred": [a[0] for a in answers], "score": [a[1] for a in answers]}

        return of_texts

    return per_batch(docs, work, FIELDS, text, keep)
