from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwise.llm import quality_classifier, quality_rules, toxicity
from ledgerwise.llm.common import fold
from ledgerwise.llm.text_stats import stats, with_stats


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts, marked, seen, repeated = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": repeated,
        "n_repeat_words": len(marked),
    }


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_counts_against_plain_ones(real, odd):
    texts = list(real[1].items()) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    made = with_stats(real[0], keep=["doc_id"]).collect() + with_stats(odd, keep=["doc_id"]).collect()
    key = lambda x: (str(x["doc_id"]), tuple(x[c] for c in plain_counts("")))
    want = sorted((str(i), tuple(plain_counts(x).values())) for i, x in texts)
    assert sorted(map(key, made)) == want
    assert stats("a\x1cb\x85c d")[0] == 2


@pytest.mark.parametrize("failures, trials", [(0, 1), (0, 50), (3, 80), (40, 41), (120, 9000)])
def test_upper_bound_is_exact(failures, trials):
    bound = quality_rules.upper_bound(failures, trials, 0.01)
    below = sum(math.comb(trials, k) * bound**k * (1 - bound) ** (trials - k) for k in range(failures + 1))
    assert below == pytest.approx(0.01, rel=1e-6)


def test_bounds_at_the_edges():
    assert quality_rules.upper_bound(0, 0, 0.1) == 1.0 == quality_rules.upper_bound(5, 5, 0.1)


def holdout(spark, rows):
    return spark.createDataFrame(rows, "stratum string, quality int, n_words long, word_chars long, n_symbols long").selectExpr(
        "*", "1L as n_lines", "0L as n_dup_lines", "0L as n_repeat_words", "0L as n_capitals", "0L as n_marks"
    )


def test_cutoffs_reject_few_good_documents(spark):
    rows = [("a", 1, 100, 1000, i % 200) for i in range(4000)] + [("a", 0, 100, 1000, 900)] * 50 + [("b", 1, 100, 1000, 5)] * 8
    chosen = quality_rules.fit(holdout(spark, rows))
    assert chosen.get("b") is None  # eight labels show nothing
    step = chosen["a"]["symbols"]
    rejected = sum(r[4] / 1000 * quality_rules.STEPS >= step for r in rows[:4000])
    assert quality_rules.upper_bound(rejected, 4000, 0.05 / 10) <= 0.01
    assert 0.18 <= step / quality_rules.STEPS <= 0.22  # good ones end at 0.199
    marked = holdout(spark, rows).where(quality_rules.rejected(chosen, F.col("stratum")))
    assert {(r["stratum"], r["quality"]) for r in marked.collect()} >= {("a", 0)}
    assert marked.where("quality = 0").count() == 50 and marked.where("stratum = 'b'").count() == 0


def test_rules_on_odd_rows(odd, none, labels):
    counts = with_stats(odd.drop("stratum").withColumnRenamed("lang", "stratum"), keep=["doc_id", "stratum"])
    rows = quality_rules.judged(counts, labels.union(labels)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert r["kept"] is False or not r["base_failed"]
    assert quality_rules.judged(with_stats(none, keep=["doc_id", "stratum"]), labels).collect() == []


def test_rule_ensemble_on_held_out_labels(real, labels):
    counts = with_stats(real[0], keep=["doc_id"])
    rows = counts.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = quality_classifier.fit(rows.where(fold(F.col("doc_id"), 3) != 1))
    assert 0 < len(model["rules"]) < 100
    made = quality_classifier.scored(rows, model, ["doc_id", "label"])
    held_out = made.where(fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 1) for r in held_out]) >= 0.9
    assert "Python" not in made.select("score")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_rules_are_tree_paths():
    tree = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert quality_classifier.paths(tree, ["a", "b"]) == [
        (("a", "<=", 1.5),),
        (("a", "<=", 1.5), ("b", ">", 2.0)),
        (("a", "<=", 1.5), ("b", "<=", 2.0)),
        (("a", ">", 1.5),),
    ]


def test_rule_ensemble_on_odd_rows(odd, none):
    counts = with_stats(odd, keep=["doc_id"])
    for train, share in ((counts.withColumn("label", F.lit(1)), 11 / 12), (counts.where("false").withColumn("label", F.lit(1)), 0.5)):
        model = quality_classifier.fit(train)
        rows = quality_classifier.scored(counts, model, ["doc_id"]).collect()
        assert len(rows) == 10 and all(r["score"] == pytest.approx(share) for r in rows)
    assert quality_classifier.scored(with_stats(none, keep=["doc_id"]), model, ["doc_id"]).collect() == []


def plain_kernel(a, b, order=toxicity.ORDER, decay=toxicity.DECAY):
    total = 0.0
    for i in itertools.combinations(range(len(a)), order):
        for j in itertools.combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel():
    words = ["idiot", "id*iot", "i.d.i.o.t", "idoit", "pathetic", "xxidiotyy", "st", "aaaa"]
    pairs = list(itertools.product(words, words))
    left, right = (toxicity._table([p[k] for p in pairs], 12, fill) for k, fill in ((0, -1), (1, -2)))
    want = [plain_kernel(a, b) for a, b in pairs]
    assert np.allclose(toxicity.subsequence_kernel(left, right), want, rtol=1e-4)
    near = toxicity.similarities(["idiot", "id*iot", "i.d.i.o.t", "idxiot", "table", "q" * 100 + "idiot"], ["idiot"])[:, 0]
    assert near[0] == pytest.approx(1, abs=1e-3) and near[1] > 0.9 and near[2] > 0.9 and near[3] > 0.5
    assert near[4] == 0 and near[5] > 0


def test_spaced_words_and_sentences():
    assert toxicity.words_of("you i d i o t there") == ["you", "idiot", "there"]
    assert toxicity.sentences_of(["a", "b.", "c", "d!", "e"]).tolist() == [0, 0, 1, 1, 2]
    assert toxicity.words_of(None) == []


def test_toxicity_on_labels_and_changed_insults(spark, real, labels):
    """Plain, gapped and spaced insults score high in a text that does not without them."""
    insults = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()
    docs = real[0].select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    model = toxicity.fit(docs)
    assert len(set(model["landmarks"]) & set(insults)) >= 7
    clean = "The rain over the hills went on and on. Nobody in the house had slept."
    texts = [clean, *(f"{clean} What a {w} that was. {clean}" for w in model["landmarks"] if w in insults)]
    for change in (lambda w: "".join(c + "-" for c in w), lambda w: " ".join(w), lambda w: w[:2] + "x" + w[2:]):
        texts += [f"{clean} What a {change(w)} that was. {clean}" for w in ("disgusting", "pathetic", "stupid")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    assert scores[0] < 0.7
    assert sum(scores[i] > scores[0] + 0.1 for i in range(1, len(texts))) >= 0.85 * (len(texts) - 1)


def test_toxicity_on_odd_rows(odd, none, real, labels):
    docs = real[0].select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    model = toxicity.fit(docs)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 7)}) == 1
    assert toxicity.scored(none, model).collect() == []
    flat = toxicity.fit(docs.where("label = 0"))
    assert len({r["score"] for r in toxicity.scored(odd, flat).collect()}) == 1
    assert toxicity.fit(docs.where("false"))["shift"] == 0.0


def test_similarities_in_every_script():
    """Words without a-z, or with few of them, have the similarities of the plain kernel."""
    marks = ["дурак", "ηλίθιος", "غبيجدا", "大笨蛋傻瓜", "çöplük", "48151623", "idiot"]
    words = [*marks, "дурачок", "д.у.р.а.к", "ηλιθιος", "大傻笨蛋", "çoplük", "481x51623", "leer"]
    got = toxicity.similarities(words, marks)
    for i, word in enumerate(words):
        for j, mark in enumerate(marks):
            want = max(
                plain_kernel(x, mark) / np.sqrt(plain_kernel(x, x) * plain_kernel(mark, mark)) for x in toxicity._views(word)
            )
            assert got[i, j] == pytest.approx(want, abs=1e-3)


def test_an_insult_in_another_script(spark):
    filler = "дождь над холмами шёл и шёл а в доме никто не спал до утра и было тихо как зимой".split()
    rng, rows = random.Random(5), []
    for i in range(400):
        text = [rng.choice(filler) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(1, 39)] = "придурок"
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label long"))
    assert "придурок" in model["landmarks"]
    texts = [" ".join(filler), " ".join([*filler[:9], "придурок", *filler[9:]]), " ".join([*filler[:9], "при-дурок", *filler[9:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    assert scores[0] < 0.5 < min(scores[1], scores[2])
