"""Quality classifier: a sparse ensemble of rules from tree paths, compiled into Spark expressions."""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm.text_stats import share
from ledgerwise.shared import staged

#: A rule: (feature, "<=" or ">", threshold) conditions that must all hold.
Rule = tuple[tuple[str, str, float], ...]


def features() -> dict[str, Column]:
    """Statistics that rules are about, from the counts of ``text_stats``."""
    return {
        "words": F.log1p(F.col("n_words")),
        "word_length": share("word_chars", "n_words"),
        "longest_word": F.log1p(F.col("longest_word")),
        "symbols": share("n_symbols", "word_chars"),
        "bars": share("n_bars", "n_words"),
        "marks": share("n_marks", "n_words"),
        "stops": share("n_stops", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


def paths(tree: str, names: list[str]) -> list[Rule]:
    """Conditions of every path from the root of a printed tree, to inner nodes too."""
    found, above = [], []
    for line in tree.split("\n"):
        m = re.match(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            above = [a for a in above if a[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.append(tuple(sorted(c for _, c in above)))
    return found


def condition(rule: Rule) -> Column:
    """The rule as a Spark expression over the columns of ``features``."""
    parts = [F.col(f) <= t if sign == "<=" else F.col(f) > t for f, sign, t in rule]
    return reduce(lambda a, b: a & b, parts)


def fit(train: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 2e-3, seed: int = 11) -> dict:
    """``intercept`` and ``rules`` (with weights other than zero), from ``train(label, counts...)``.

    A random forest is grown by Spark on all rows; the paths of its trees are the rules; a logistic regression with an
    L1 penalty, again on all rows, keeps those that matter.  Without rows the score is one half, with a single class it
    is that class's share, smoothed.
    """
    named = features()
    rows = train.where("label in (0, 1)").select(F.col("label").cast("double"), *(v.alias(n) for n, v in named.items()))
    rows = staged(rows, "rule-training")  # every level of the trees and every step of the weights reads them
    total, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, total):
        return {"intercept": float(_log_odds((good + 1) / (total + 2))), "rules": []}
    table = VectorAssembler(inputCols=list(named), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(table)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString, list(named))})
    if not rules:
        return {"intercept": float(_log_odds(good / total)), "rules": []}
    marks = rows.select("label", *(condition(r).cast("double").alias(f"rule{i}") for i, r in enumerate(rules)))
    marked = VectorAssembler(inputCols=[f"rule{i}" for i in range(len(rules))], outputCol="features").transform(marks)
    marked = staged(marked.select("label", "features"), "rule-marks")
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(marked)
    kept = [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules) if w]
    return {"intercept": float(model.intercept), "rules": kept}


def _log_odds(share_of_good: float) -> float:
    return log(share_of_good / (1 - share_of_good))


def scored(counts: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row of ``counts``; built-in expressions only."""
    named = counts.select(*keep, *(v.alias(f) for f, v in features().items()))
    total = reduce(lambda a, b: a + b, [w * condition(r).cast("double") for w, r in model["rules"]], F.lit(model["intercept"]))
    return named.select(*keep, (1 / (1 + F.exp(-total))).alias("score"))
