"""Quality rules whose cutoffs carry a guarantee: exact binomial bounds on labelled holdouts, corrected for all tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm.text_stats import share

#: Cutoffs that are tried, laxest first: shares of 1, 0.98, ... 0.02.
STEPS = 50


def rules() -> dict[str, Column]:
    """Shares between 0 and 1 that are high in poor texts."""
    return {
        "symbols": F.least(share("n_symbols", "word_chars"), F.lit(1.0)),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "capitals": F.least(share("n_capitals", "word_chars"), F.lit(1.0)),
        "marks": F.least(share("n_marks", "n_words"), F.lit(1.0)),
    }


def upper_bound(failures: int, trials: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate, at level 1 - ``error``; 1 without trials."""
    if not trials or failures >= trials:
        return 1.0
    k = np.arange(failures + 1)
    ways = np.array([math.lgamma(trials + 1) - math.lgamma(x + 1) - math.lgamma(trials - x + 1) for x in k])
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = ways + k * math.log(p) + (trials - k) * math.log1p(-p)
        below = math.exp(min(0.0, logs.max() + math.log(np.exp(logs - logs.max()).sum())))
        low, high = (p, high) if below > error else (low, p)
    return high


def fit(holdout: DataFrame, risk: float = 0.05, error: float = 0.05) -> dict[str, dict[str, int]]:
    """Step of the strictest safe cutoff by stratum and rule, from ``holdout(stratum, quality, counts...)``.

    With probability 1 - ``error`` over the holdout, in every stratum at most ``risk`` of the documents of quality 1 are
    rejected by the rules together.  Each rule gets an equal part of the risk; each of the (stratum, rule) sequences gets
    an equal part of the error (Bonferroni), and within a sequence cutoffs are tested from lax to strict until the first
    that is not shown to be safe (fixed-sequence testing), so that none of the tests goes uncorrected.  The cutoffs are
    fixed in advance and not fitted to the holdout.  A stratum with too few labels gets no cutoff and rejects nothing.
    Counted by Spark over all labelled rows; the driver gets a histogram of ``STEPS`` bins a rule and stratum.
    """
    named = rules()
    good = holdout.where("quality = 1")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("value")) for n, v in named.items())))
    bins = F.floor(F.col("at.value") * STEPS + 1e-9).cast("int").alias("bin")
    counted = good.select("stratum", pairs.alias("at")).groupBy("stratum", "at.rule", bins).count().collect()
    table: dict[tuple, np.ndarray] = {}
    for stratum, rule, at, n in counted:
        table.setdefault((stratum, rule), np.zeros(STEPS + 1, np.int64))[at] += n
    chosen: dict[str, dict[str, int]] = {}
    for (stratum, rule), histogram in sorted(table.items()):
        trials, best = int(histogram.sum()), None
        for step in range(STEPS, 0, -1):
            failures = int(histogram[step:].sum())
            if upper_bound(failures, trials, error / len(table)) > risk / len(named):
                break
            best = step
        if best is not None:
            chosen.setdefault(stratum, {})[rule] = best
    return chosen


def rejected(chosen: dict[str, dict[str, int]], stratum: Column) -> Column:
    """Does any rule of the row's stratum reject it?"""
    named, verdict = rules(), F.lit(False)
    for name, steps in chosen.items():
        hit = F.lit(False)
        for rule, step in steps.items():
            hit = hit | (F.floor(named[rule] * STEPS + 1e-9) >= step)
        verdict = F.when(stratum.eqNullSafe(F.lit(name)), hit).otherwise(verdict)
    return verdict


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(counts: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """``counts(doc_id, stratum, ...)`` of ``text_stats`` with ``base_failed`` and ``kept``.

    ``labels(doc_id, quality)``: the holdout; of several labels of a document the lowest counts, null labels and labels of
    unknown documents do not.  Documents that fail the base are left out of the holdout, as the rules never decide on
    them.  A null stratum is one of its own.
    """
    one = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stratum = F.coalesce(F.col("stratum"), F.lit(""))
    chosen = fit(counts.withColumn("stratum", stratum).where(~base_failed()).join(one, "doc_id"), risk, error)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | rejected(chosen, stratum)))
