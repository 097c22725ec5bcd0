"""Counts over whole texts that quality rules and classifiers are made of."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.llm.common import per_batch

#: Signs that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_capitals",
    "n_digits", "n_marks", "n_bars", "n_stops", "longest_word",
)
_BLANKS = " \t\n\v\f\r"
_OF = {
    "n_symbols": SYMBOLS, "n_capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": "0123456789", "n_marks": "!?", "n_bars": "|",
    "n_stops": ".",
}
_ROWS = [np.frombuffer(v.encode(), np.uint8) for v in _OF.values()]
_BLANK_ROWS = np.frombuffer(_BLANKS.encode(), np.uint8)


def repeated_words(words: list) -> int:
    """Words in three-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marked = np.zeros(len(words) + 2, bool)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def stats(text: str | None) -> tuple:
    """``COUNTS`` of a text; null counts as empty.  Words stand between ASCII blanks; lines count if they hold one."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    sums = dict(zip(_OF, (int(of_byte[r].sum()) for r in _ROWS)))
    made = {
        "n_words": len(words),
        "word_chars": len(text) - int(of_byte[_BLANK_ROWS].sum()),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_distinct_words": len(set(words)),
        "longest_word": max(map(len, words), default=0),
    } | sums
    return tuple(made[c] for c in COUNTS)


def with_stats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of ``docs(text)`` and the ``COUNTS`` of every whole text, as longs."""

    def work():
        def of_texts(texts):
            columns = list(zip(*map(stats, texts))) or [[]] * len(COUNTS)
            return dict(zip(COUNTS, columns))

        return of_texts

    return per_batch(docs, work, [T.StructField(c, T.LongType()) for c in COUNTS], keep=keep)


def share(part: str, whole: str):
    """Quotient of two counts, 0 where there is nothing to divide."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
