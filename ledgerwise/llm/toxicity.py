"""Toxicity: a subsequence string kernel with Nystroem landmarks under a support vector machine over sentences."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwise.llm.common import per_batch, sampled, worker_memory
from ledgerwise.shared import staged

#: Subsequences of so many letters count; each letter that they span costs the factor ``DECAY``.
ORDER, DECAY = 3, 0.8
#: Words longer than ``WINDOW`` are compared in windows that overlap by half.
WINDOW = 32
#: Words whose best similarity is below this are like no landmark.
LEAST = 0.45
#: Landmarks are words and beginnings of words of so many letters; a word is compared whole and by its beginnings, which
#: may be up to ``INSERTED`` letters longer than the landmark.
SHORTEST, LONGEST, INSERTED = 4, 9, 3
#: How many landmarks are expected by chance among those chosen.
BY_CHANCE = 1.0
#: Similarities are taken to this power (a polynomial of a kernel is a kernel), so that chance likeness counts little.
DEGREE = 2
#: A toxic document teaches only if some word of it is as like a landmark as this: labels are not always right.
WITNESS = 0.6
REMEMBERED = 800_000
#: Characters fall into so many buckets by their code points when common ones are counted; ASCII has one each.
BUCKETS = 128

_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_ENDS = (".", "!", "?")


def words_of(text: str | None) -> list[str]:
    """Lower-case words; letters that stand alone in a row of three or more make one word."""
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), (text or "").lower()).split()


def sentences_of(words: list[str]) -> np.ndarray:
    """Number of the sentence of each word: a word that ends in a stop ends it."""
    ends = np.fromiter((w.endswith(_ENDS) for w in words), bool, len(words))
    return np.concatenate(([0], np.cumsum(ends)[:-1])) if len(words) else np.zeros(0, int)


def letters(word: str) -> str:
    """The word without signs at its ends."""
    return word.strip("\"'.,;:!?()[]{}<>|#*$%&")


def _views(word: str) -> list[str]:
    """The word, and without the signs inside it if there are any."""
    return [word] if word.isalnum() else [word, "".join(c for c in word if c.isalnum())]


def _pieces(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[a : a + WINDOW] for a in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _table(words: list[str], width: int, fill: int) -> np.ndarray:
    """Code points, a row a word; ``fill`` beyond the end."""
    out = np.full((len(words), width), fill, np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted kernel of the rows of two tables of code points (padded with different fills), pair by pair.

    The usual recursion over prefixes; the one along the right word is a product with a triangular matrix.
    """
    pairs, width = right.shape
    fall = np.tril(decay ** np.maximum(np.subtract.outer(np.arange(width), np.arange(width)), 0.0)).T.astype(np.float32)
    prefixes = [np.ones((pairs, width), np.float32)] + [np.zeros((pairs, width), np.float32) for _ in range(order - 1)]
    total, square = np.zeros(pairs, np.float32), np.float32(decay * decay)
    for j in range(left.shape[1]):
        match = (left[:, j : j + 1] == right) * square
        for i in range(order - 1, -1, -1):
            # subsequences of i letters that end before this letter on both sides
            before = prefixes[i]
            if i:
                before = np.zeros_like(before)
                before[:, 1:] = prefixes[i][:, :-1]
            step = match * before
            if i == order - 1:
                total += step.sum(1)
            else:
                prefixes[i + 1] *= np.float32(decay)
                prefixes[i + 1] += step @ fall
    return total


def _counts(table: np.ndarray) -> np.ndarray:
    """Numbers of the characters of each bucket in each row, 255 at most.  Code points share buckets, which only makes what two
    words have in common look like more."""
    rows, columns = np.nonzero(table >= 0)
    out = np.bincount(rows * BUCKETS + table[rows, columns] % BUCKETS, minlength=len(table) * BUCKETS)
    return np.minimum(out, 255).astype(np.uint8).reshape(len(table), BUCKETS)


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark.  Pairs with fewer than ``ORDER`` characters in common have a kernel of
    exactly zero and are not computed; long words count by their best window."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    pieces = [(i, p) for i, w in enumerate(words) for view in _views(w) for p in _pieces(view)]
    wide = max(map(len, landmarks), default=1)
    marks = _table(landmarks, wide, -2)
    own = np.sqrt(np.maximum(subsequence_kernel(_table(landmarks, wide, -1), marks), 1e-12))
    mark_counts = _counts(marks)
    for low, high in ((0, 8), (8, 12), (12, 20), (20, WINDOW)):
        group = [x for x in pieces if low < len(x[1]) <= high]
        for at in range(0, len(group), 50_000):
            part = group[at : at + 50_000]
            table = _table([p for _, p in part], high, -1)
            counts = _counts(table)
            shared = np.stack([np.minimum(counts[:, m > 0], m[m > 0]).sum(1, dtype=np.int32) for m in mark_counts], 1)
            rows, columns = np.nonzero(shared >= ORDER)
            if not len(rows):
                continue
            used, where = np.unique(rows, return_inverse=True)
            some = table[used]
            norms = np.sqrt(np.maximum(_chunked(some, np.where(some < 0, -2, some)), 1e-12))
            values = _chunked(table[rows], marks[columns]) / norms[where] / own[columns]
            np.maximum.at(out, (np.array([i for i, _ in part])[rows], columns), values)
    return out


def _chunked(left: np.ndarray, right: np.ndarray, size: int = 8192) -> np.ndarray:
    parts = [subsequence_kernel(left[a : a + size], right[a : a + size]) for a in range(0, len(left), size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def letters_needed(landmark: str) -> int:
    """How many of a landmark's letters a word must have for a similarity of ``LEAST``.

    Only subsequences of letters that both have are shared, so the similarity is at most the norm of the landmark's own ones
    of these letters over the norm of all: the smallest number for which the best choice of letters gets there.  Long
    landmarks have too many choices; three letters are needed in any case.
    """
    n, weights = len(landmark), Counter()
    if n > 12:
        return ORDER
    for places in combinations(range(n), ORDER):
        weights["".join(landmark[i] for i in places)] += DECAY ** (places[-1] - places[0] + 1)
    squares = [(Counter(u), w * w) for u, w in weights.items()]
    enough = LEAST**2 * sum(w for _, w in squares) * (1 - 1e-6)
    for size in range(ORDER, n):
        for some in {tuple(sorted(c)) for c in combinations(landmark, size)}:
            if sum(w for letters_of, w in squares if letters_of <= Counter(some)) >= enough:
                return size
    return n


def nearness(words: list[str], landmarks: list[str], needed: list[int] | None = None) -> np.ndarray:
    """Best similarity of each word with each landmark, of the word whole, if it is at most twice as long, or of a beginning of
    about the landmark's length; 0 where it is below ``LEAST``, or where fewer letters than are needed to get there are in
    common in order."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    needed = needed or [letters_needed(m) for m in landmarks]
    marks = _table(landmarks, max(map(len, landmarks), default=1), -2)
    own = _norms(_table(landmarks, marks.shape[1], -1))
    pieces = [(i, p, k == 0) for i, w in enumerate(words) for view in _views(w) for k, p in enumerate(_pieces(view))]
    for low, high in ((ORDER - 1, 8), (8, 12), (12, 20), (20, WINDOW)):
        group = [x for x in pieces if low < len(x[1]) <= high]
        for at in range(0, len(group), 50_000):
            part = group[at : at + 50_000]
            owner, first = np.array([x[0] for x in part]), np.array([x[2] for x in part])
            table, length = _table([x[1] for x in part], high, -1), np.array([len(x[1]) for x in part])
            for mark, landmark in enumerate(landmarks):
                for size, lcs in _common(table, landmark):
                    if size is None:
                        rows = np.flatnonzero((lcs >= needed[mark]) & (length <= 2 * len(landmark) + 1))
                        held = table[rows]
                    else:
                        rows = np.flatnonzero((lcs >= needed[mark]) & first & (length > size))
                        held = table[rows, :size]
                    if len(rows):
                        values = _chunked(held, np.broadcast_to(marks[mark], (len(rows), marks.shape[1]))) / _norms(held) / own[mark]
                        np.maximum.at(out[:, mark], owner[rows], values)
    out[out < LEAST] = 0
    return out


def _common(table: np.ndarray, landmark: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Length of the longest common subsequence of a landmark with a beginning of each row of code points, for beginnings of
    the landmark's length and up to ``INSERTED`` more, and last (None) with the whole row; bit-parallel, all rows at once."""
    n = min(len(landmark), 63)
    row = np.full(len(table), (1 << n) - 1, np.uint64)
    for place in range(table.shape[1]):
        hits, signs = np.zeros(len(table), np.uint64), table[:, place]
        for i, sign in enumerate(landmark[:n]):
            hits |= (signs == ord(sign)).astype(np.uint64) << np.uint64(i)
        hits &= row
        row = ((row + hits) | (row - hits)) & np.uint64((1 << n) - 1)
        if len(landmark) <= place + 1 <= len(landmark) + INSERTED:
            yield place + 1, n - np.bitwise_count(row).astype(np.int64)
    yield None, n - np.bitwise_count(row).astype(np.int64)


def _norms(table: np.ndarray) -> np.ndarray:
    """Norm of each row of code points (padded with -1) in the space of the kernel."""
    return np.sqrt(np.maximum(_chunked(table, np.where(table < 0, -2, table)), 1e-12))


class Memory:
    """Rows of similarities of the words a worker has seen; None for words that are like no landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.known = landmarks, {}
        self.needed = [letters_needed(m) for m in landmarks]

    def learn(self, words: set) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, list(words)
        found = nearness([letters(w) for w in fresh], self.landmarks, self.needed)
        hits = found.any(1)
        self.known.update(dict.fromkeys(fresh))
        for i in np.flatnonzero(hits).tolist():
            self.known[fresh[i]] = found[i] ** DEGREE


def sentence_rows(texts: list, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """Document of each sentence with a word like a landmark, and its best similarity with each landmark."""
    split = [words_of(x) for x in texts]
    memory.learn(set().union(*split))
    docs, rows = [], []
    for doc, words in enumerate(split):
        found = [memory.known[w] for w in words]
        hits = [i for i, row in enumerate(found) if row is not None]
        if hits:
            sentence = sentences_of(words)[hits]
            edges = np.flatnonzero(np.diff(sentence, prepend=-1))
            best = np.maximum.reduceat(np.stack([found[i] for i in hits]), edges, axis=0)
            docs += [doc] * len(best)
            rows.append(best)
    return np.array(docs, int), np.concatenate(rows) if rows else np.zeros((0, len(memory.landmarks)), np.float32)


def _log_chance(hits: int, total: int, share: float) -> float:
    """Upper bound of the logarithm of the chance that ``hits`` or more of ``total`` fall to a class of ``share`` (Chernoff)."""
    part = hits / total
    if part <= share:
        return 0.0
    rest = (1 - part) * math.log((1 - part) / (1 - share)) if part < 1 else 0.0
    return -total * (part * math.log(part / share) + rest)


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and beginnings of words that stand in toxic documents too often for chance.

    What counts is the number of distinct surroundings (the words before and after), so that what copies of a document
    repeat counts once.  Each is tested against the share of surroundings that toxic documents have; the test is corrected for
    the number of different ones, and no more than ``BY_CHANCE`` are expected to pass by chance.  The strongest comes first; one
    that begins with another, or the other way round, is left out.  Their number is what the labels support.
    """
    around: dict[str, set] = {}
    sides: list[set] = [set(), set()]
    for text, label in zip(texts, toxic):
        words = ["", *(letters(w) for w in words_of(text)), ""]
        places = {(before, word, after): hash((before, word, after, int(label))) for before, word, after in zip(words, words[1:], words[2:])}
        sides[int(label)].update(places.values())
        for (_, word, _), place in places.items():
            if len(word) >= ORDER:
                around.setdefault(word, set()).add((place, int(label)))
    share = len(sides[1]) / max(1, len(sides[0]) + len(sides[1]))
    counts = {word: [sum(side == k for _, side in found) for k in (0, 1)] for word, found in around.items()}
    begins: dict[str, list[int]] = {}
    for word, (clean, bad) in counts.items():
        for n in range(SHORTEST, min(len(word), LONGEST)):
            held = begins.setdefault(word[:n], [0, 0])
            held[0] += clean
            held[1] += bad
    tested: dict[tuple, str] = {}
    odds = len(sides[1]) / max(1, len(sides[0]))
    for name, held in sorted({**begins, **{w: h for w, h in counts.items() if w not in begins}}.items(), key=lambda x: -len(x[0])):
        if held[1] >= 3 and held[1] > 4 * odds * held[0]:
            tested.setdefault((name[:SHORTEST], *held), name)  # a beginning that is in the same places is no new trial
    scored = sorted((_log_chance(bad, clean + bad, share), -len(name), name) for (_, clean, bad), name in tested.items())
    chosen: list[str] = []
    for chance, _, name in scored:
        if chance > math.log(BY_CHANCE / len(scored)):
            break
        if not any(name.startswith(c) or c.startswith(name) for c in chosen):
            chosen.append(name)
    return chosen


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 200_000) -> DataFrame:
    """``doc_id, text, label`` of about ``per_class`` labelled documents of each label, of at most ``longest`` characters; written.

    Ids are chosen first, by a hash, and only their texts are read on; no text is shuffled.  Several labels of one id:
    toxic if one says so.  Labels without id, and ids without document, teach nothing.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known, "known-labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = staged(sampled(known, F.col("label"), counts, per_class), "chosen-ids")
    short = docs.select("doc_id", "text").where(F.length("text") <= longest)
    return staged(short.join(F.broadcast(ids), "doc_id"), "training")  # ids of about twice per_class documents


def fit(train: DataFrame, per_class: int = 2000, rounds: int = 3) -> dict:
    """The model from ``train(doc_id, text, label)``.

    Labels belong to documents, so the sentences' labels are found on the way: every sentence of a clean document is
    negative; of a toxic one, those with a witness are positive as long as the machine agrees, its worst in any case.
    Fitted on about ``per_class`` whole documents of each label, chosen by a hash of the row, which bounds what the driver
    gets.  Without both labels, landmarks or witnesses: a model that scores everything with the smoothed share of label 1.
    """
    train = train.where("label in (0, 1) and text is not null")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = {"landmarks": [], "weights": None, "slope": 0.0, "shift": math.log(prior / (1 - prior))}
    if len(counts) < 2:
        return flat
    chosen = sampled(train, F.col("label"), counts, per_class).select("text", "label")
    rows = sorted((r["text"], r["label"]) for r in chosen.collect())
    texts, toxic = [r[0] for r in rows], np.array([r[1] for r in rows])
    landmarks = choose_landmarks(texts, toxic)
    if not landmarks:
        return flat
    memory, parts = Memory(landmarks), []
    for at in range(0, len(texts), 200):
        docs, x = sentence_rows(texts[at : at + 200], memory)
        parts.append((docs + at, x))
    docs, x = (np.concatenate(p) for p in zip(*parts))
    values, turn = np.linalg.eigh(similarities(landmarks, landmarks).astype(np.float64) ** DEGREE)
    root = turn @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ turn.T
    mapped = x @ root
    worst, witness = x.max(1, initial=0), x.max(1, initial=0) >= WITNESS**DEGREE
    for _ in range(rounds):
        best = np.zeros(len(docs), bool)
        best[_best_of_each(docs, np.where(witness, worst, -np.inf), toxic)] = True
        positive = np.flatnonzero(witness & (toxic[docs] == 1) & (best | (worst >= 0)))
        if not len(positive):
            return flat
        negative = np.flatnonzero(toxic[docs] == 0)
        chosen = np.concatenate([positive, negative, [-1]])
        table = np.vstack([mapped, np.zeros((1, mapped.shape[1]))])[chosen]
        labels = np.concatenate([np.ones(len(positive)), -np.ones(len(negative) + 1)])
        weights, bias = _svm(table, labels, np.concatenate([np.ones(len(chosen) - 1), [max(1, len(positive))]]))
        worst = mapped @ weights + bias
    margins = np.full(len(texts), bias)
    np.maximum.at(margins, docs, worst)
    slope, shift = _sigmoid(margins, toxic)
    return {"landmarks": landmarks, "weights": root @ weights, "bias": bias, "slope": slope, "shift": shift}


def _best_of_each(docs: np.ndarray, score: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    order = np.lexsort((-score, docs))
    first = order[np.flatnonzero(np.diff(docs[order], prepend=-1))]
    return first[toxic[docs[first]] == 1]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Linear machine, squared hinge loss, both classes with the same total weight, accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight * np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y < 0].sum()))
    step = 1 / (2 * float((weight[:, None] * x**2).sum()) + penalty)
    w = ahead = np.zeros(x.shape[1])
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        moved = ahead - step * (penalty * ahead - 2 * (weight * slack * y) @ x)
        ahead, w = moved + i / (i + 3) * (moved - w), moved
    return w[:-1], float(w[-1])


def _sigmoid(margins: np.ndarray, label: np.ndarray, rounds: int = 2000) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, classes weighted alike, smoothed targets."""
    high, low = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    target = np.where(label == 1, high, low)
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        off = weight * (1 / (1 + np.exp(-(slope * margins + shift))) - target)
        slope, shift = slope - 2 * float(off @ margins), shift - 2 * float(off.sum())
    return max(slope, 0.0), shift


def scored(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``score`` (0 to 1) of every whole ``text``: the worst sentence decides.

    Null and empty texts score like any text without a word that is like a landmark.  Repeated rows score alike.
    """
    name = f"toxicity {hash(tuple(model['landmarks']))}"

    def work():
        memory = worker_memory(name, lambda: Memory(model["landmarks"]))

        def of_texts(texts):
            margins = np.full(len(texts), model.get("bias", 0.0))
            if model["landmarks"]:
                rows, x = sentence_rows(texts, memory)
                np.maximum.at(margins, rows, x @ model["weights"] + model["bias"])
            return {"score": (1 / (1 + np.exp(-(model["slope"] * margins + model["shift"])))).tolist()}

        return of_texts

    return per_batch(docs, work, [T.StructField("score", T.DoubleType())], keep=keep)
