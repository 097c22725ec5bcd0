"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences and answers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerwise.llm.common import in_batches, sampled, sliced
from ledgerwise.llm.words import hashed_words
from ledgerwise.shared import staged

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Words of the smallest unit; windows of all lengths are sums of units.
UNIT = 4
SMALLEST_WINDOW = 16
#: A stretch of a document is compared with an item if it has at most so many times the item's words.
STRETCH = 1.5
#: Units and documents that are worked on together: what they need stays in a core's own cache.
_ROWS_AT_ONCE = 1 << 10
_DOCS_AT_ONCE = 8
#: Passages that are multiplied together, sums that are made together, and passages of a word that are summed at once.
_PASSAGES_AT_ONCE = 1 << 15
_LINES_AT_ONCE = 1 << 12
_LINE = 8
#: Pieces of a product of all words, each added up by itself.
_PIECES = 32

FOUND = T.StructType(
    [
        T.StructField("cosine", T.DoubleType()),
        T.StructField("lcs_ratio", T.DoubleType()),
        T.StructField("answer_ratio", T.DoubleType()),
        T.StructField("first_word", T.LongType()),
    ]
)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counted(docs: DataFrame, passage_words: int = 32) -> DataFrame:
    """Words of ``docs(text)``, hashed and written once: rows with the ``passages`` of a batch, and rows with a ``bucket`` and
    the number ``n`` of a task's documents that hold it (``BUCKETS``: of all its documents)."""
    counts_of = [T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())]
    schema = T.StructType([T.StructField("passages", T.BinaryType()), *counts_of])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, stamp = np.zeros(BUCKETS + 1, np.int64), np.zeros(_DOCS_AT_ONCE * BUCKETS, np.int32)
        for batch in sliced(batches):
            hashes, bounds = hashed_words(batch.column("text"))
            found, seen = buckets(hashes), []
            for doc in range(0, batch.num_rows, _DOCS_AT_ONCE):
                edges = bounds[doc : doc + _DOCS_AT_ONCE + 1]
                part = found[edges[0] : edges[-1]]
                key = np.repeat(np.arange(len(edges) - 1) * BUCKETS, np.diff(edges)) + part
                # the last word of a document in a bucket is the one whose stamp is still its own
                turn = np.arange(len(part), dtype=np.int32)
                stamp[key] = turn
                seen.append(part[stamp[key] == turn])
            counts[:BUCKETS] += np.bincount(np.concatenate(seen), minlength=BUCKETS)
            counts[BUCKETS] += batch.num_rows
            if len(found):
                row = [[_passages(found, passage_words).tobytes()], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, target)], schema=target)
        there = np.flatnonzero(counts)
        arrays = [pa.nulls(len(there), pa.binary()), pa.array(there), pa.array(counts[there])]
        yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return staged(in_batches(docs.select("text"), run, schema), "words")


def inverse_frequencies(docs: DataFrame, words: DataFrame | None = None) -> np.ndarray:
    """IDF of every hashed word over all documents of ``docs(text)``, float32; ``words`` are those of ``docs``, if they are
    ``counted``.  What comes to the driver is one number for each of the ``BUCKETS`` buckets."""
    words = counted(docs) if words is None else words
    totals = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in words.where("bucket is not null").groupBy("bucket").agg(F.sum("n")).collect():
        totals[bucket] = n
    return np.log((1 + totals[BUCKETS]) / (1.0 + totals[:BUCKETS])).astype(np.float32) + np.float32(0.05)


def _unit_sums(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``rows`` over units of words, and the first unit of each text; texts start with a unit of their own."""
    lengths = np.diff(bounds)
    units = -(-lengths // UNIT)
    first = np.concatenate(([0], np.cumsum(units)))
    padded = np.full(first[-1] * UNIT, BUCKETS, np.int64)
    padded[np.arange(len(hashes)) + np.repeat(first[:-1] * UNIT - bounds[:-1], lengths)] = buckets(hashes)
    sums = np.empty((first[-1], rows.shape[1]), np.float32)
    for at in range(0, len(sums), _ROWS_AT_ONCE):
        part = padded[at * UNIT : (at + _ROWS_AT_ONCE) * UNIT].reshape(-1, UNIT)
        total = rows[part[:, 0]]
        for k in range(1, UNIT):
            total += rows[part[:, k]]
        sums[at : at + len(part)] = total
    return sums, first


def _with_zero(rows: np.ndarray) -> np.ndarray:
    return np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)])


def latent_space(
    docs: DataFrame,
    idf: np.ndarray,
    rank: int = 64,
    passage_words: int = 32,
    fit_docs: int | None = None,
    seed: int = 7,
    words: DataFrame | None = None,
) -> np.ndarray:
    """Word vectors (``BUCKETS`` x ``rank``): the passages' TF-IDF matrix by randomised SVD with power steps.

    A word's vector is its row of right singular vectors over the singular values, made as long as its IDF, so that a
    frequent turn of phrase does not drown rare words; a word that no passage holds keeps its random start.  Fitted on the
    passages of all documents, unless ``fit_docs`` asks for about so many of them.

    Passages are those of ``words``, if the words of ``docs`` are ``counted``.  Each of as many tasks as the cluster has cores multiplies its
    passages (rows of length one, a word counts once) with the current basis and back; the products are added up piece by
    piece, so that the driver, which makes the basis orthonormal, gets one product however many documents or tasks there
    are.  A basis is broadcast for its round and destroyed after it.
    """
    context = docs.sparkSession.sparkContext
    if fit_docs is not None:
        docs = sampled(docs.select("doc_id", "text").withColumn("any", F.lit(0)), F.col("any"), {0: docs.count()}, fit_docs)
    place = [T.StructField("piece", T.LongType()), T.StructField("task", T.LongType())]
    schema = T.StructType([*place, T.StructField("product", T.BinaryType())])

    words = counted(docs, passage_words) if words is None or fit_docs is not None else words
    passages = words.where("passages is not null").select("passages").coalesce(context.defaultParallelism)

    def product(basis: np.ndarray) -> np.ndarray:
        shared, shape = context.broadcast((idf, basis)), basis.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (idf, basis), back, task = shared.value, np.zeros(shape, np.float32), TaskContext.get().partitionId()
            rows, squares = _with_zero(basis * idf[:, None]), np.append(idf.astype(np.float64) ** 2, 0)
            for batch in batches:
                for held in batch.column("passages"):
                    found = np.frombuffer(held.as_buffer(), np.uint16).reshape(-1, passage_words)
                    for at in range(0, len(found), _PASSAGES_AT_ONCE):
                        _add_product(found[at : at + _PASSAGES_AT_ONCE], rows, squares, back)
            back *= idf[:, None]
            for piece, part in enumerate(np.split(back, _PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([task]), pa.array([part.tobytes()])], names=schema.names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, part in zip(batch.column("piece").to_pylist(), batch.column("product")):
                    part = np.frombuffer(part.as_buffer(), np.float32)
                    sums[piece] = sums[piece] + part if piece in sums else part.astype(np.float64)
            for piece, part in sums.items():
                whole = pa.array([part.astype(np.float32).tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([0]), whole], names=schema.names)

        parts = in_batches(passages, run, schema).repartition("piece").sortWithinPartitions("piece", "task")
        added = np.zeros((_PIECES, shape[0] // _PIECES, shape[1]), np.float32)
        for row in in_batches(parts, add, schema).collect():
            added[row["piece"]] = np.frombuffer(row["product"], np.float32).reshape(added.shape[1:])
        shared.destroy()
        return added.reshape(shape)

    start = lambda: np.random.default_rng(seed).standard_normal((BUCKETS, rank + 8), dtype=np.float32)
    basis = start()
    for _ in range(2):
        basis, _ = np.linalg.qr(product(basis))
    back = product(basis)
    values, turn = np.linalg.eigh((basis.T @ back).astype(np.float64))
    best = np.argsort(-values)[:rank]
    scale = np.maximum(values[best], 1e-9) ** -0.5
    rows = basis @ (turn[:, best] * scale).astype(np.float32)
    rows += np.float32(1e-6 * max(float(np.abs(rows).max()), 1e-6)) * start()[:, :rank]
    rows *= (idf / np.sqrt(np.einsum("ij,ij->i", rows, rows)))[:, None]
    return rows


def _passages(found: np.ndarray, passage_words: int) -> np.ndarray:
    """The words ``found`` in rows of ``passage_words``, uint16; what repeats in a row or fills the last is ``BUCKETS``."""
    rows = np.full((-(-len(found) // passage_words), passage_words), BUCKETS, np.uint16)
    rows.reshape(-1)[: len(found)] = found
    rows.sort(axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = BUCKETS
    return rows


def _line_sums(rows: np.ndarray, lines: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of the ``rows`` that each of ``lines`` names, in blocks: number of the first line, and the sums."""
    part = np.empty((_LINES_AT_ONCE, rows.shape[1]), np.float32)
    for at in range(0, len(lines), _LINES_AT_ONCE):
        places = np.ascontiguousarray(lines[at : at + _LINES_AT_ONCE].T, np.intp)
        total = np.take(rows, places[0], axis=0, mode="clip")
        for place in places[1:]:
            total += np.take(rows, place, axis=0, out=part[: len(total)], mode="clip")
        yield at, total


def _add_product(passages: np.ndarray, rows: np.ndarray, squares: np.ndarray, back: np.ndarray) -> None:
    """Adds A'(A basis) for ``_passages``, A being their TF-IDF rows, to ``back``, which lacks the IDF of its words; ``rows``
    are those of the basis times the IDF, ``squares`` are of the IDF, both zero for what is no word."""
    projected = np.zeros((len(passages) + 1, rows.shape[1]), np.float32)
    for at, total in _line_sums(rows, passages):
        lengths = np.maximum(squares[passages[at : at + len(total)]].sum(1), 1e-30)
        np.divide(total, lengths.astype(np.float32)[:, None], out=projected[at : at + len(total)])
    words = passages.reshape(-1)
    order = np.argsort(words, kind="stable")[: np.count_nonzero(words != BUCKETS)].astype(np.int32)
    # the passages of each word in lines of their own, the last of them filled up with what has no product
    counts = np.bincount(words, minlength=BUCKETS + 1)[:BUCKETS]
    there = np.flatnonzero(counts)
    counts = counts[there]
    of_word = -(-counts // _LINE)
    starts = (np.cumsum(of_word) - of_word) * _LINE - (np.cumsum(counts) - counts)
    lines = np.full(of_word.sum() * _LINE, len(passages), np.int32)
    lines[np.arange(len(order)) + np.repeat(starts, counts)] = order // np.int32(passages.shape[1])
    there = np.repeat(there, of_word)
    for at, total in _line_sums(projected, lines.reshape(-1, _LINE)):
        word = there[at : at + len(total)]
        edges = np.flatnonzero(np.diff(word, prepend=-1))
        back[word[edges]] += np.add.reduceat(total, edges, axis=0)


def prepared(items: list[tuple], vectors: np.ndarray) -> list[dict]:
    """Items ``(item_id, text)`` by window length, with unit vectors; items without words are left out."""
    texts = pa.array([text or "" for _, text in items], pa.string())
    hashes, bounds = hashed_words(texts)
    rows, by_window = _with_zero(vectors), {}
    for i, (key, text) in enumerate(items):
        words = hashes[bounds[i] : bounds[i + 1]]
        if not len(words):
            continue
        window = SMALLEST_WINDOW
        while window < len(words):
            window *= 2
        vector = rows[buckets(words)].sum(0)
        answer = hashed_words(pa.array([answer_of(text)], pa.string()))[0]
        by_window.setdefault(window, []).append((key, words, answer, vector / max(float(np.linalg.norm(vector)), 1e-9)))
    return [
        {
            "window": window,
            "ids": [x[0] for x in found],
            "words": [x[1].tolist() for x in found],
            "answers": [x[2].tolist() for x in found],
            "vectors": np.stack([x[3] for x in found]).astype(np.float32),
        }
        for window, found in sorted(by_window.items())
    ]


def answer_of(text: str, least: int = 3) -> str:
    """What an item ends with: its last sentence or line, taken together with those before it until ``least`` words."""
    parts = [p for p in re.split(r"(?<=[.!?\n])\s+", text or "") if re.search(r"\w", p)]
    tail: list[str] = []
    while parts and len(" ".join(tail).split()) < least:
        tail.insert(0, parts.pop())
    return " ".join(tail)


def common_subsequence(places: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence of ``words`` and a pattern of ``size`` words whose ``places`` are bit masks
    by word (bit-parallel, one addition a word)."""
    full = (1 << size) - 1
    row = full
    for word in words:
        mask = places.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _places(words: list) -> dict:
    places: dict = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | (1 << i)
    return places


def signatures(classes: list[dict], vectors: np.ndarray, least_lcs: float) -> dict:
    """Words that no stretch can lack that passes the check, as postings from words to items.

    ``need`` of an item's words must stand in a stretch in order, so at most the others are missing.  Of its rarest words, taken
    until they are ``few`` more than may be missing, at least ``few`` are then in the stretch, whatever the rest is.
    """
    weight, postings, few, span = np.linalg.norm(vectors, axis=1), [], [], []
    items = [(kind, which) for kind, x in enumerate(classes) for which in range(len(x["ids"]))]
    for number, (kind, which) in enumerate(items):
        words = classes[kind]["words"][which]
        need = max(1, math.ceil(least_lcs * len(words) - 1e-9))
        few.append(max(1, need // 3))
        span.append(math.ceil(STRETCH * len(words)))
        counts, left = Counter(words), len(words) - need + few[-1]
        for word in sorted(counts, key=lambda w: (-weight[w >> (64 - BUCKET_BITS)], w)):
            if left <= 0:
                break
            postings.append((word, number))
            left -= counts[word]
    postings.sort()
    words, first = np.unique(np.array([w for w, _ in postings], np.uint64), return_index=True)
    there = np.zeros(BUCKETS, bool)
    there[buckets(words)] = True
    return {
        "items": items,
        "few": np.array(few, np.int64),
        "span": np.array(span, np.int64),
        "words": words,
        "first": np.append(first, len(postings)),
        "of": np.array([i for _, i in postings], np.int64),
        "there": there,
    }


def _stretches(hashes: np.ndarray, bounds: np.ndarray, index: dict) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, from, to): words around every stretch that holds ``few`` signature words of an item."""
    if not len(index["words"]):
        return
    at = np.flatnonzero(index["there"][buckets(hashes)])
    word = np.minimum(np.searchsorted(index["words"], hashes[at]), len(index["words"]) - 1)
    same = index["words"][word] == hashes[at]
    at, word = at[same], word[same]
    count = index["first"][word + 1] - index["first"][word]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, at = index["of"][np.repeat(index["first"][word], count) + inner], np.repeat(at, count)
    order = np.argsort(item, kind="stable")
    item, at = item[order], at[order]
    doc = np.searchsorted(bounds, at, side="right") - 1
    last = np.arange(len(at)) + index["few"][item] - 1
    inside = np.minimum(last, len(at) - 1)
    span = index["span"][item]
    near = (last < len(at)) & (item[inside] == item) & (doc[inside] == doc) & (at[inside] - at < span)
    start, end = np.maximum(at[inside] - span + 1, bounds[doc]), np.minimum(at + span, bounds[doc + 1])
    held = None
    for i in np.flatnonzero(near).tolist():
        d, k, a, b = int(doc[i]), int(item[i]), int(start[i]), int(end[i])
        if held and held[:2] == (d, k) and b - held[2] <= 3 * span[i]:
            held = d, k, min(a, held[2]), max(b, held[3])
            continue
        if held:
            yield held
        held = d, k, a, b
    if held:
        yield held


def _best_stretch(checks: tuple, words: list, span: int, least_lcs: float, least_answer: float):
    """(share in order, share of the answer, first word, end) of the stretch of ``span`` words with the most in order."""
    places, size, answer_places, answer_size = checks
    at = [i for i, w in enumerate(words) if w in places]
    if sum(places[w].bit_count() for w in {words[i] for i in at}) < least_lcs * size:
        return None
    if common_subsequence(places, size, words) < least_lcs * size:
        return None
    best = None
    for i in at:
        stretch = words[i : i + span]
        ratio = common_subsequence(places, size, stretch) / size
        if ratio >= least_lcs and (best is None or ratio > best[0]):
            answer = common_subsequence(answer_places, answer_size, stretch) / max(1, answer_size)
            if answer >= least_answer or not answer_size:
                best = ratio, answer, i, i + len(stretch)
                if ratio == 1:
                    break
    return best


def found_in(batch, classes, masks, index, rows, least_cosine, least_lcs, least_answer) -> list[tuple]:
    """``doc_id, item_id`` and what ``FOUND`` names, for a batch of ``doc_id, text``."""
    hashes, bounds = hashed_words(batch.column("text"))
    if not len(hashes):
        return []
    sums, first = _unit_sums(hashes, bounds, rows)
    best: dict = {}
    for kind, checks in zip(classes, masks):
        step, window = kind["window"] // 4 // UNIT, kind["window"]
        for where, which, cosine in _near(sums, step, kind["vectors"], least_cosine):
            places, size, answer_places, answer_size = checks[which]
            from_unit, to_unit = where * step, min((where + 4) * step, len(sums))
            doc = int(np.searchsorted(first, from_unit, side="right")) - 1
            while doc < batch.num_rows and first[doc] < to_unit:
                start, end = bounds[doc], bounds[doc + 1]
                a = max(start, start + (from_unit - first[doc]) * UNIT - window // 2)
                b = min(end, start + (to_unit - first[doc]) * UNIT + window // 2)
                words = hashes[a:b].tolist()
                shared = sum(places[w].bit_count() for w in places.keys() & set(words))  # no subsequence is longer
                ratio = common_subsequence(places, size, words) / size if shared >= least_lcs * size else 0.0
                if ratio >= least_lcs and ratio > best.get((doc, kind["ids"][which]), (0, 0))[1]:
                    answer = common_subsequence(answer_places, answer_size, words) / max(1, answer_size)
                    if answer >= least_answer or not answer_size:
                        best[doc, kind["ids"][which]] = cosine, ratio, answer, int(a - start)
                doc += 1
    for doc, number, a, b in _stretches(hashes, bounds, index):
        kind, which = index["items"][number]
        key = doc, classes[kind]["ids"][which]
        held = best.get(key, (0, 0))[1]
        found = held < 1 and _best_stretch(
            masks[kind][which], hashes[a:b].tolist(), int(index["span"][number]), least_lcs, least_answer
        )
        if found and found[0] > held:
            ratio, answer, begin, end = found
            vector = rows[buckets(hashes[a + begin : a + end])].sum(0)
            cosine = float(vector @ classes[kind]["vectors"][which]) / max(float(np.linalg.norm(vector)), 1e-9)
            best[key] = cosine, ratio, answer, int(a + begin - bounds[doc])
    keys = batch.column("doc_id").to_pylist()
    return [(keys[doc], item, *found) for (doc, item), found in best.items()]


def _near(sums: np.ndarray, step: int, vectors: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """Windows of four steps, one step apart, and the items that are near enough."""
    whole = -(-len(sums) // step)
    padded = np.zeros((whole + 3, sums.shape[1]), np.float32)
    for k in range(step):
        part = sums[k::step]
        padded[: len(part)] += part
    for at in range(0, whole, _ROWS_AT_ONCE):
        part = padded[at : at + _ROWS_AT_ONCE + 3]
        windows = part[:-3] + part[1:-2]
        windows += part[2:-1]
        windows += part[3:]
        # products against the least cosine times the length, so that windows need not be made as long as one
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)
        products = windows @ vectors.T
        hits = np.flatnonzero(products >= np.float32(least) * length[:, None])
        where, which = np.divmod(hits, products.shape[1])
        cosines = products.ravel()[hits] / length[where]
        yield from zip((where + at).tolist(), which.tolist(), cosines.tolist())


def search(
    docs: DataFrame,
    items: list[tuple],
    vectors: np.ndarray,
    least_cosine: float = 0.55,
    least_lcs: float = 0.6,
    least_answer: float = 0.5,
    item_type: T.DataType = T.LongType(),
) -> DataFrame:
    """One row for each document and item that the document contains, exactly or paraphrased; written.

    Every window of every document is compared with the items of its length class in the latent space (windows as long as
    the class, a quarter of it apart).  Where the cosine reaches ``least_cosine``, the words around the window are checked: the
    longest common subsequence must hold ``least_lcs`` of the item's words and ``least_answer`` of its answer's.

    The cosine of a changed passage can be anything, so words lead to the same check as well: of all stretches of at most
    ``STRETCH`` times an item's length none that passes is missed (``signatures``).
    """
    classes = prepared(items, vectors)
    masks = [[(_places(w), len(w), _places(a), len(a)) for w, a in zip(c["words"], c["answers"])] for c in classes]
    index = signatures(classes, vectors, least_lcs)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", item_type), *FOUND.fields])
    target = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((classes, masks, index, _with_zero(vectors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, masks, index, rows = shared.value
        for batch in sliced(batches):
            found = found_in(batch, classes, masks, index, rows, least_cosine, least_lcs, least_answer)
            columns = list(zip(*found)) or [[]] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    found = staged(in_batches(docs.select("doc_id", "text"), run, schema), "contaminated")
    shared.destroy()
    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rank: int = 64, fit_docs: int | None = None, block_items: int = 4096, **thresholds
) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_ratio, answer_ratio, first_word`` for all of ``docs(doc_id, text)`` against all of
    ``benchmark(item_id, text)``.

    The benchmark is a query set: it is taken in blocks of about ``block_items`` items by a hash of the row, each compared
    with all documents in one pass, so that a task never holds more than a block.  Null or empty texts on either side
    match nothing; no items or no documents give no rows; repeated items are reported each, repeated documents too.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text").distinct()
    kind = benchmark.schema["item_id"].dataType
    blocks = max(1, math.ceil(benchmark.count() / block_items))
    words = counted(docs)
    vectors = latent_space(docs, inverse_frequencies(docs, words), rank, fit_docs=fit_docs, words=words)
    found = None
    for block in range(blocks):
        of_block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted(((r["item_id"], r["text"]) for r in of_block.collect()), key=repr)
        part = search(docs, items, vectors, item_type=kind, **thresholds)
        found = part if found is None else found.unionByName(part)
    return found
