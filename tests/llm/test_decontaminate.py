from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerwise import shared
from ledgerwise.llm import decontaminate
from ledgerwise.llm.words import hashed_words


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate._places(a), len(a), b) == plain_subsequence(a, b)


def test_words_are_the_same_however_they_are_cut(real):
    texts = [*list(real[1].values())[:50], None, "", "A b", "a B.", "x" * 300_000, " .,"]
    hashes, bounds = hashed_words(pa.array(texts))
    for i, text in enumerate(texts):
        alone, _ = hashed_words(pa.array([text], pa.string()))
        assert np.array_equal(hashes[bounds[i] : bounds[i + 1]], alone)
    assert np.array_equal(hashed_words(pa.array(["A b"]))[0], hashed_words(pa.array(["a... B"]))[0])
    assert len(set(hashes.tolist())) > 1000


def test_planted_and_changed_passages_are_found(spark, real):
    """Recall against an exact search: every passage that stands in a document, and copies with words changed."""
    docs, texts = real
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng, changed = random.Random(4), {}
    for key, text in items[:20]:
        words = text.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 12)):
            words[at] = "changed"
        filler = list(texts.values())[key % 50].split()[:150]
        changed[10_000 + key] = (key, " ".join([*filler[:70], *words, *filler[70:]]))
    more = spark.createDataFrame([(i, text) for i, (_, text) in changed.items()], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(both, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    exact = {(i, key) for i, text in texts.items() for key, item in items if item in text}
    assert exact <= got
    assert sum((i, key) in got for i, (key, _) in changed.items()) >= 0.9 * len(changed)
    for r in found:
        assert r["lcs_ratio"] >= 0.6 and r["answer_ratio"] >= 0.5
    assert len(got - exact - {(i, key) for i, (key, _) in changed.items()}) <= 2
    again = decontaminate.contaminated(both, benchmark, block_items=7).collect()
    assert {(r["doc_id"], r["item_id"]) for r in again} == got


def test_odd_rows(spark, odd, none):
    schema = "item_id long, text string, doc_id string, score string"
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "the and of to " * 4, "", ""), (3, "the and of to " * 4, "", "")]
    items = spark.createDataFrame([*rows, (4, "nowhere to be seen in any document at all", "", "")], schema)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(3, 3)}
    assert decontaminate.contaminated(none, items).collect() == []
    assert decontaminate.contaminated(odd, items.where("false")).collect() == []


def test_answer_is_the_end_of_an_item():
    assert decontaminate.answer_of("What is it? A very long river.") == "A very long river."
    assert decontaminate.answer_of("What is it?\nYes.") == "What is it? Yes."
    assert decontaminate.answer_of("") == ""


def test_no_items_prepare_nothing():
    assert decontaminate.prepared([(1, None), (2, " ")], np.ones((decontaminate.BUCKETS, 4), np.float32)) == []


def test_recall_against_every_stretch(spark, real):
    """Items of awkward lengths with 60 to 100 per cent of their words left, between rare and between common words: what a
    subsequence search of every stretch finds is found."""
    docs, texts = real
    rng = random.Random(8)
    words = [w for x in texts.values() for w in (x or "").split() if w.isalpha()]
    common = [w for w, _ in Counter(words).most_common(60)]
    words = [f"term{k}" for k in range(5000)]
    items = [(k, " ".join(rng.sample(words, n))) for k, n in enumerate((17, 18, 20, 33, 34, 40) * 4)]
    rows = []
    for key, text in items:
        for share in (0.6, 0.7, 0.8, 0.9, 1.0):
            for around in (words, common):
                kept = text.split()
                for at in rng.sample(range(len(kept)), int((1 - share) * len(kept) + 1e-9)):
                    kept[at] = rng.choice(around)
                filler = [rng.choice(around) for _ in range(160)]
                rows.append((10_000 + len(rows), key, " ".join([*filler[:73], *kept, *filler[73:]])))
    more = spark.createDataFrame([(i, text) for i, _, text in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    found = decontaminate.contaminated(both, benchmark, fit_docs=20)  # a sample without most words, as of a large table
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    of_item, wanted = dict(items), set()
    for i, key, text in rows:
        item, answer, held = (
            hashed_words(pa.array([x]))[0].tolist() for x in (of_item[key], decontaminate.answer_of(of_item[key]), text)
        )
        for a in range(max(1, len(held) - len(item) + 1)):
            stretch = held[a : a + len(item)]
            if plain_subsequence(item, stretch) >= 0.6 * len(item):
                if plain_subsequence(answer, stretch) >= 0.5 * len(answer):
                    wanted.add((i, key))
                    break
    assert len(wanted) >= 0.9 * len(rows)
    assert wanted <= got


def test_ids_may_be_text(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon"
    docs = spark.createDataFrame([("d-1", f"before it {text} after it"), ("d-2", "nothing of it"), (None, text)], "doc_id string, text string")
    items = spark.createDataFrame([("item a", text), (None, "other words that stand nowhere else at all in here")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {("d-1", "item a"), (None, "item a")}


def test_document_frequencies_are_exact(real):
    """A word counts once a document, whichever documents are worked on together."""
    docs, texts = real
    counts = np.zeros(decontaminate.BUCKETS)
    for text in texts.values():
        hashes, _ = hashed_words(pa.array([text], pa.string()))
        counts[np.unique(decontaminate.buckets(hashes))] += 1
    want = np.log((1 + len(texts)) / (1 + counts)) + 0.05
    assert np.allclose(decontaminate.inverse_frequencies(docs), want, atol=1e-5)


def test_the_space_is_fitted_on_all_passages(spark, monkeypatch):
    """More documents than the space was once fitted on, against singular vectors of the whole matrix."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"topic{i % 5}word{k}" for k in range(50)], k=64)) for i in range(6000)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, "")], "doc_id long, text string")
    written = {}

    def staged(df, label):
        written[label] = shared.staged(df, label)
        return written[label]

    monkeypatch.setattr(decontaminate, "staged", staged)
    idf = decontaminate.inverse_frequencies(docs)
    vectors = decontaminate.latent_space(docs, idf, rank=5)
    found = decontaminate.buckets(hashed_words(pa.array(texts))[0]).reshape(-1, 32)
    held = [bytes(r["passages"]) for r in written["words"].where("passages is not null").collect()]
    assert b"".join(sorted(x[at : at + 64] for x in held for at in range(0, len(x), 64))) == b"".join(sorted(decontaminate._passages(x, 32).tobytes() for x in found))
    matrix = np.zeros((len(found), decontaminate.BUCKETS), np.float32)
    np.put_along_axis(matrix, found, idf[found], 1)
    used = np.flatnonzero(matrix.any(0))
    matrix = matrix[:, used] / np.linalg.norm(matrix, axis=1)[:, None]
    _, turn = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    want = turn[:, -5:] / np.linalg.norm(matrix @ turn[:, -5:], axis=0)
    got, want = (x / np.linalg.norm(x, axis=1)[:, None] for x in (vectors[used], want))
    assert np.allclose(got @ got.T, want @ want.T, atol=0.05)


def test_products_are_those_of_the_matrix():
    """Words that repeat in a passage, a last passage that is not full, no words at all."""
    rng = np.random.default_rng(6)
    idf, basis = (rng.random(decontaminate.BUCKETS) + 0.1).astype(np.float32), rng.standard_normal((decontaminate.BUCKETS, 5))
    for n in (0, 1, 31, 32, 4000, 50_021):
        found = np.sort(rng.integers(0, decontaminate.BUCKETS, n) % rng.integers(1, decontaminate.BUCKETS, n))
        rng.shuffle(found)
        want = np.zeros(basis.shape)
        for at in range(0, n, 32):
            words = np.unique(found[at : at + 32])
            row = idf[words] / np.linalg.norm(idf[words])
            want[words] += np.outer(row, row @ basis[words])
        back, rows = np.zeros(basis.shape, np.float32), decontaminate._with_zero((basis * idf[:, None]).astype(np.float32))
        passages = decontaminate._passages(found, 32)
        decontaminate._add_product(passages, rows, np.append(idf.astype(np.float64) ** 2, 0), back)
        assert np.allclose(back * idf[:, None], want, atol=1e-4)
