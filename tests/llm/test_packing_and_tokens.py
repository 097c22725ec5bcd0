from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerwise.llm import packing, token_counts
from ledgerwise.llm.packing import OpenBins
from ledgerwise.llm.tokens import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(tokenizer_path())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(reference, real):
    rng = random.Random(5)
    signs = [chr(i) for i in range(1, 0x250)]
    texts = list(real[1].values())[:60]
    texts += ["".join(rng.choice(signs) for _ in range(40)) for _ in range(500)]
    texts += ["".join(rng.choice("abc'sdtlm RVE  !?1é\n") for _ in range(60)) for _ in range(500)]
    texts += ["it's I'LL we'Re", "<|endoftext|>x", "a\x1cb\x85c\xa0d", "汉字 🙂 á", "x y " * 300_000, "z" * 600_000 + " a", "", None]
    for text, ids in zip(texts, Encoder(tokenizer_path()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)


def test_pieces_of_one_hash_keep_their_own_ids(reference):
    """Words for which any polynomial hash modulo a power of two is the same, met together, apart, and after forgetting."""
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    texts = [f"{one} {other}", other, f"x {one}", f"{other} and {one} {one}", "short words only"]
    for order in (texts, texts[::-1]):
        encoder = Encoder(tokenizer_path())
        for text in order:
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference(text)
        encoder._forget()
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(order)] == list(map(reference, order))


def test_a_collision_is_seen_and_made_good(reference, monkeypatch):
    """Long pieces that all have one key."""
    encoder, keys = Encoder(tokenizer_path()), Encoder._keys

    def colliding(self, raw, starts, ends):
        found = keys(self, raw, starts, ends)
        found[ends - starts > 7] = np.uint64(255 << 56) + np.uint64(5)
        return found

    monkeypatch.setattr(Encoder, "_keys", colliding)
    texts = ["the conversation went on", "conversation", "the constitution of it", "constitution conversation", "constitution"]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference(text)


def test_what_is_remembered_is_small(reference):
    """Bytes that a remembered piece takes, and pieces remembered over several texts and met again."""
    encoder, rng = Encoder(tokenizer_path()), random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 14))) for _ in range(30_000)]
    words += [f"{w}{i}" for i, w in enumerate(words[:20])] + ["conversation", "conversations"]
    encoder.encode([" ".join(words[:20_000])])
    tracemalloc.start()
    encoder.encode([" ".join(words)])
    encoder._forget()
    before, distinct = tracemalloc.get_traced_memory()[0], len(set(words))
    encoder.encode([" ".join(words)])
    taken = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert taken / distinct < 120
    for text in (" ".join(words[10_000:10_400]), " ".join(words[-22:]), "a b conversation", "conversations"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference(text)


def test_fill_holds_for_many_pieces(spark, real):
    """Far more pieces than there are open bins."""
    lengths = [r["length"] for r in packing.token_pieces(real[0], 2048).select("length").collect()]
    many = 300_000
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice(lengths)) for i in range(many)], "id long, length long").repartition(1)
    total = df.groupBy().sum("length").first()[0]
    placed = packing.place(df.selectExpr("*", "xxhash64(id) as turn").sortWithinPartitions("turn"), 2048, 1024)
    sequences, widest = placed.groupBy("sequence_id").sum("length").selectExpr("count(*)", "max(`sum(length)`)").first()
    assert widest <= 2048 and total / (sequences * 2048) >= 0.985


def test_repeated_rows_are_dealt_apart_and_text_ids_stay(spark, reference):
    text = "one text that is there many times"
    docs = spark.createDataFrame([("same id", text)] * 400, "doc_id string, text string").repartition(2)
    rows = packing.pack(docs, 64, per_task=50).collect()
    assert {r["doc_id"] for r in rows} == {"same id"} and len(rows) == 400
    check_packing(rows, [("same id", text)] * 400, reference, 64)
    tasks = {r["sequence_id"] // packing.IDS_PER_TASK for r in rows}
    assert len(tasks) >= 6


def check_packing(rows, texts, reference, capacity):
    want = {}
    for key, text in texts:
        ids = np.array([*reference(text), 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.setdefault((key, piece), []).append((at, len(part), zlib.crc32(part.tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip_and_fill(real, reference):
    docs, texts = real
    rows = packing.pack(docs, 512).collect()
    used = check_packing(rows, texts.items(), reference, 512)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 512 + 1


def test_odd_rows_pack(odd, none, reference):
    rows = packing.pack(odd, 2048, per_task=3).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], reference, 2048)
    assert packing.pack(none).collect() == []


def test_best_fit_takes_the_fullest_bin_that_fits_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert bins.place(8) == (2, 0)  # bins 1 (5 free) and 2 (2 free) are open
    assert bins.place(7) == (3, 0)  # a third one: the fullest, 2, closes
    assert bins.place(2) == (3, 7) and bins.place(1) == (3, 9)
    assert bins.place(5) == (1, 5)


def test_histogram_answers_limits(spark, real, odd, none, reference):
    docs, texts = real
    lengths = [len(reference(x)) for x in texts.values()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs)).cache()
    for r in sums.collect():
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["kept_tokens"] == sum(min(x, n) for x in lengths)
        assert r["rank"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.at_limits(sums, [1, 512, 2048, 10**6]).collect():
        limit = r["context_limit"]
        assert r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["kept_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["cut_tokens"] == sum(max(0, x - limit) for x in lengths)
    middle = token_counts.quantile(sums, 0.5).first()["length"]
    assert middle == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert sum(r["n_docs"] for r in token_counts.histogram(odd).collect()) == 10
    empty = token_counts.suffix_sums(token_counts.histogram(none))
    assert empty.collect() == [] and token_counts.quantile(empty, 0.5).first()["length"] is None
    assert token_counts.at_limits(empty, [5]).collect()[0]["kept_tokens"] == 0
