from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerwise.llm import language_id
from ledgerwise.llm.common import fold


def test_held_out_accuracy(real):
    docs, _ = real
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    held_out = docs.where(fold(F.col("doc_id"), 3) == 1)
    rows = language_id.identify(held_out, model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_families_are_told_apart_first(real):
    docs, _ = real
    model = language_id.fit(docs)
    assert model["members"] == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model["pairs"]) == {("de", "en"), ("es", "fr")}


def test_odd_rows(real, odd, none):
    model = language_id.fit(real[0])
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == 10
    by_text = {r["text"]: r for r in rows}
    for text in (None, "", " \n\t ", "1234 !!! ???"):
        assert (by_text[text]["lang_pred"], by_text[text]["score"]) == ("und", 0.0)
    copies = {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (4, 5)}
    assert len(copies) == 1
    assert language_id.identify(none, model).collect() == []
    untaught = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, untaught).collect()} == {"und"}
    one = language_id.fit(odd.where("lang = 'en' and doc_id = 3"))
    assert language_id.predict(language_id.features("words"), one) == ("en", 1.0)


def test_long_text_is_read_to_its_end():
    a, b = language_id.features("the " * 50_000), language_id.features("the " * 50_000 + "zz " * 50_000)
    assert not np.array_equal(a, b)


def test_names_that_differ_in_case_only(spark, real):
    docs = real[0].limit(5).withColumn("Score", F.lit("x")).withColumn("LANG_PRED", F.lit("y"))
    made = language_id.identify(docs, language_id.fit(real[0]))
    assert [c for c in made.columns if c.lower() in ("score", "lang_pred")] == ["lang_pred", "score"]
    assert {type(r["score"]) for r in made.collect()} == {float}
