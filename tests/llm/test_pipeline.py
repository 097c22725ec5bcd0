from __future__ import annotations

import corpus_pipeline
from ledgerwise.llm import simhash
from test_simhash import plain_components, plain_fingerprint


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on all that its predecessor kept; which documents go is known from plain versions of the rules."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        assert docs.columns == columns or name == names[-1]
    original = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {i: x for i, x in original.items() if any(map(str.isalpha, x or ""))}
    assert {r["doc_id"] for r in kept["language_id"]} == set(known)
    groups = plain_components({i: plain_fingerprint(x) for i, x in known.items()})
    firsts = {i for i, g in groups.items() if i == g}
    assert {r["doc_id"] for r in kept["simhash_near_dedup"]} == firsts
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holding = {i for i in firsts if any(item in original[i] for item in items)}
    clean = {r["doc_id"] for r in kept["benchmark_decontamination"]}
    assert clean <= firsts - holding and len(firsts - holding - clean) <= 2
    assert {r["doc_id"] for r in kept["pii"]} == clean
    for r in kept["pii"]:
        assert r["n_chars"] == len(r["text"])
        assert "@" not in original[r["doc_id"]] or r["text"] != original[r["doc_id"]] or "@example" not in r["text"]
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == clean


def test_odd_rows_go_through(spark, odd, none, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.collect()} == {3, 4, 6, None}
        else:
            assert out.columns == docs.columns
            docs = out
        assert stage(spark, none, sf).collect() == []


def test_one_row_of_a_repeated_id_stays(odd, spark, sf):
    rows = corpus_pipeline.near_duplicate_stage(spark, odd, sf).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 3, 4, 6, 7]
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert simhash.fingerprint(None) == 0


ROW = "doc_id long, text string"
_TEXTS = [" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma", "delta", "omega")]


def test_groups_of_rows_whose_ids_repeat_or_lack(spark, sf):
    """Each group keeps one row, also where its ids stand in other groups, and copies without id are copies."""
    a, b, c, d, e = _TEXTS
    rows = [(3, a), (5, a), (5, b), (6, b), (7, c), (7, d), (None, e), (None, e), (None, a)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, ROW).repartition(3), sf).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted([(3, a), (5, b), (7, c), (7, d), (None, e)], key=repr)


def test_contaminated_rows_without_id_or_with_a_clean_ones_id_go(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    a, b, c = _TEXTS[:3]
    rows = [(1, a), (1, f"{b} {item} {b}"), (None, f"{c} {item} {c}"), (None, c)]
    out = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, ROW), sf).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(1, a), (None, c)}


def test_keys_of_rows_are_broadcast_only_while_few(spark, sf, monkeypatch):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    a, b, c = _TEXTS[:3]
    rows = [(1, a), (2, a), (None, f"{b} {item} {b}"), (2, f"{c} {item} {c}")]
    docs = spark.createDataFrame(rows, ROW)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2 and out.count() == 3
    for few, broadcast in ((1, False), (2, True)):
        monkeypatch.setattr(corpus_pipeline, "FEW_KEYS", few, raising=False)
        out = corpus_pipeline.decontamination_stage(spark, docs, sf)
        assert ("Broadcast" in out._jdf.queryExecution().executedPlan().toString()) == broadcast
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, a), (2, a)]
