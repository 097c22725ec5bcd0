from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import D, concept, concepts, document, documents, movement, movements
from ledgerwise.contracts import MOVEMENT_KEY
from ledgerwise.operators import enrich as en
from ledgerwise.operators import keyed as k
from ledgerwise.operators.ranking import keep_last
from ledgerwise.sources import store
from ledgerwise.shared import new_path

KEY = ("fecha", "unique_concept", "cargo", "abono", "file_name")


def run_ts():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")


def test_repeated_parents_do_not_multiply_rows(spark, rows):
    df = spark.createDataFrame([(1, "a")], "id int, g string")
    parents = spark.createDataFrame([("a", "b"), ("a", "b")], "g string, new_g string")
    assert rows(k.rename_cascade(df, parents, ["g"])) == [(1, "b")]
    assert rows(k.delete_set_null(df, parents.select("g"), ["g"])) == [(1, None)]


def test_keep_last_counts_nulls_as_equal(spark, rows):
    df = movements(
        spark,
        movement("2024-03-01", "1", "5", None, file_name="a"),
        movement("2024-03-01", "1", "5", None, file_name="b"),
        movement("2024-03-01", "1", None, "5", file_name="c"),
        movement("2024-03-01", "1", None, None, file_name="d"),
    )
    assert rows(keep_last(df, MOVEMENT_KEY, ["file_date", "file_name"]), "file_name") == [("b",), ("c",), ("d",)]


def test_upsert_replaces_or_ignores(spark, rows):
    target = movements(spark, movement("2024-03-01", "1", "5"), movement("2024-03-02", "2", None, "7"))
    source = movements(
        spark, movement("2024-03-02", "2", None, "7", file_name="new"), movement("2024-03-03", "3", file_name="new")
    )
    assert [r[1] for r in rows(k.upsert(target, source), "unique_concept", "file_name")] == ["2024-03 0639.csv", "new", "new"]
    kept = rows(k.upsert(target, source, on_conflict="ignore"), "unique_concept", "file_name")
    assert [r[1] for r in kept] == ["2024-03 0639.csv", "2024-03 0639.csv", "new"]


movement_rows = st.lists(
    st.tuples(
        st.sampled_from(["2024-03-01", "2024-04-02"]), st.sampled_from(["1", "2"]), st.sampled_from([None, "1", "2"]),
        st.sampled_from([None, "1"]), st.sampled_from(["a", "b", "c"]),
    ),
    max_size=12,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(movement_rows, movement_rows)
def test_writes_against_brute_force(spark, rows, old, new):
    def frame(values):
        return movements(spark, *[movement(*v[:4], file_name=v[4]) for v in values])

    target = {v[:4]: v for v in sorted(old, key=repr)}
    source = {}
    for v in sorted(new, key=lambda v: v[4]):
        source[v[:4]] = v
    stored = frame(target.values())
    unique = keep_last(frame(new), MOVEMENT_KEY, ["file_name"])
    once = k.upsert(stored, unique)
    as_rows = lambda values: rows(frame(values), *KEY)
    assert rows(once, *KEY) == as_rows((target | source).values())
    assert rows(k.upsert(once, unique), *KEY) == rows(once, *KEY)
    assert rows(k.upsert(stored, unique, on_conflict="ignore"), *KEY) == as_rows((source | target).values())

    held, added = {v[:4] for v in old}, []
    for name in sorted({v[4] for v in new}):
        fresh = [v for v in new if v[4] == name and v[:4] not in held]
        added += fresh
        held |= {v[:4] for v in fresh}
    appended = k.append_new(frame(old), frame(new), MOVEMENT_KEY)
    assert rows(appended, *KEY) == as_rows(old + added)
    assert k.append_new(appended, frame(new), MOVEMENT_KEY).count() == appended.count()

    counters = {r["action"]: r["n_keys"] for r in k.load_counters(stored, unique).collect()}
    assert counters.get("updated", 0) == len(target.keys() & source.keys())
    assert counters.get("inserted", 0) == len(source.keys() - target.keys())
    assert counters.get("untouched", 0) == len(target.keys() - source.keys())


def test_rejects(spark, rows):
    df = movements(spark, movement(None, "1"), movement("2024-03-01", None), movement("2024-03-01", "1"))
    assert rows(k.rejected(df), "missing") == [("fecha",), ("unique_concept",)]
    assert k.loadable(df).count() == 1


def test_insert_ignore_twice(spark, rows):
    known = spark.createDataFrame([("a", "x")], "grp string, sub string")
    more = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), (None, "z")], "grp string, sub string")
    once = k.insert_ignore(known, more, ["grp", "sub"])
    assert rows(once) == [("a", "x"), ("a", "y"), (None, "z")]
    assert rows(k.insert_ignore(once, more, ["grp", "sub"])) == rows(once)


def test_classification_touches_all_amounts_of_the_key(spark, rows):
    table = concepts(
        spark, concept("2024-03-01", "1", "5", beneficiario="old"), concept("2024-03-01", "1", None, "6"), concept("2024-03-02", "1", "5")
    )
    edits = spark.createDataFrame(
        [(D("2024-03-01"), "1", "G", "S", "", 1), (D("2024-03-01"), "1", "G", "T", "", 2), (D("2024-03-02"), "1", "", "S", "b", 3)],
        "fecha date, unique_concept string, category_group string, category_subgroup string, beneficiario string, n int",
    )
    got = rows(k.classify(table, edits, ["n"]), "fecha", "category_group", "category_subgroup", "beneficiario")
    assert got == [(D("2024-03-01"), "G", "T", None)] * 2 + [(D("2024-03-02"), None, None, None)]


def test_referential_actions(spark, rows):
    child = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, None, 3), ("b", "y", 4)], "g string, s string, n int")
    renames = spark.createDataFrame([("a", "x", "A", "X")], "g string, s string, new_g string, new_s string")
    gone = spark.createDataFrame([("b", "y")], "g string, s string")
    assert rows(k.rename_cascade(child, renames, ["g", "s"]))[0] == ("A", "X", 1)
    assert k.rename_cascade(child, renames, ["g", "s"]).count() == 4
    assert rows(k.delete_set_null(child, gone, ["g", "s"]).filter("n = 4")) == [(None, None, 4)]
    assert rows(k.delete_cascade(child, gone, ["g", "s"]), "n") == [(1,), (2,), (3,)]


def test_document_upsert_sets_only_what_is_there(spark, rows):
    stored = documents(spark, document("2024-01", "1", pdf_file=b"old", csv_file=b"csv"), document("2024-02", "1", pdf_file=b"two"))
    incoming = documents(spark, document("2024-01", "1"), document("2024-02", "1", pdf_file=b"new"), document("2024-03", "1"))
    got = rows(k.document_upsert(stored, incoming), "cutoff_period", "pdf_file", "csv_file")
    assert got == [("2024-01", b"old", b"csv"), ("2024-02", b"new", None), ("2024-03", None, None)]


def test_document_attach_never_inserts(spark, rows):
    stored = documents(spark, document("2024-01", "1"), document("open", "1"))
    files = documents(spark, document("open", "1", csv_file=b"c", csv_filename="open_1_debit.csv"), document("2024-09", "1", pdf_file=b"p"))
    got = rows(k.document_attach(stored, files, run_ts()), "cutoff_period", "csv_file", "csv_filename")
    assert got == [("2024-01", None, None), ("open", b"c", "open_1_debit.csv")]
    assert rows(k.unmatched_files(stored, files), "cutoff_period") == [("2024-09",)]


def test_sync_takes_estado_only_and_open_wins(spark, rows):
    accounts = spark.createDataFrame([("0639", "debit"), ("77", "credit"), ("77", "debit")], "account_number string, type string")
    known = concepts(spark, concept("2024-03-01", "1", "5", category_group="G", concepto="stored"), concept("2024-02-01", "9", "1"))
    loaded = movements(
        spark,
        movement("2024-03-01", "1", "5", estado="abierto", concepto="new"),
        movement("2024-03-01", "1", "5", concepto="new"),
        movement("2024-03-05", "2", None, "3", concepto="fresh", cuenta="77"),
        movement("2024-03-06", "3", cuenta="unknown"),
    )
    got = rows(en.sync_concepts(known, loaded, accounts, "debit", run_ts()), "unique_concept", "estado", "category_group", "concepto")
    assert got == [("1", "abierto", "G", "stored"), ("2", "cerrado", None, "fresh"), ("9", "cerrado", None, None)]
    ignored = en.ignored_movements(loaded, accounts, "credit")
    assert rows(ignored, "cuenta", "reason") == [("0639", "wrong type")] * 2 + [("unknown", "unknown account")]


def test_state_changes(spark, rows):
    before = movements(spark, movement("2024-03-01", "1", "5"), movement("2024-03-01", "2", None, "5", estado="abierto"))
    after = movements(spark, movement("2024-03-01", "1", "5"), movement("2024-03-01", "2", None, "5"), movement("2024-03-01", "3"))
    assert rows(en.state_changes(before, after), "unique_concept") == [("2",), ("3",)]


def test_null_safe_and_plain_enrichment(spark, rows):
    moves = movements(spark, movement("2024-03-01", "1", "5", "0"), movement("2024-03-01", "1", "5"), movement("2024-03-01", "1"))
    known = concepts(
        spark,
        concept("2024-03-01", "1", "5", "0", category_group="both"),
        concept("2024-03-01", "1", "5", category_group="one"),
        concept("2024-03-01", "1", category_group="none"),
    )
    assert rows(en.enrich(moves, known), "category_group") == [("both",), ("none",), ("one",)]
    assert rows(en.enrich(moves, known, null_safe=False), "category_group") == [("both",), (None,), (None,)]
    with_extra = known.withColumn("ubicacion", F.lit("here"))
    assert "ubicacion" in en.enriched_table(moves, with_extra).columns


def test_stored_upsert_rewrites_only_touched_months(spark, rows):
    path = new_path(spark, "test-upsert")
    store.overwrite_parts(movements(spark, movement("2024-03-01", "1", "5"), movement("2024-04-01", "2", "5")), path)
    before = {r[0] for r in spark.read.parquet(path).filter("part = '2024-03'").select("_metadata.file_name").collect()}
    source = movements(spark, movement("2024-04-01", "2", "5", file_name="new"), movement("2024-05-01", "3"), movement("2024-04-09", None))
    for _ in range(2):
        store.upsert_movements(source, path)
    assert rows(store.read_parts(spark, path), "unique_concept", "file_name") == [
        ("1", "2024-03 0639.csv"), ("2", "new"), ("3", "2024-03 0639.csv"),
    ]
    after = {r[0] for r in spark.read.parquet(path).filter("part = '2024-03'").select("_metadata.file_name").collect()}
    assert before == after
    store.upsert_movements(movements(spark), path)
    assert store.read_parts(spark, path).count() == 3
