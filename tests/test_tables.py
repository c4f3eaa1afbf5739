"""Stored tables that are changed in place."""

import os

import pytest
from pyspark.sql import functions as F

from clausewise.operators import tables


@pytest.fixture
def store(spark, tmp_path):
    made = tables.Store(spark, str(tmp_path), "t" + os.urandom(4).hex())
    made.create_all()
    docs = [(f"d{k}", f"s{k % 3}" if k % 7 else None, "t1" if k % 4 == 0 else "t2", None if k % 5 else "t3") for k in range(30)]
    rows = spark.createDataFrame(docs, "id string, session_id string, similar_id string, user_choice_doc_id string")
    made.insert("docs_inserted", rows)
    made.insert("docs_inserted_chunks", rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.col("id").alias("doc_id"), "session_id").withColumns({"chunk_id": F.concat_ws(":", "doc_id", "ord"), "text": F.concat_ws(" ", F.lit("text"), "doc_id")}))
    made.insert("templates", spark.createDataFrame([(f"t{k}", f"name {k}") for k in range(5)], "id string, name string"))
    made.insert("template_chunks", spark.createDataFrame([(f"t{k}:0", f"t{k}", 0, "x") for k in range(5)], "chunk_id string, template_id string, ord int, text string"))
    yield made
    made.drop()


def files(store, kind):
    return {os.path.relpath(os.path.join(d, f), store.path) for d, _, names in os.walk(f"{store.path}/{kind}") for f in names if f.endswith(".parquet")}


def state(store):
    return {kind: sorted(map(str, store.read(kind).drop("created_at").collect())) for kind in tables.KINDS}


def test_clearing_a_session_touches_its_partitions_alone(store):
    before = {k: files(store, k) for k in tables.KINDS}
    store.clear_session("s1")
    for kind, old in before.items():
        now = files(store, kind)
        assert now <= old and {os.path.dirname(f).split("/")[1] for f in old - now} == ({"session_id=s1"} if kind.startswith("docs") else set())
    assert store.read("docs_inserted", "s1").count() == 0 and store.read("docs_inserted").filter("session_id IS NULL").count() == 5
    once = state(store)
    store.clear_session("s1")
    store.clear_session("it's not there \\")
    assert state(store) == once


def test_a_session_is_read_by_partition(store):
    plan = store.read("docs_inserted", "s2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan and "= s2)" in plan


def test_a_choice_rewrites_one_partition(store):
    before, count = files(store, "docs_inserted"), store.read("docs_inserted").count()
    store.choose("s2", "d2", "t4")
    changed = before ^ files(store, "docs_inserted")
    assert {f.split("/")[1] for f in changed} == {"session_id=s2"} and store.read("docs_inserted").count() == count
    assert store.read("docs_inserted").filter("user_choice_doc_id = 't4'").select("id").collect() == [("d2",)]
    before = files(store, "docs_inserted")
    store.choose("s2", "nobody", "t4")
    store.choose("s1", "d2", "t4")
    assert files(store, "docs_inserted") == before


def test_a_change_that_failed_leaves_all_as_it_was_and_is_run_again(store, spark):
    before = state(store)

    @F.udf("string")
    def fails(x):
        raise RuntimeError("lost")

    texts = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, text string")
    with pytest.raises(Exception, match="lost"):
        store.replace_chunks("s2", "d2", texts.withColumn("text", fails("text")))
    assert state(store) == before
    store.replace_chunks("s2", "d2", texts)
    once = state(store)
    assert store.read("docs_inserted_chunks").filter("doc_id = 'd2'").orderBy("ord").select("chunk_id", "text").collect() == [("d2:0", "a"), ("d2:1", "b")]
    store.replace_chunks("s2", "d2", texts)
    assert state(store) == once


def test_deleting_a_template_takes_what_refers_to_it(store, spark):
    store.delete_template("t3")  # half done: the documents are gone, the template is not
    store.insert("templates", spark.createDataFrame([("t3", "again")], "id string, name string"))
    store.delete_template("t3")
    store.delete_template("t1")
    left = {r["id"] for r in store.read("docs_inserted").collect()}
    assert left == {f"d{k}" for k in range(30) if k % 5 and k % 4}
    assert {r["doc_id"] for r in store.read("docs_inserted_chunks").collect()} == left
    assert {r["id"] for r in store.read("templates").collect()} == {"t0", "t2", "t4"} == {r["template_id"] for r in store.read("template_chunks").collect()}


def test_stored_keys_are_not_inserted_again(store, spark):
    before = state(store)
    store.insert("docs_inserted", spark.createDataFrame([("d1", "s9"), ("d2", "s9")], "id string, session_id string"))
    assert state(store) == before
    store.insert("docs_inserted", spark.createDataFrame([("new", "s9"), ("new", "s8")], "id string, session_id string"))
    assert store.read("docs_inserted").filter("id = 'new'").count() == 1


def test_tables_are_found_again_by_a_session_that_does_not_know_them(store, spark):
    before = state(store)
    store.drop()
    assert not store.exists("docs_inserted") and store.columns("docs_inserted") == []
    again = tables.Store(spark, store.path, store.prefix)
    again.create_all()
    assert state(again) == before


def test_a_registered_table_is_brought_to_the_schema(spark, tmp_path):
    old = tables.Store(spark, str(tmp_path), "t" + os.urandom(4).hex())
    old.create("templates", "id string, name string, part int")
    old.insert("templates", spark.createDataFrame([("t1", "n")], "id string, name string"))
    assert "title" not in old.columns("templates")
    assert old.migrate("templates") == ["version", "created_at", "is_active", "embedding", "title", "title_emb"] and old.migrate("templates") == []
    old.insert("templates", spark.createDataFrame([("t2", "n", "T")], "id string, name string, title string"))
    assert sorted((r["id"], r["title"]) for r in old.read("templates").collect()) == [("t1", None), ("t2", "T")]
    old.drop()
