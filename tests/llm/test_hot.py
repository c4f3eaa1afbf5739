"""Joins by keys of which one holds most rows."""

import pytest
from pyspark.sql import functions as F

from clausewise.llm import graph, line_dedup, suffix_dedup


@pytest.mark.parametrize("rows", [[], [("a", 1)], [("hot", k) for k in range(6000)] + [(f"k{k}", k) for k in range(3000)] + [(None, 1), ("alone", 7)]])
def test_join_dealt_is_a_join(spark, rows):
    df = spark.createDataFrame(rows, "key string, x int")
    keyed = df.filter("key != 'alone'").groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    got = graph.join_dealt(df, keyed, keyed, ["key"], ["x"])
    want = df.join(keyed.drop("n"), "key")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_hot_key_goes_to_many_tasks(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("key"), F.col("id").alias("x"))
    keyed = df.groupBy("key").agg(F.count("*").alias("n"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = graph.join_dealt(df, keyed, keyed, ["key"], ["x"])
        per_task = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 20000 and len(per_task) == 8
    assert max(per_task) < 5000  # 13,334 rows have the hot key


def test_op5_hot_line_in_every_document(spark):
    rows = [(k, f"the line that all have\nown line of number {k * 7919} here\nthe line that all have") for k in range(3000)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 1 and len(got) == 3000 and all(n >= 2 for k, n in got.items() if k)


def test_op4_hot_passage_in_every_document(spark):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300))
    rows = [(k, f"{k * 7919}|{passage}|{k * 104729}") for k in range(1500)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1500
    for r in got:
        left = rows[r["doc_id"]][1]
        assert r["n_removed"] >= 302 and r["n_spans"] == 1 and len(left) - r["n_removed"] == len(bytes(r["kept"]))
