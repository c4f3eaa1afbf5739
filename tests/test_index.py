"""The approximate index and matching in blocks against exact search."""

import os

import numpy as np
import pytest

from clausewise.operators import ivf
from clausewise.operators import match as M

VECTORS = "id string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of unequal size, of which one has a third of all rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    own = np.where(rng.random(1500) < 0.33, 0, rng.integers(30, size=1500))
    x = centres[own] + 0.4 * rng.normal(size=(1500, 16))
    rows = [(f"v{k}", v.tolist()) for k, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 16), ("short", [1.0]), ("nan", [float("nan")] * 16), ("hole", [None] * 16)]
    return spark.createDataFrame(rows, VECTORS).repartition(4).cache()


def ranked(df):
    return sorted((r["id"], r["template_id"], round(r["similarity"], 9), r["rank"]) for r in df.collect())


def test_all_lists_give_what_exact_search_gives(spark, vectors, tmp_path):
    ivf.build(vectors, str(tmp_path), lists=20)
    asked = vectors.filter("hash(id) % 7 = 0 OR id IN ('none', 'zero', 'short', 'nan')")
    exact = ranked(M.nearest(asked, vectors, 4, -1.0))
    assert ranked(ivf.search(asked, str(tmp_path), 4, -1.0, probes=20)) == exact
    assert ranked(ivf.search(asked, str(tmp_path), 4, -1.0, probes=20, block_rows=40)) == exact


def test_default_probes_read_few_lists_and_find_nine_of_ten(spark, vectors, tmp_path):
    ivf.build(vectors, str(tmp_path), lists=20)
    asked = vectors.filter("hash(id) % 5 = 0")
    found = ivf.search(asked, str(tmp_path), 10)
    assert ivf.recall(M.nearest(asked, vectors, 10, 0.0), found).first()["recall"] >= 0.9
    assert spark.read.parquet(f"{tmp_path}/centroids").first()["probes"] < 10


def test_a_search_reads_the_probed_lists_alone(spark, vectors, tmp_path):
    ivf.build(vectors, str(tmp_path), lists=20)
    plan = ivf.search(vectors.filter("id = 'v3'"), str(tmp_path), 2, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "[list") or "list#" in plan.split("PartitionFilters")[1][:80]
    assert len([d for d in os.listdir(tmp_path / "lists") if d.startswith("list=")]) == 21  # that of rows without a direction too


def test_indexes_of_nothing_and_of_copies(spark, vectors, tmp_path):
    ivf.build(vectors.limit(0), str(tmp_path / "a"))
    assert ivf.search(vectors, str(tmp_path / "a"), 3).count() == 0
    ivf.build(spark.createDataFrame([(f"c{k}", [1.0, 1.0]) for k in range(20)], VECTORS), str(tmp_path / "b"), lists=5)
    got = ranked(ivf.search(spark.createDataFrame([("q", [2.0, 2.0])], VECTORS), str(tmp_path / "b"), 3))
    assert [x[1] for x in got] == ["c0", "c1", "c10"]


@pytest.mark.parametrize("rows", [7, 100, 10_000])
def test_blocks_of_any_size_match_like_a_library_that_is_sent(spark, vectors, rows):
    from pyspark.sql import functions as F

    other = vectors.select(F.concat(F.lit("t"), "id").alias("id"), "embedding", F.when(F.hash("id") % 3 > 0, F.reverse("embedding")).alias("title_emb"))
    library = other.filter("hash(id) % 9 = 0")
    docs = other.filter("hash(id) % 4 = 0")
    whole = M.match(docs, library, k=3, threshold=0.1).collect()
    parts = M.match(docs, library, k=3, threshold=0.1, block_bytes=0, block_rows=rows).collect()
    short = lambda found: sorted((r["id"], r["template_id"], round(r["score"], 9), round(r["title_score"], 9), r["rank"]) for r in found)
    assert short(parts) == short(whole) and len(whole) > 500


def test_ties_go_to_the_lesser_id_whatever_k(spark):
    docs = spark.createDataFrame([("d", [1.0, 0.0])], VECTORS).selectExpr("*", "CAST(NULL AS ARRAY<DOUBLE>) AS title_emb")
    library = spark.createDataFrame([(f"t{k}", [1.0, 0.0] if k % 2 else [1.0, 1.0]) for k in range(9)], VECTORS).selectExpr("*", "CAST(NULL AS ARRAY<DOUBLE>) AS title_emb")
    for k in range(1, 10):
        got = [r["template_id"] for r in M.match(docs, library, k=k, threshold=float("-inf")).orderBy("rank").collect()]
        assert got == ["t1", "t3", "t5", "t7", "t0", "t2", "t4", "t6", "t8"][:k]
