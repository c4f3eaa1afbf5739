"""Matching in bounded memory and with bounded copies."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clausewise.operators import match as M

SIDE = "id string, embedding array<double>, title_emb array<double>"


def side(spark, name, n, seed, width=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 2, width))
    v[::7] = v[0]  # copies
    return spark.createDataFrame([(f"{name}{k}", None if k % 11 == 5 else v[k, 0].tolist(), None if k % 5 == 2 else v[k, 1].tolist()) for k in range(n)], SIDE)


def shown(found):
    return sorted((r["id"], r["template_id"], round(r["score"], 9), round(r["title_score"], 9), r["rank"]) for r in found.collect())


def lists(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def test_memory_of_a_match_does_not_grow_with_the_library():
    rng = np.random.default_rng(1)
    made = lambda n: pa.table({"id": pa.array([f"t{k:06d}" for k in range(n)]), "embedding": lists(rng.normal(size=(n, 4))), "title_emb": lists(rng.normal(size=(n, 4)))})
    held, docs = M._prepared(made(40_000), 4, 1), made(1024).to_batches()[0]
    tracemalloc.start()
    found = M._ranked(docs.column("id"), M._arrays(docs, 4), held, 1, 0.0, 0.7, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 1024 and peak < 100 << 20  # a matrix of all scores is 330 MB


def test_documents_are_sent_once_however_small_the_blocks(spark):
    docs, library = side(spark, "d", 60, 1), side(spark, "t", 40, 2)
    rows = M._placed(docs, library, 1).groupBy("asked").count().collect()
    assert {r["asked"]: r["count"] for r in rows}[True] == 60
    copies = {r["asked"]: r["count"] for r in M._placed(docs, library, 3).groupBy("asked").count().collect()}
    assert copies[True] == 60 * 3 and copies[False] == 40 * -(-2 * spark.sparkContext.defaultParallelism // 3)


@pytest.mark.parametrize("k", [1, 3])
def test_a_library_in_groups_matches_like_one_that_is_sent(spark, monkeypatch, k):
    docs, library = side(spark, "d", 90, 3), side(spark, "t", 70, 4)
    whole = shown(M.match(docs, library, k, -1.0))
    monkeypatch.setattr(M, "HELD_BYTES", 1000)
    assert shown(M.match(docs, library, k, -1.0, block_bytes=0, block_rows=4)) == whole and len(whole) > 80 * k


def test_many_nearly_equal_templates_are_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 50)
    rng = np.random.default_rng(5)
    t = np.array([1.0, 1.0, 1.0]) + rng.normal(size=(400, 3)) * 1e-5
    q = rng.normal(size=(20, 3))
    table = pa.table({"id": pa.array([f"t{k:03d}" for k in range(400)]), "embedding": lists(t), "title_emb": pa.nulls(400, pa.list_(pa.float64()))})
    asked = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(20)]), lists(q), pa.nulls(20, pa.list_(pa.float64()))], ["id", "embedding", "title_emb"])
    got = M._ranked(asked.column("id"), M._arrays(asked, 3), M._prepared(table, 3, 2), 2, float("-inf"), 1.0, 0.0, 64).to_pylist()
    score = (q / np.linalg.norm(q, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T
    want = [(str(k), f"t{j:03d}") for k in range(20) for j in np.argsort(-score[k])[:2]]
    assert [(r["id"], r["template_id"]) for r in got] == want


def test_sparse_vectors_match_as_dense_ones_and_are_written_as_they_are(spark, monkeypatch):
    """A text has few of a model's terms; a dense row of 1024 numbers was written for each of its copies."""
    from clausewise.operators import tfidf

    docs = spark.createDataFrame([(str(k), " ".join(f"word{(k * j) % 53}" for j in range(1, 2 + k % 9))) for k in range(120)], "id string, text string")
    library, model = docs.filter("id % 7 = 0"), tfidf.fit(docs, key="id")
    dense = M.nearest(tfidf.transform(docs, "text", "embedding", model), tfidf.transform(library, "text", "embedding", model), 2, 0.1)
    want = sorted((r["id"], r["template_id"], round(r["similarity"], 9)) for r in dense.collect())
    made = lambda df: tfidf.sparse(df, "text", "embedding", model)
    for held, most in ((M.HELD_BYTES, M.BLOCK_BYTES), (500, 0)):
        monkeypatch.setattr(M, "HELD_BYTES", held)
        got = M.nearest(made(docs), made(library), 2, 0.1, most)
        assert sorted((r["id"], r["template_id"], round(r["similarity"], 9)) for r in got.collect()) == want and len(want) > 150


def test_documents_without_direction_match_nothing_in_a_dealt_library(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD_BYTES", 1000)
    docs = spark.createDataFrame([("zero", [0.0] * 5, None), ("none", None, [1.0] * 5), ("nan", [float("nan")] * 5, None), ("good", [1.0] * 5, [0.0] * 5)], SIDE)
    library = side(spark, "t", 50, 6)
    sent = shown(M.match(docs, library, 1, -1.0))
    assert shown(M.match(docs, library, 1, -1.0, block_bytes=0)) == sent and [x[0] for x in sent] == ["good"]
