"""Fitted TF-IDF models and latent vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.functions import vector as V
from clausewise.operators import latent, tfidf
from clausewise.operators import match as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3).cache()


def dense(spark, docs, model):
    rows = tfidf.transform(docs, "text", "v", model).orderBy("doc_id").select("v").collect()
    return np.array([r["v"] for r in rows])


def test_a_model_gives_its_own_corpus_the_weights_of_the_corpus(spark, docs):
    model = tfidf.fit(docs, features=300)
    want = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.weights(docs, 300).collect()}
    got = {(r["doc_id"], model.terms[k]): w for r in tfidf.transform(docs, "text", "v", model).collect() for k, w in enumerate(r["v"]) if w}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_stored_model_drops_unknown_terms_and_keeps_its_weights(spark, tmp_path):
    first = spark.createDataFrame([(1, "red green green"), (2, "red blue"), (3, "red")], "doc_id int, text string")
    tfidf.fit(first).save(spark, str(tmp_path))
    model = tfidf.Model.load(spark, str(tmp_path))
    assert model.terms == ["blue", "green", "red"] and np.allclose(model.idf, [np.log(4 / 2) + 1, np.log(4 / 2) + 1, 1])
    later = spark.createDataFrame([(1, "green purple Purple"), (2, "purple"), (3, None), (4, "RED blue x")], "doc_id int, text string")
    got = [r["v"] for r in tfidf.transform(later, "text", "v", model).orderBy("doc_id").collect()]
    heavy = np.array([np.log(2) + 1, 0, 1]) / np.hypot(np.log(2) + 1, 1)
    assert np.allclose(got, [[0, 1, 0], [0, 0, 0], [0, 0, 0], heavy])


def test_fitted_on_templates_documents_are_matched(spark, docs):
    library = docs.filter("doc_id % 10 = 0")
    model = tfidf.fit(library, features=200)
    cast = F.col("doc_id").cast("string").alias("id")
    made = lambda df: tfidf.transform(df, "text", "v", model).select(cast, V.resize(F.col("v"), 256).alias("embedding"))
    found = {r["id"]: (r["template_id"], r["similarity"]) for r in M.nearest(made(docs), made(library), 1, 0.0).collect()}
    own = [r["doc_id"] for r in library.filter("length(text) > 200").collect()]
    assert all(found[str(k)][1] > 1 - 1e-9 for k in own)
    x, t = dense(spark, docs, model), dense(spark, library, model)
    assert np.allclose(sorted(s for _, s in found.values()), sorted((x @ t.T).max(1)[x.any(1)]), atol=1e-9)


def test_sparse_vectors_are_the_dense_ones(spark, docs):
    model = tfidf.fit(docs, features=200)
    more = docs.union(spark.createDataFrame([(-1, None), (-2, "!")], "doc_id bigint, text string"))
    want = {r["doc_id"]: {k: w for k, w in enumerate(r["v"]) if w} for r in tfidf.transform(more, "text", "v", model).collect()}
    for first in (None, 50):
        got = {r["doc_id"]: dict(zip(r["v"]["at"], r["v"]["of"], strict=True)) for r in tfidf.sparse(more, "text", "v", model, first).collect()}
        assert {k: {p for p in v if p < (first or 200)} for k, v in want.items()} == {k: set(v) for k, v in got.items()}
        assert all(abs(want[k][p] - w) < 1e-12 for k, v in got.items() for p, w in v.items())


def test_singular_values_are_those_of_the_whole_matrix(spark, docs):
    encoder = latent.fit(docs, components=20, features=150, steps=200, still=1e-12)
    x = dense(spark, docs, encoder.model)
    values = np.linalg.svd(x, compute_uv=False)[:20]
    assert np.abs(encoder.values - values).max() < 1e-6
    assert np.allclose(encoder.components.T @ encoder.components, np.eye(20), atol=1e-9)
    assert np.allclose(np.linalg.norm(x @ encoder.components, axis=0), values, atol=1e-6)


def test_an_encoder_is_stored_and_gives_unit_vectors(spark, docs, tmp_path):
    latent.fit(docs, components=16, features=400).save(spark, str(tmp_path))
    encoder = latent.Encoder.load(spark, str(tmp_path))
    rows = encoder.encode(docs, "text", "v").orderBy("doc_id").collect()
    x = dense(spark, docs, encoder.model)
    size = np.linalg.norm([r["v"] for r in rows], axis=1)
    assert encoder.components.shape == (len(encoder.model.terms), 16)
    assert np.allclose(size, x.any(1)) and not encoder.encode(docs.limit(0), "text", "v").collect()
    want = x @ encoder.components
    assert np.allclose([r["v"] for r in rows], want / np.where(x.any(1), np.linalg.norm(want, axis=1), 1)[:, None], atol=1e-9)


def test_corpora_without_terms_and_with_few(spark):
    none = spark.createDataFrame([(1, None), (2, "a ! b")], "doc_id int, text string")
    assert [r["v"] for r in latent.fit(none).encode(none, "text", "v").collect()] == [[], []]
    few = spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "doc_id int, text string")
    assert latent.fit(few, components=1000).values.shape == (3,)
    with pytest.raises(ValueError, match="1024"):
        latent.fit(few, components=2000)
