"""Toxicity scores by logistic regression, trained with FTRL-proximal.

Features are hashes of words, of pairs of neighbouring words and of pairs of words with
one word between them, each counted once per text. Per-coordinate rates let rare
features learn fast, and the L1 term keeps all but a few thousand weights at zero, so
what is sent to the executors stays small whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops, graph

BITS = 20
#: The sample: so many labelled texts of either class at most, and of each so many distinct features (those with the least hashes).
TOXIC_TEXTS, OTHER_TEXTS, TEXT_FEATURES = 2500, 4000, 4096
#: Settings (l1, alpha) that are tried on a slice of the learning rows, one row in SLICE.
SETTINGS, SLICE = ((4.0, 0.4), (4.0, 1.5), (9.0, 0.4), (9.0, 1.5), (16.0, 0.4), (16.0, 1.5)), 4


@dataclass
class Model:
    index: np.ndarray  # of the features with a weight, sorted
    weight: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, pair and skip pair, with repeats."""
    words, before = bytesops.word_hashes(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    shift = np.uint64(64 - BITS)
    found, of = [words >> shift], [text]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        same = text[gap:] == text[:-gap]
        pair = bytesops.mix(words[:-gap] * np.uint64(salt) + words[gap:])[same]
        found.append(pair >> shift)
        of.append(text[gap:][same])
    return np.concatenate(of), np.concatenate(found).astype(np.int64)


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 4, alpha: float = 0.15, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0, seed: int = 3) -> Model:
    """texts: the distinct features of each; weights: the importance of each."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias, without penalty
    rng = np.random.default_rng(seed)

    def weight_of(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        w[-1] = -zi[-1] / ((beta + np.sqrt(n[i[-1]])) / alpha)
        return w

    full = [np.append(t, 1 << BITS) for t in texts]
    for _ in range(epochs):
        for k in rng.permutation(len(full)):
            i = full[k]
            w = weight_of(i)
            g = (sigmoid(w.sum()) - labels[k]) * weights[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight_of(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def total(model: Model, text: np.ndarray) -> float:
    """The sum of the weights of a text's distinct features."""
    at = np.minimum(np.searchsorted(model.index, text), max(len(model.index) - 1, 0))
    return float(model.weight[at[model.index[at] == text]].sum() + model.bias) if len(model.index) else model.bias


def choose(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, held: np.ndarray) -> Model:
    """The model of all texts by the setting that has the least loss on the held ones when it learns from the others. Its
    bias is moved so that a score of 0.5 is where the held texts part best (by the balance of precision and recall)."""
    if not (labels[held].any() and labels[~held].any() and (labels[held] == 0).any() and (labels[~held] == 0).any()):
        return train(texts, labels, weights)
    some, rest = np.flatnonzero(held), np.flatnonzero(~held)
    tried = []
    for l1, alpha in SETTINGS:
        model = train([texts[k] for k in rest], labels[rest], weights[rest], l1=l1, alpha=alpha)
        s = np.array([total(model, texts[k]) for k in some])
        loss = np.average(np.logaddexp(0, np.where(labels[some] == 1, -s, s)), weights=weights[some])
        tried.append((loss, l1, alpha, s))
    _, l1, alpha, s = min(tried, key=lambda x: x[0])
    y, w = labels[some], weights[some]
    shifts = np.arange(0.0, 3.01, 0.25)
    balance = [2 * w[(s + x >= 0) & (y == 1)].sum() / max(1e-9, w[s + x >= 0].sum() + w[y == 1].sum()) for x in shifts]
    shift = shifts[int(np.flatnonzero(np.array(balance) >= max(balance) - 0.01)[0])]
    model = train(texts, labels, weights, l1=l1, alpha=alpha)
    return Model(model.index, model.weight, model.bias + float(shift))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, toxic_texts: int = TOXIC_TEXTS, other_texts: int = OTHER_TEXTS) -> Model:
    """Train on the documents of labels (doc_id, toxic) for which learn (a condition on doc_id) holds.

    The sample is bounded: toxic_texts and other_texts, those whose ids have the least hashes, of any length; the classes
    keep their true shares through importance weights. Settings and the place of 0.5 are chosen on a slice of the sample
    (by a checksum of the id). Labels other than 0 and 1 are left out, nulls too, and ids with several labels are toxic if any says so;
    of several texts of an id the one of the least hash teaches. With no labelled text the model scores everything 0.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic + other:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    able = known.join(docs.select("doc_id").distinct(), "doc_id").withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
    first = [able.filter(F.col("toxic") == k).orderBy("place", "doc_id").limit(most) for k, most in ((1, toxic_texts), (0, other_texts))]
    chosen = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1]).drop("place")), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def extract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                of, found = features(data, offsets)
                both = np.unique((of.astype(np.int64) << BITS) | found)  # features are hashes, so the first ones are as good as any
                cut = np.searchsorted(both >> BITS, np.arange(end - at + 1))
                both = both[np.arange(len(both)) - np.repeat(cut[:-1], np.diff(cut)) < TEXT_FEATURES]
                cut = np.searchsorted(both >> BITS, np.arange(end - at + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), b.column("toxic").slice(at, end - at), lists], ["doc_id", "toxic", "features"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("toxic", known.schema["toxic"].dataType), T.StructField("features", T.ArrayType(T.IntegerType()))])
    got = chosen.mapInArrow(extract, schema).toArrow().sort_by("doc_id")
    y = np.array(got.column("toxic").to_pylist(), np.float64)
    lists = got.column("features").combine_chunks()
    flat, cut = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    ratio = (other / max(1, (y == 0).sum())) / max(1e-9, toxic / max(1, (y == 1).sum())) if toxic and other else 1.0
    texts = [flat[a:b].astype(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
    held = np.array([zlib.crc32(f"slice {k}".encode()) % SLICE == 0 for k in got.column("doc_id").to_pylist()], bool)
    return choose(texts, y, np.where(y == 1, 1.0, ratio), held)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced.

    Whole texts are scored; null and empty ones by the bias alone. keep: the columns
    that are returned with them (all by default).
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")] if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    text = graph.unused(docs, "text")
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias(text))

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS, np.float32)
        weight[model.index] = model.weight
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column(text)):
                of, found = features(data, offsets)
                some = weight[found] != 0
                both = np.unique((of[some].astype(np.int64) << BITS) | found[some])
                total = np.bincount(both >> BITS, weight[both & ((1 << BITS) - 1)], end - at)
                value = sigmoid(total + model.bias)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, end - at) for c in keep], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(predict, schema)
