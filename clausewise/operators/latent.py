"""Dense text vectors: latent semantic components by a randomised singular value decomposition of the TF-IDF matrix.

The matrix is a table of sparse rows. A step multiplies it with a thin matrix and back, each task
on its own rows, and sums what the tasks have by blocks of terms; the driver only ever holds
terms x components numbers, and factorises those. Steps go on until the values stand still. The model
is the terms, their weights and a projection; to encode is one product a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import tfidf

#: Components that are carried beside those that are asked for, most steps, the change of values at which steps end, and terms of a block.
EXTRA, STEPS, STILL, BLOCK = 10, 12, 1e-3, 64


@dataclass(frozen=True)
class Encoder:
    """components: terms x components with orthonormal columns; values: the singular values of the fitted matrix, largest first."""

    model: tfidf.Model
    components: np.ndarray
    values: np.ndarray

    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """df with unit vectors of a text column; texts without a term of the model have zero vectors."""
        return tfidf.transform(df, text, out, self.model, self.components)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(spark, f"{path}/terms")
        rows = [(k, float(v), c.tolist()) for k, (v, c) in enumerate(zip(self.values, self.components.T, strict=True))]
        spark.createDataFrame(rows, "k int, value double, component array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/components")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(f"{path}/components").orderBy("k").collect()  # as many as there are components
        model = tfidf.Model.load(spark, f"{path}/terms")
        return Encoder(model, np.array([r["component"] for r in rows]).reshape(len(rows), len(model.terms)).T, np.array([r["value"] for r in rows]))


def _sparse(docs: DataFrame, model: tfidf.Model) -> DataFrame:
    """idx, val: the terms that each row has, and their weights; rows without any are left out. Written, as every step reads them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, tfidf.BLOCK):
                x = sent.value.rows(b.column(0), at, min(at + tfidf.BLOCK, b.num_rows))
                x = x[x.any(1)]
                row, col = np.nonzero(x)
                ends = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x[row, col]))], ["idx", "val"])

    path = scratch.folder(docs.sparkSession, "matrix")
    docs.select(tfidf.terms(F.coalesce("text", F.lit(""))).alias("terms")).mapInArrow(rows, "idx array<int>, val array<double>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _there_and_back(matrix: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'(A q) for the sparse rows A; q has terms x a few columns."""
    sent = matrix.sparkSession.sparkContext.broadcast(q)
    height, width = q.shape

    def multiply(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total, some = sent.value, np.zeros((height, width)), False
        for b in source:
            for at in range(0, b.num_rows, tfidf.BLOCK):
                part = b.slice(at, tfidf.BLOCK)
                size = np.diff(part.column("idx").offsets.to_numpy())
                x = np.zeros((part.num_rows, height))
                x[np.repeat(np.arange(part.num_rows), size), part.column("idx").flatten().to_numpy()] = part.column("val").flatten().to_numpy()
                total += x.T @ (x @ q)
                some = True
        for k in range(0, height if some else 0, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], ["at", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in parts.column("part"))
        return pa.table({"at": pa.array([parts.column("at")[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "at int, part binary"
    summed = matrix.mapInArrow(multiply, schema).groupBy("at").applyInArrow(add, schema).collect()  # terms x columns numbers in all
    out = np.zeros((height, width))
    for r in summed:
        out[r["at"] : r["at"] + BLOCK] = np.frombuffer(r["part"]).reshape(-1, width)
    return out


def fit(docs: DataFrame, components: int = 128, features: int = tfidf.FEATURES, key: str = "doc_id", steps: int = STEPS, still: float = STILL, seed: int = 7) -> Encoder:
    """An encoder from docs (key, text) of at most components components, and of no more than there are terms. A corpus without terms gives one
    that has no components."""
    if not 0 < components <= 1024:
        raise ValueError("components must be from 1 to 1024")
    model = tfidf.fit(docs, features, key)
    height = len(model.terms)
    wanted, width = min(components, height), min(components + EXTRA, height)
    if not height:
        return Encoder(model, np.zeros((0, 0)), np.zeros(0))
    matrix = _sparse(docs, model)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(height, width)))
    before = np.zeros(wanted)
    for _ in range(steps):
        product = _there_and_back(matrix, q)
        small = q.T @ product
        square, turn = np.linalg.eigh((small + small.T) / 2)
        values, vectors = np.sqrt(np.clip(square[::-1], 0, None)), q @ turn[:, ::-1]
        if np.abs(values[:wanted] - before).max() <= still * max(values[0], 1e-300):
            break
        before = values[:wanted]
        q, _ = np.linalg.qr(product)
    vectors = vectors[:, :wanted]
    heavy = vectors[np.abs(vectors).argmax(0), np.arange(wanted)]
    return Encoder(model, vectors * np.where(heavy < 0, -1, 1), values[:wanted])
