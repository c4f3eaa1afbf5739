"""An approximate index of vectors: an inverted file of lists around centroids.

Centroids are fitted by k-means on a bounded sample; every vector is put into the list of its
nearest centroid, and the index is a table partitioned by list. A search ranks the centroids for
each asked vector, reads only the lists that are probed (partition pruning) and ranks their vectors
exactly. With all lists probed the result is exact. How many lists a search probes by default is
chosen when the index is built, so that the sample's own neighbours are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import match as M

#: Fixed value: the number of lists of the stored tables' indexes.
LISTS = 100
#: Vectors of the sample that centroids are fitted on (those with the least hashes of their ids, over all rows), rounds of
#: k-means, neighbours and share of them that the default number of probes must find in the sample.
SAMPLE, ROUNDS, NEIGHBOURS, RECALL = 20_000, 25, 10, 0.97


def _units(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit rows of a sample; vectors without a direction, or of another width than the most frequent one, are left out."""
    rows = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").toArrow().column("embedding").combine_chunks()
    widths = np.array([len(x) for x in rows])
    if not len(widths):
        return np.zeros((0, 1))
    out, good = M._matrix(rows, int(np.bincount(widths).argmax()))
    return out[good]


def _k_means(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids by spherical k-means from rows that lie far apart; a list that empties keeps its centroid."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(7)
    chosen = [int(rng.integers(len(distinct)))]
    near = distinct @ distinct[chosen[0]]
    while len(chosen) < min(lists, len(distinct)):
        far = np.clip(1 - near, 0, None)
        chosen.append(int(rng.choice(len(distinct), p=far / far.sum())) if far.sum() > 0 else int(np.argmin(near)))
        near = np.maximum(near, distinct @ distinct[chosen[-1]])
    c = distinct[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        new = np.where(size > 0, total / np.where(size > 0, size, 1), c)
        if np.allclose(new, c):
            break
        c = new
    return c


def _probes(x: np.ndarray, c: np.ndarray, target: float) -> int:
    """The least number of lists in which the sample's rows find that share of their nearest neighbours in the sample."""
    asked = x[:: max(1, len(x) // 500)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : NEIGHBOURS + 1]
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # rank of each list
    own = np.argmax(x @ c.T, axis=1)
    needed = np.take_along_axis(place, own[near], 1) + 1
    return int(np.quantile(needed, target, method="higher"))


def build(vectors: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS, recall: float = RECALL) -> None:
    """Write the index of vectors (id, embedding) to path. Every row is in it, those without a direction in list -1, which
    no search reads. The table of centroids has the default number of probes."""
    spark = vectors.sparkSession
    x = _units(vectors, sample)
    c = _k_means(x, lists, rounds) if len(x) else np.zeros((0, 1))
    probes = _probes(x, c, recall) if len(x) else 0
    rows = [(k, v.tolist(), probes) for k, v in enumerate(c)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
    placed = _with_lists(vectors.select("id", "embedding"), c, 1).withColumn("list", F.coalesce(F.get("lists", F.lit(0)), F.lit(-1))).drop("lists")
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")  # long lists are split over files


def _with_lists(rows: DataFrame, c: np.ndarray, n: int) -> DataFrame:
    """rows (id, embedding) with the n lists of the nearest centroids; none without a direction."""
    sent = rows.sparkSession.sparkContext.broadcast(c)

    def near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in source:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, good = M._matrix(part.column("embedding"), c.shape[1])
                best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]
                lists = pa.array([row.tolist() if ok else [] for row, ok in zip(best, good, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), lists], ["id", "embedding", "lists"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("id", "embedding").mapInArrow(near, f"id string, embedding {kind}, lists array<int>")


def search(asked: DataFrame, path: str, k: int, threshold: float = 0.0, probes: int | None = None, block_rows: int = M.BLOCK_ROWS) -> DataFrame:
    """The k nearest vectors of an index for each asked one (id, embedding): id, template_id, similarity, rank, as
    match.nearest has them, from the probed lists. Long lists meet their asked vectors in blocks."""
    spark: SparkSession = asked.sparkSession
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # as many as there are lists
    if not centroids:
        return spark.createDataFrame([], "id string, template_id string, similarity double, rank int")
    c = np.array([r["centroid"] for r in centroids])
    n = min(len(c), centroids[0]["probes"] if probes is None else probes)
    cells = _with_lists(asked, c, n).select("id", "embedding", F.explode("lists").alias("cell"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row per list
    wanted = sorted(r["cell"] for r in counts)
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("list").isin(wanted))
    sizes = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = [(r["cell"], max(1, -(-r["n"] // block_rows)), max(1, -(-sizes.get(r["cell"], 1) // block_rows))) for r in counts]
    plan = F.broadcast(spark.createDataFrame(blocks, "cell int, doc_blocks bigint, blocks bigint"))  # a row per list
    plain = lambda df: df.join(plan, "cell").withColumn("title_emb", F.lit(None).cast("array<double>"))
    found = M.in_blocks(plain(cells), plain(lists.withColumnRenamed("list", "cell")), c.shape[1], k, threshold, 1.0, 0.0)
    return found.select("id", "template_id", F.col("score").alias("similarity"), "rank")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Of the exact neighbours (id, template_id): how many there are, how many were found, and the share."""
    hit = found.select("id", "template_id", F.lit(1).alias("hit"))
    share = F.when(F.count("*") > 0, F.count("hit") / F.count("*")).otherwise(1.0)
    return exact.join(hit, ["id", "template_id"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), share.alias("recall"))
