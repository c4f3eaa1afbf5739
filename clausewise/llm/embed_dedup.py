"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Exact copies are counted and set aside first; one representative stands for each. A
representative is hashed into one bucket per table by the signs of its products with
random hyperplanes. The number of bits follows the number of vectors (buckets of about
BUCKET), the number of tables follows from the bits and the wanted recall at the
threshold. Buckets beyond BLOCK rows are cut into blocks, and every pair of blocks is a
task of its own, so no bucket, however hot, is skipped or meets in one task. A pair is
judged in the first table in which its buckets agree, in double precision. A block task
returns a row per vector (its links and its component in the block), never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

BUCKET, BLOCK = 128, 1024
SEED = 20_11


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = min(24, max(4, round(math.log2(max(n, 1) / BUCKET)))) if n > BUCKET else 4
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of vectors (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing. Vectors of different lengths link with nothing of another length. Rows that
    repeat a vec_id count as further vectors; a row without vec_id links with nothing and
    has no component. Other columns are ignored. For a bound such as 0.9, a pair at the
    bound itself is missed with a chance of 1 - recall at most, closer pairs less often.
    """
    good = (F.col("embedding").isNotNull()) & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = vectors.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    keyed = keyed.withColumns({"h1": F.when(F.col("good"), F.xxhash64("embedding")), "h2": F.when(F.col("good"), F.xxhash64(F.lit("second"), "embedding"))})
    reps = keyed.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").cast("bigint").alias("vec"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
    reps = graph.cut(reps.withColumn("rep", F.monotonically_increasing_id()))  # kept, so the numbers do not change
    bits, tables = plan(reps.count(), threshold, recall)

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in source:
            lists = b.column("embedding")
            width = np.diff(lists.offsets.to_numpy())
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                part = b.take(pa.array(rows))
                x = part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(len(rows), w)
                if w not in planes:
                    planes[w] = np.random.default_rng([SEED, int(w)]).normal(size=(int(w), bits * tables))
                # every component stays finite in products of large values
                signs = (x / np.abs(x).max(1, keepdims=True)) @ planes[w] > 0
                code = signs.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
                signature = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(code.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("size"), part.column("embedding"), signature], ["rep", "size", "embedding", "signature"])

    kind = reps.schema["embedding"].dataType.elementType.simpleString()
    signed = reps.select("rep", "size", "embedding").mapInArrow(sign, f"rep bigint, size bigint, embedding array<{kind}>, signature array<int>")
    place = F.posexplode("signature").alias("tab", "code")
    bucket = (F.size("embedding").cast("bigint") * (1 << 24) + F.col("code")).alias("bucket")  # vectors of other lengths are never near
    spread = signed.select("*", place).select("rep", "size", "embedding", "signature", "tab", bucket)
    hot = signed.select("embedding", place).select("tab", bucket).groupBy("tab", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    placed = spread.join(hot, ["tab", "bucket"], "left").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    keys = ["tab", "bucket", "low", "high"]
    placed = placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select(*keys, "own", "rep", "size", "embedding", "signature")

    def verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in graph.groups(source, keys):
            if g.num_rows < 2:
                continue
            t = g.column("tab")[0].as_py()
            own, rep, size = (g.column(c).to_numpy() for c in ("own", "rep", "size"))
            x = g.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(g.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            signature = g.column("signature").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
            close = np.triu(x @ x.T >= threshold, 1)
            if g.column("low")[0].as_py() != g.column("high")[0].as_py():
                close &= own[:, None] != own[None]
            a, b = np.nonzero(close)
            for at in range(t):
                fresh = signature[a, at] != signature[b, at]
                a, b = a[fresh], b[fresh]
            if len(a):
                links = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
                by_id = np.argsort(rep)
                place = np.empty_like(by_id)
                place[by_id] = np.arange(len(rep))
                root = graph.local_roots(len(rep), place[a], place[b])[place]
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[by_id][root[some]])], ["rep", "links", "root"])

    linked = graph.cut(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "rep bigint, links bigint, root bigint"))
    components = graph.connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    components = components.withColumnRenamed("id", "rep")
    own = reps.select("h1", "h2", "rep", "vec", "size")
    least = components.join(own, "rep").groupBy("component").agg(F.min("vec").alias("least"))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links")).join(components, "rep").join(least, "component").select("rep", "links", "least")
    known = own.join(links, "rep", "left")
    out = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("least", "vec", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
