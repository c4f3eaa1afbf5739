"""Distributed pieces that several operators share: cutting lineage, streaming over sorted groups, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops

#: A key with more than one in HOT of all rows is dealt to several tasks; there are fewer such keys than HOT.
HOT = 1000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Like cut, as a written table: smaller than a checkpoint, but it stays when the session no longer needs it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a session on one machine, as in tests, gets a folder of
    its own; on a cluster that is an error, for executors would not see the driver's."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df has not, in any case of letters."""
    have, out = {c.lower() for c in df.columns}, f"__{name}"
    while any(c.startswith(out.lower()) for c in have):
        out += "_"
    return out


def aside(df: DataFrame, own: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its other columns than own under names that no operator uses, and a function that gives a result their names
    and order back, with the columns that were added behind them; columns that the result has not are passed over."""
    names = {c: c if c in set(own) else f"__other{k}" for k, c in enumerate(df.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(new).alias(old) for old, new in names.items() if new in out.columns], *[c for c in out.columns if c not in names.values()])

    return df.select(*[df[f"`{old}`"].alias(new) for old, new in names.items()]), back


def join_dealt(rows: DataFrame, keyed: DataFrame, counts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with keyed by keys, where both keyed and counts have n, the number of rows with these keys.

    counts (read twice, so a kept table) names the hot keys, those with over one in HOT of its rows. A hot key is cut by a hash of the columns by
    into as many parts as it has such shares: its rows meet copies of its row of keyed in that many tasks. Only hot keys are
    broadcast, fewer than HOT whatever the size of the data.
    """
    share = max(1.0, (counts.agg(F.sum("n")).first()[0] or 0) / HOT)
    parts = F.ceil(F.col("n") / share)
    hot = counts.filter(F.col("n") > share).select(*keys, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    copies = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("n") > share, parts).otherwise(1) - 1)))
    return dealt.join(copies.drop("n"), [*keys, "__part"]).drop("__part")


def groups(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a partition that is sorted by them.

    Only one group is held at a time, beside the batch at hand.
    """
    bytesops.release()
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in source:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for at, end in zip(edges, edges[1:], strict=False):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for n nodes and the links a-b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        root = root[root]
        if (root == before).all():
            return root


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b: longs); component is the least id that links reach.

    Alternates large-star and small-star steps until nothing changes. A step groups with
    partial aggregation and joins by a key, which adaptive execution splits where it is
    skewed; each step's edges are checkpointed, and only their number and a checksum
    reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e, seen = cut(e), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
