"""Incremental classification: files that arrive are matched to templates and audited, and each session's counters are kept.

Two streams run one after the other. The first takes each file once (its key is the state), finds
its template and its violations, and writes every batch to a table under the batch's number; a batch
that was interrupted is written again. A batch is matched as a table, so a library of any size will
do. The second follows that table and keeps the counters of each session
as the state of an aggregation, summed on the map side first, so a large session is no large group.
Both go on from their checkpoints after a restart.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators import match as M
from ..sources import files

RESULTS = "doc_key string, doc_id string, template_id string, similarity double, status string, violations int, parse_error string, session string"
STORED = f"{RESULTS}, batch int"


def arrivals(arrived: DataFrame, parsers: dict | None = None, formats: tuple[str, ...] | None = None) -> DataFrame:
    """The documents of files (path, content), a stream or not: one row for each doc_key."""
    return files.documents(arrived, files.PARSERS | (parsers or {}), formats).dropDuplicates(["doc_key"])


def judged(docs: DataFrame, templates: DataFrame, vectors: Callable[[DataFrame], DataFrame], as_of: datetime.date, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """RESULTS of documents with unique doc_keys."""
    found = M.with_nearest(vectors(docs), templates, "best", block_bytes=block_bytes, key="doc_key")
    rows = audit.audit(found, as_of)
    return rows.select("doc_key", "doc_id", "best.template_id", F.round("best.similarity", 6).alias("similarity"), "status", F.size("violations").alias("violations"), "parse_error", F.col("category").alias("session"))


def classified(arrived: DataFrame, templates: DataFrame, vectors: Callable[[DataFrame], DataFrame], as_of: datetime.date, parsers: dict | None = None, formats: tuple[str, ...] | None = None) -> DataFrame:
    """RESULTS of files (path, content): one row for each doc_key; the session is the folder.

    vectors adds the column embedding to a frame with text; templates: id, embedding. Files that cannot be read have
    their error, no template and the status of texts that cannot be judged.
    """
    return judged(arrivals(arrived, parsers, formats), templates, vectors, as_of)


def counted(found: DataFrame, bound: float = 0.5) -> DataFrame:
    """session, processed, classified (similarity of bound or more), nonstandard."""
    hit = F.count_if(F.col("similarity") >= bound)
    return found.groupBy("session").agg(F.count("*").alias("processed"), hit.alias("classified"), F.count_if(F.col("status") == audit.NONSTANDARD).alias("nonstandard"))


def classify_available(
    arrived: DataFrame,
    templates: DataFrame,
    vectors: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    as_of: datetime.date,
    parsers: dict | None = None,
    formats: tuple[str, ...] | None = None,
    block_bytes: int = M.BLOCK_BYTES,
) -> None:
    """Classify what a stream of files has that was not there the last time; path gets the results and counters. A library of more
    than block_bytes is dealt to tasks."""
    spark = arrived.sparkSession
    spark.createDataFrame([], RESULTS).write.mode("ignore").partitionBy("session").parquet(f"{path}/documents")  # the folder

    def judge(batch: DataFrame, number: int) -> None:
        judged(batch, templates, vectors, as_of, block_bytes).write.mode("overwrite").partitionBy("session").parquet(f"{path}/documents/batch={number}")

    first = arrivals(arrived, parsers, formats).writeStream.foreachBatch(judge).option("checkpointLocation", f"{checkpoint}/documents")
    first.trigger(availableNow=True).start().awaitTermination()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    totals = counted(spark.readStream.schema(STORED).parquet(f"{path}/documents"))
    second = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/counters")
    second.trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, path: str) -> DataFrame:
    """Every file once, as it was classified."""
    return spark.read.schema(STORED).parquet(f"{path}/documents").drop("batch")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The latest counters of each session."""
    rows = spark.read.option("basePath", f"{path}/counters").parquet(f"{path}/counters/batch=*")
    return rows.groupBy("session").agg(F.max_by(F.struct("processed", "classified", "nonstandard"), "batch").alias("last")).select("session", "last.*")
