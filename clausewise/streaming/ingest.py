"""Incremental ingestion: new files under a directory become elements in a table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import files


def ingest_available(spark: SparkSession, path: str, table: str, checkpoint: str, **options) -> DataFrame:
    """Append the elements of files that have appeared since the last call, and return the table.

    The stream's checkpoint remembers files and batches; a batch that was interrupted is written
    again under its own number, so the table holds every file once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = files.stream_elements(spark, path, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(files.ELEMENTS).option("basePath", table).parquet(f"{table}/batch=*")
