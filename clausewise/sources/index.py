"""The file index: templates as JSON, chunks with their vectors as Parquet; vec_offset ties a vector to its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_index(path: str, templates: DataFrame, chunks: DataFrame) -> None:
    """templates: id, name, title and other scalars; chunks: template_id, vec_offset, text, embedding and others."""
    templates.write.mode("overwrite").json(f"{path}/templates")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def read_index(spark: SparkSession, path: str, template_schema) -> tuple[DataFrame, DataFrame]:
    """Blank lines of the JSON are passed over."""
    return spark.read.schema(template_schema).json(f"{path}/templates"), spark.read.parquet(f"{path}/chunks")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns
