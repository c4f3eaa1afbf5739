"""Changes of stored tables as pure functions from the state before to the state after.

Parquet tables have no UPDATE or DELETE; a caller writes the returned state as a new version.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def insert(table: DataFrame, rows: DataFrame, defaults: dict | None = None) -> DataFrame:
    """table with rows appended; columns that rows lack get their default, or null."""
    defaults = defaults or {}
    filled = rows.select(*[F.col(c) if c in rows.columns else F.lit(defaults.get(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(filled)


def migrate(table: DataFrame, schema: str) -> DataFrame:
    """table with the columns of a schema (DDL) that it lacks added as nulls, in that order; columns that the schema does not name stay behind them."""
    wanted = StructType.fromDDL(schema)
    have = [F.col(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return table.select(*have, *[c for c in table.columns if c not in wanted.names])


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with those rows whose key it does not have; of rows with the same key one is taken."""
    fresh = rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def update_choice(docs: DataFrame, doc_id: str, template_id: str | None) -> DataFrame:
    """docs with the user's choice set for one document; an unknown id changes nothing."""
    return docs.withColumn("user_choice_doc_id", F.when(F.col("id") == doc_id, F.lit(template_id)).otherwise(F.col("user_choice_doc_id")))


def clear_session(docs: DataFrame, chunks: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of a session. Rows without a session stay."""
    gone = docs.filter(F.col("session_id") == session).select(F.col("id").alias("doc_id"))
    return docs.filter(~F.col("session_id").eqNullSafe(session)), chunks.join(gone, "doc_id", "left_anti")


def replace_chunks(chunks: DataFrame, doc_id: str, texts: DataFrame) -> DataFrame:
    """chunks with those of one document replaced by texts (ord, text), numbered by ord, without vectors."""
    new = texts.select(F.concat(F.lit(doc_id + ":"), "ord").alias("chunk_id"), F.lit(doc_id).alias("doc_id"), "ord", F.lit("").alias("heading"), "text")
    return insert(chunks.filter(F.col("doc_id") != doc_id), new)


def delete_template(templates: DataFrame, template_chunks: DataFrame, docs: DataFrame, template_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a template: documents that refer to it first, then its chunks, then itself."""
    refers = functools.reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(template_id) for c in ("similar_id", "user_choice_doc_id")])
    return templates.filter(F.col("id") != template_id), template_chunks.filter(F.col("template_id") != template_id), docs.filter(~refers)


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Children whose key is set and names no parent."""
    named = parents.select(F.col(parent_key).alias(key))
    return children.filter(F.col(key).isNotNull()).join(named, key, "left_anti")
