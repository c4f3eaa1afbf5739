"""The stored tables, registered in the session's catalog and changed in place, a few partitions at a time.

Documents and their chunks are partitioned by session, templates and theirs by a hash of the
template, so a change rewrites what it touches and nothing else: rows that stay are written by
dynamic partition overwrite (which stages files and moves them at commit), and a partition that
loses its last row is overwritten by nothing. Every change is a function of what is stored and of
its arguments, and has no effect the second time, so one that failed is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import schema

#: Partitions of templates and of their chunks.
PARTS = 16
#: Columns, and the column of partitions, of each table.
KINDS = {
    "templates": (schema.TEMPLATES + ", part int", "part"),
    "template_chunks": (schema.TEMPLATE_CHUNKS + ", part int", "part"),
    "docs_inserted": (schema.DOCS_INSERTED, "session_id"),
    "docs_inserted_chunks": (schema.DOCS_INSERTED_CHUNKS + ", session_id string", "session_id"),
}
KEYS = {"templates": "id", "template_chunks": "chunk_id", "docs_inserted": "id", "docs_inserted_chunks": "chunk_id"}


def template_part(template: Column) -> Column:
    return F.pmod(F.crc32(template.cast("binary")), F.lit(PARTS)).cast("int")


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    """Only partitions that are written to are overwritten."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Store:
    """The four tables under a path that driver and executors share, with a prefix to their names in the catalog."""

    def __init__(self, spark: SparkSession, path: str, prefix: str):
        self.spark, self.path, self.prefix = spark, path, prefix

    def name(self, kind: str) -> str:
        return f"{self.prefix}_{kind}"

    def create(self, kind: str, columns: str | None = None) -> None:
        """Register a table, if it is not; what files there are under its path are its rows."""
        full, by = KINDS[kind]
        self.spark.createDataFrame([], columns or full).write.mode("ignore").partitionBy(by).parquet(f"{self.path}/{kind}")  # the folder
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(kind)} ({columns or full}) USING parquet PARTITIONED BY ({by}) LOCATION '{self.path}/{kind}'")
        self.spark.sql(f"MSCK REPAIR TABLE {self.name(kind)}")

    def create_all(self) -> None:
        for kind in KINDS:
            self.create(kind)

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for kind in KINDS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(kind)}")

    def exists(self, kind: str) -> bool:
        return self.spark.catalog.tableExists(self.name(kind))

    def columns(self, kind: str) -> list[str]:
        """Names of the columns as the catalog has them; none of a table that is not there."""
        return [c.name for c in self.spark.catalog.listColumns(self.name(kind))] if self.exists(kind) else []

    def migrate(self, kind: str) -> list[str]:
        """Add the columns that a registered table lacks, and return their names. No file is rewritten."""
        have = self.columns(kind)
        lack = [f for f in StructType.fromDDL(KINDS[kind][0]) if f.name not in have]
        if lack:
            self.spark.sql(f"ALTER TABLE {self.name(kind)} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lack)})")
        return [f.name for f in lack]

    def read(self, kind: str, session: str | None = None) -> DataFrame:
        """A table, or one session's partition of it."""
        rows = self.spark.table(self.name(kind))
        return rows if session is None else rows.filter(F.col("session_id") == session)

    def _fitted(self, kind: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns, in its order and types; those that are lacking are null."""
        table = self.spark.table(self.name(kind)).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table])

    def insert(self, kind: str, rows: DataFrame) -> None:
        """Append the rows whose key is not stored; of rows with one key that of the least hash is taken. Templates get their part."""
        key, by = KEYS[kind], KINDS[kind][1]
        if by == "part":
            rows = rows.withColumn("part", template_part(F.col("id" if kind == "templates" else "template_id")))
        rows = self._fitted(kind, rows)
        one = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("row")).select("row.*")
        fresh = one.join(self.read(kind).select(key), key, "left_anti").select(*rows.columns)
        fresh.hint("rebalance", by).write.insertInto(self.name(kind))

    def _rewrite(self, kind: str, touched: DataFrame, keep: DataFrame) -> None:
        """Put keep in the place of the partitions that touched (a column of their values) names."""
        by = KINDS[kind][1]
        values = touched.select(F.col(by).alias("v")).distinct()
        left = keep.select(F.col(by).alias("v")).distinct()
        emptied = [r["v"] for r in values.exceptAll(left).collect()]  # a value per partition
        with _dynamic(self.spark):
            self._fitted(kind, keep).hint("rebalance", by).write.mode("overwrite").insertInto(self.name(kind))
        for value in emptied:
            self._clear(kind, value)

    def _clear(self, kind: str, value: str | int | None) -> None:
        others = [f for f in self.spark.table(self.name(kind)).schema if f.name != KINDS[kind][1]]
        nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in others)
        shown = "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name(kind)} PARTITION ({KINDS[kind][1]} = {shown}) SELECT {nothing} WHERE false")

    def clear_session(self, session: str) -> None:
        """Chunks first, then documents, so that no chunk is left without its document."""
        for kind in ("docs_inserted_chunks", "docs_inserted"):
            self._clear(kind, session)

    def choose(self, session: str, doc_id: str, template_id: str | None) -> None:
        """Set the user's choice for a document of a session; an unknown id changes nothing."""
        rows = self.read("docs_inserted", session)
        chosen = F.when(F.col("id") == doc_id, F.lit(template_id)).otherwise(F.col("user_choice_doc_id"))
        if not rows.filter(F.col("id") == doc_id).isEmpty():
            self._rewrite("docs_inserted", rows, rows.withColumn("user_choice_doc_id", chosen))

    def replace_chunks(self, session: str, doc_id: str, texts: DataFrame) -> None:
        """Put texts (ord, text) in the place of a document's chunks."""
        rows = self.read("docs_inserted_chunks", session)
        new = texts.select(F.concat(F.lit(doc_id + ":"), "ord").alias("chunk_id"), F.lit(doc_id).alias("doc_id"), "ord", F.lit("").alias("heading"), "text", F.lit(session).alias("session_id"))
        here = new.select("session_id").unionByName(rows.select("session_id"))
        self._rewrite("docs_inserted_chunks", here, rows.filter(F.col("doc_id") != doc_id).unionByName(self._fitted("docs_inserted_chunks", new)))

    def delete_template(self, template_id: str) -> None:
        """Remove a template with all that refers to it: documents' chunks, documents, its chunks, itself."""
        docs, chunks = self.read("docs_inserted"), self.read("docs_inserted_chunks")
        refers = F.col("similar_id").eqNullSafe(template_id) | F.col("user_choice_doc_id").eqNullSafe(template_id)
        gone = docs.filter(refers).select(F.col("id").alias("doc_id"), "session_id")
        same = lambda rows, of: rows.join(of.select(F.col("session_id").alias("s")).distinct(), F.col("session_id").eqNullSafe(F.col("s")), "left_semi")
        here = same(chunks, gone)
        self._rewrite("docs_inserted_chunks", here, here.join(gone.select("doc_id"), "doc_id", "left_anti"))
        here = same(docs, gone)
        self._rewrite("docs_inserted", here, here.filter(~refers))
        for kind, key in (("template_chunks", "template_id"), ("templates", "id")):
            here = self.read(kind).filter(F.col("part") == template_part(F.lit(template_id)))
            self._rewrite(kind, here, here.filter(F.col(key) != template_id))
