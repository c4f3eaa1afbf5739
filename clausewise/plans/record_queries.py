"""Queries on office files, stored texts, lists of records and changes of tables, and their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..operators import audit as A
from ..operators import chunking as C
from ..operators import match as M
from ..operators import reports as R
from ..operators import store as S
from ..operators import titles
from ..sources import files, index, schema
from . import audit_queries, fixtures, match_queries, text_queries

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _paragraph(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def _docx(heading: str, paragraphs: list[str], rows: list[list[str]]) -> bytes:
    """A document with a heading, a table after its first paragraph, and the other paragraphs."""
    cells = lambda row: "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in row)
    table = "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in rows) + "</w:tbl>"
    body = _paragraph(heading, "Heading2") + _paragraph(paragraphs[0]) + table + "".join(map(_paragraph, paragraphs[1:]))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _packed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for key, name, brand, kind in batches:
        yield pd.Series([_docx(f"{k}. {n}", [n, "", f"{t} № {k}"], [[b, f"Contract # {k}"], ["", f"Договор № {k} {n}"]]) for k, n, b, t in zip(key, name, brand, kind, strict=True)])


def _office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of one office file per part."""
    part = fixtures.table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("/in/parts/part"), "p_partkey", F.lit(".docx")).alias("path"), _packed("p_partkey", "p_name", "p_brand", "p_type").alias("content"))


def docx_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs before the rows of tables."""
    found = files.elements(_office_files(spark, sf_dir))
    return found.select("doc_id", "category", F.col("order").cast("bigint").alias("ord"), "element_type", "text", "parse_error")


def docx_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of the document, with blocks that know the level of a heading."""
    found = files.elements(_office_files(spark, sf_dir), {"docx": files.parse_docx_headings})
    b = C.block(F.col("text"), F.concat(F.lit("heading "), F.element_at("metadata", "heading")))
    return found.select("doc_id", F.col("order").cast("bigint").alias("ord"), "element_type", b["type"].alias("block_type"), b["level"].cast("bigint").alias("level"), "text")


def docx_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by all stages and kinds of files: parts with a heading, with cells alone, with neither, and other kinds."""
    part, key = fixtures.table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(key % 5 == 3, "pdf").when(key % 5 == 4, "txt").otherwise("docx")
    number = F.concat(F.lit(" № "), key)
    paragraphs = F.array(F.lit(" "), F.col("p_type"), F.when(key % 5 == 0, F.concat(F.lit("Договор"), number)).otherwise("p_name"), F.lit("г. Москва"))
    cells = F.when(key % 5 == 1, F.array(F.col("p_brand"), F.concat(F.lit("Contract # "), key), F.concat(F.lit("Договор "), "p_name", number))).otherwise(F.array("p_brand"))
    page = F.array(F.col("p_brand"), F.concat(F.lit("Contract "), "p_name", number))
    return part.select("p_partkey", kind.alias("kind"), titles.title(kind, paragraphs, cells, page).alias("title"))


def audit_stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of contracts that are rebuilt from their chunks; every seventh lost its chunks."""
    contracts = fixtures.contracts(spark, sf_dir)
    kept = contracts.filter("doc_id % 7 <> 0").select("doc_id", C.paragraphs(F.col("text"), "\n").alias("els"))
    found = A.audit_stored(contracts, C.chunk_documents(kept, F.col("els")), fixtures.AS_OF)
    return found.select("doc_id", "status", F.size("violations").cast("bigint").alias("n_violations"), F.array_join(F.transform("violations", lambda v: v["rule_id"]), ",").alias("rules"), "error")


def insert_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched documents appended to a table of the documents of one session, in the table's own types."""
    held = S.migrate(fixtures.incoming(spark, sf_dir).filter("session_id = 's3'").select("id", "name", "session_id"), schema.DOCS_INSERTED)
    best = match_queries._stored(spark, sf_dir).filter("session_id <> 's3'").select("id", "name", "session_id", "similar_id", "similarity_score", "title")
    return S.insert(held, best, {"is_active": True}).select("id", "name", "session_id", "is_active", "similar_id", "similarity_score", "title")


def migrate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table of templates, without titles, brought to the schema; the probes tell what it lacked."""
    old = fixtures.templates(spark, sf_dir).drop("title", "title_emb")
    new = S.migrate(old, schema.TEMPLATES)
    probes = {f"{when}_{c}": F.lit(index.has_column(df, c)) for when, df in (("old", old), ("new", new)) for c in ("title", "title_emb")}
    return new.select("id", "title", F.size("embedding").cast("bigint").alias("width"), F.lit(",".join(new.columns)).alias("names")).withColumns(probes)


def template_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lookup(match_queries._library(spark, sf_dir), "t10").select("id", "name", "version")


def templates_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_name(match_queries._library(spark, sf_dir)).select("id", "name")


def browse_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.browse(match_queries._library(spark, sf_dir), 10).select("id", "name")


def templates_referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.referred(match_queries._library(spark, sf_dir), match_queries._stored(spark, sf_dir)).select("id", "name")


def vector_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at three decimals: the components that differ from none, and their sum."""
    v = V.quantise(F.col("embedding"), 3)
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.size(F.filter("v", lambda x: x != 0)).cast("bigint").alias("n_set"), F.round(F.aggregate(V.as_double(F.col("v")), F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def match_without_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching where every 13th document has a zero vector and every 17th none: those have no template."""
    k = F.substring("id", 2, 20).cast("bigint")
    v = F.when(k % 13 == 0, V.as_double(F.transform("embedding", lambda x: x * 0))).when(k % 17 != 0, F.col("embedding"))
    docs = fixtures.incoming(spark, sf_dir).withColumn("embedding", v)
    found = M.match(docs, fixtures.templates(spark, sf_dir)).select("id", "template_id")
    return docs.select("id").join(found, "id", "left")


def index_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, chunks and the mean over files of their mean chunk size, per source."""
    docs = fixtures.table(spark, sf_dir, "documents")
    return C.run_stats(C.chunk_stats(text_queries._chunks(spark, sf_dir)).join(docs.select("doc_id", "source"), "doc_id"), "source")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, chunks and whole mean characters of a chunk for each document."""
    stats = C.chunk_stats(text_queries._chunks(spark, sf_dir))
    pages = text_queries._cleaned(spark, sf_dir).select("doc_id", C.pages(F.col("b")).cast("bigint").alias("pages"))
    return pages.join(stats, "doc_id").select("doc_id", "pages", "chunks", F.floor(F.col("chars") / F.col("chunks")).alias("avg_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        docx_elements,
        docx_headings,
        docx_titles,
        audit_stored_texts,
        insert_document_rows,
        migrate_templates,
        template_lookup,
        templates_by_name,
        browse_templates,
        templates_referred,
        vector_quantise,
        match_without_direction,
        index_run_stats,
        file_stats,
    )
}

_stored_texts = text_queries.CHUNKS_SQL.replace("FROM documents", "FROM kept")
_names = ",".join(column.split()[0] for column in schema.TEMPLATES.split(", "))
_with = f"WITH {match_queries.STORED_SQL}"
ORACLES = {
    "docx_elements": """SELECT 'part' || p_partkey AS doc_id, 'parts' AS category, ord, element_type, text, CAST(NULL AS VARCHAR) AS parse_error FROM (
  SELECT p_partkey, 0 AS ord, 'paragraph' AS element_type, p_partkey || '. ' || p_name AS text FROM part
  UNION ALL SELECT p_partkey, 1, 'paragraph', p_name FROM part UNION ALL SELECT p_partkey, 2, 'paragraph', p_type || ' № ' || p_partkey FROM part
  UNION ALL SELECT p_partkey, 3, 'table', p_brand || chr(9) || 'Contract # ' || p_partkey FROM part
  UNION ALL SELECT p_partkey, 4, 'table', chr(9) || 'Договор № ' || p_partkey || ' ' || p_name FROM part)""",
    "docx_headings": """SELECT 'part' || p_partkey AS doc_id, ord, element_type, CASE WHEN element_type = 'heading' OR short AND (upper(text) = text AND lower(text) <> text) THEN 'heading' ELSE 'paragraph' END AS block_type,
  CASE WHEN element_type = 'heading' THEN 2 WHEN short AND (upper(text) = text AND lower(text) <> text) THEN 1 END AS level, text FROM (SELECT *, length(text) < 100 AS short FROM (
  SELECT p_partkey, 0 AS ord, 'heading' AS element_type, p_partkey || '. ' || p_name AS text FROM part
  UNION ALL SELECT p_partkey, 1, 'paragraph', p_name FROM part
  UNION ALL SELECT p_partkey, 2, 'table', p_brand || ' | Contract # ' || p_partkey || chr(10) || ' | Договор № ' || p_partkey || ' ' || p_name FROM part
  UNION ALL SELECT p_partkey, 3, 'paragraph', p_type || ' № ' || p_partkey FROM part))""",
    "docx_titles": """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 'pdf' WHEN 4 THEN 'txt' ELSE 'docx' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN 'Договор' WHEN 1 THEN 'Contract Договор ' || p_name WHEN 2 THEN p_type WHEN 3 THEN 'Contract ' || p_name ELSE '' END AS title FROM part""",
    "audit_stored_texts": f"""WITH {_stored_texts.replace("RECURSIVE", f"RECURSIVE given AS ({fixtures.contracts_sql()}), kept AS (SELECT * FROM given WHERE doc_id % 7 <> 0),", 1)},
c0 AS (SELECT given.doc_id, string_agg(ch.c.text, ' ' ORDER BY ch.ord) AS text FROM given LEFT JOIN ch ON ch.doc_id = given.doc_id GROUP BY given.doc_id),
{audit_queries.RULES_SQL}
SELECT s.doc_id, status, n_violations, coalesce(rules, '') AS rules, CASE WHEN c0.text IS NULL THEN '{A.E_NO_TEXT}' END AS error
FROM ({audit_queries._status}) s JOIN c0 ON c0.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, string_agg(rule_id, ',' ORDER BY k, j) AS rules FROM v GROUP BY doc_id) r ON r.doc_id = s.doc_id""",
    "insert_document_rows": f"""{_with} SELECT id, name, session_id, CAST(NULL AS BOOLEAN) AS is_active, CAST(NULL AS VARCHAR) AS similar_id, CAST(NULL AS DOUBLE) AS similarity_score, CAST(NULL AS VARCHAR) AS title FROM incoming WHERE session_id = 's3'
UNION ALL SELECT id, name, session_id, true, similar_id, similarity_score, title FROM stored WHERE session_id <> 's3'""",
    "migrate_templates": f"{_with} SELECT id, CAST(NULL AS VARCHAR) AS title, len(embedding) AS width, '{_names}' AS names, false AS old_title, false AS old_title_emb, true AS new_title, true AS new_title_emb FROM templates",
    "template_lookup": f"{_with} SELECT id, name, version FROM templates WHERE id = 't10'",
    "templates_by_name": f"{_with} SELECT id, name FROM templates ORDER BY name, id",
    "browse_templates": f"{_with} SELECT id, name FROM templates ORDER BY id LIMIT 10",
    "templates_referred": f"{_with} SELECT id, name FROM templates t WHERE EXISTS (SELECT 1 FROM stored s WHERE s.similar_id = t.id)",
    "vector_quantise": "SELECT vec_id, len([x FOR x IN v IF x <> 0]) AS n_set, round(list_sum(v), 3) AS total FROM (SELECT vec_id, [round(CAST(x AS DOUBLE), 3) FOR x IN embedding] AS v FROM embeddings)",
    "match_without_direction": f"{_with} SELECT i.id, best.template_id FROM incoming i LEFT JOIN best ON best.id = i.id AND CAST(substr(i.id, 2) AS BIGINT) % 13 <> 0 AND CAST(substr(i.id, 2) AS BIGINT) % 17 <> 0",
    "index_run_stats": f"WITH {text_queries.CHUNKS_SQL} SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, round(avg(tokens), 4) AS avg_tokens FROM (SELECT doc_id, count(*) AS n, round(avg(length(text)) / 4, 6) AS tokens FROM chunks GROUP BY doc_id) s JOIN documents d ON d.doc_id = s.doc_id GROUP BY source",
    "file_stats": f"WITH {text_queries.CHUNKS_SQL} SELECT pg.doc_id, pages, count(*) AS chunks, CAST(floor(avg(length(chunks.text))) AS BIGINT) AS avg_chars FROM pg JOIN chunks ON chunks.doc_id = pg.doc_id GROUP BY 1, 2",
}
