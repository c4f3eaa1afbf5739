"""Queries on file sources, in one pass and as a stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import norm
from ..operators import audit as A
from ..operators import chunking, latent, tfidf
from ..sources import files, index, reader, scratch, text_files
from ..streaming import classify, ingest
from . import audit_queries, fixtures, text_queries


def _files(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files, parted by blank lines: a folder for each source and five hundred ids."""
    docs = fixtures.table(spark, sf_dir, "documents")
    path = scratch.folder(spark, "files")
    lot = F.concat_ws("-", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 500).cast("string"))
    rows = docs.select(lot.alias("lot"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("lot").sortWithinPartitions("lot", "doc_id").drop("doc_id").write.partitionBy("lot").option("lineSep", "\n\n").text(path)
    return path


def _shown(elements: DataFrame) -> DataFrame:
    return elements.select("category", "source_type", F.col("order").cast("bigint").alias("ord"), "element_type", "text", "parse_error")


def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(files.read_elements(spark, _files(spark, sf_dir)))


def text_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as UTF-8, as Windows-1251 (characters that it lacks left out) and, with a byte that is in neither, broken."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    second = text_files.encoded(F.regexp_replace(text, "[^\\x00-\\x7Fа-яёА-ЯЁ№]", ""))
    content = F.when(key % 3 == 0, text.cast("binary")).when(key % 3 == 1, second).otherwise(F.concat(F.unhex(F.lit("98")), second))
    docs = fixtures.contracts(spark, sf_dir).filter("doc_id >= 0").select(F.concat(F.lit("/in/texts/"), key, F.lit(".txt")).alias("path"), content.alias("content"))
    found = files.elements(docs, formats=("txt",))
    return found.select("doc_id", F.col("order").cast("bigint").alias("ord"), "element_type", F.md5("text").alias("digest"), "parse_error")


def source_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingest_files by the registered source, of one folder in two (by a pushed filter on the category)."""
    path = _files(spark, sf_dir)
    reader.register(spark)
    some = [r["category"] for r in fixtures.table(spark, sf_dir, "documents").select(F.concat(F.lit("lot="), "source", F.lit("-0")).alias("category")).distinct().collect()]
    found = spark.read.format(reader.NAME).option("partitionBytes", 1 << 20).load(path)
    return _shown(found.filter(F.col("category").isin(some) & (F.col("source_type") == "txt")))


def classify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts arrive in two batches, with the second of which half of the first comes again; sessions are sources. What the
    counters of each session say, beside the statuses of its documents."""
    place = scratch.folder(spark, "stream")
    docs = fixtures.contracts(spark, sf_dir).filter("doc_id >= 0").join(fixtures.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    landed = docs.select("doc_id", F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    library = fixtures.table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("id"), "text")
    model = tfidf.fit(library, key="id")
    templates = tfidf.sparse(library, "text", "embedding", model)
    vectors = lambda df: tfidf.sparse(df, "text", "embedding", model)
    for arrived in ("doc_id % 2 = 0", "doc_id % 2 = 1 OR doc_id % 4 = 0"):
        landed.filter(arrived).select("path", "content").write.mode("append").parquet(f"{place}/landing")
        stream = spark.readStream.schema("path string, content binary").parquet(f"{place}/landing")
        classify.classify_available(stream, templates, vectors, f"{place}/results", f"{place}/checkpoint", fixtures.AS_OF, formats=("txt",))
    rows = classify.results(spark, f"{place}/results").groupBy("session").agg(F.count("*").alias("rows"))
    return classify.counters(spark, f"{place}/results").join(rows, "session").select("session", "processed", "classified", "rows", "nonstandard")


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch.folder(spark, "files")
    return _shown(ingest.ingest_available(spark, _files(spark, sf_dir), f"{place}/table", f"{place}/checkpoint"))


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with vectors of latent meaning through the file index and back, per source."""
    docs = fixtures.documents(spark, sf_dir)
    found = chunking.chunk_documents(docs.select("doc_id", chunking.paragraphs(F.col("text"), "\n").alias("els")), F.col("els"))
    path = scratch.folder(spark, "files")
    latent.fit(docs.select("doc_id", "text"), components=64).save(spark, f"{path}-encoder")
    placed = latent.Encoder.load(spark, f"{path}-encoder").encode(chunking.offsets(found), "text", "embedding")
    index.write_index(path, docs.select("doc_id", "source"), placed)
    names, chunks = index.read_index(spark, path, "doc_id bigint, source string")
    unit = F.count_if(F.abs(norm(F.col("embedding")) - 1) < 1e-3)
    return chunks.join(names, "doc_id").groupBy("source").agg(F.count("*").alias("chunks"), unit.alias("unit_vectors"), F.min("vec_offset").cast("bigint").alias("first"))


_parts = text_queries._strip
_INGESTED = f"""SELECT category, 'txt' AS source_type, generate_subscripts(p, 1) - 1 AS ord, 'paragraph' AS element_type, unnest(p) AS text, CAST(NULL AS VARCHAR) AS parse_error FROM (
  SELECT 'lot=' || source || '-' || doc_id // 500 AS category, [x FOR x IN [{_parts('y')} FOR y IN string_split(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id), chr(10) || chr(10))] IF x <> ''] AS p FROM documents GROUP BY 1)"""
_second = "regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{7F}а-яёА-ЯЁ№]', '', 'g')"

QUERIES = {f.__name__: f for f in (ingest_files, ingest_stream, text_charsets, source_elements, classify_stream, file_index)}
ORACLES = {
    "ingest_files": _INGESTED,
    "ingest_stream": _INGESTED,
    "source_elements": f"SELECT * FROM ({_INGESTED}) WHERE category LIKE '%-0'",
    "text_charsets": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, generate_subscripts(p, 1) - 1 AS ord, 'paragraph' AS element_type, md5(unnest(p)) AS digest, CAST(NULL AS VARCHAR) AS parse_error
FROM (SELECT doc_id, [x FOR x IN [{_parts('y')} FOR y IN string_split(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE {_second} END, chr(10) || chr(10))] IF x <> ''] AS p FROM ({fixtures.contracts_sql()}) WHERE doc_id >= 0 AND doc_id % 3 < 2)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, NULL, NULL, 'UnicodeDecodeError: ''charmap'' codec can''t decode byte 0x98 in position 0: character maps to <undefined>' FROM documents WHERE doc_id % 3 = 2""",
    "classify_stream": rf"""WITH {audit_queries.VIOLATIONS_SQL},
t AS (SELECT c0.doc_id, unnest([x FOR x IN regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') IF length(x) > 1]) AS term FROM c0 WHERE doc_id >= 0),
lt AS (SELECT doc_id, unnest([x FOR x IN regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') IF length(x) > 1]) AS term FROM documents WHERE doc_id % 10 = 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), lf AS (SELECT doc_id, term, count(*) AS tf FROM lt GROUP BY 1, 2),
vo AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 10 = 0)) / (1 + count(*))) + 1 AS idf FROM lf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 4096),
wt AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN vo USING (term)),
lw AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM lf JOIN vo USING (term)),
best AS (SELECT doc_id, max(s) AS s FROM (SELECT wt.doc_id, lw.doc_id AS t, sum(wt.w * lw.w) AS s FROM wt JOIN lw ON lw.term = wt.term GROUP BY 1, 2) GROUP BY 1)
SELECT source AS session, count(*) AS processed, count(*) FILTER (round(s, 6) >= 0.5) AS classified, count(*) AS rows, count(*) FILTER (status = '{A.NONSTANDARD}') AS nonstandard
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id JOIN ({audit_queries._status}) st ON st.doc_id = d.doc_id GROUP BY 1""",
    # a vector has a direction if its chunk has a word of the vocabulary
    "file_index": f"""WITH {text_queries.CHUNKS_SQL}, {text_queries.TFIDF_SQL},
kn AS (SELECT DISTINCT chunk_id FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS term FROM chunks) x JOIN vo ON vo.term = x.term)
SELECT source, count(*) AS chunks, count(*) FILTER (c.chunk_id IN (SELECT chunk_id FROM kn)) AS unit_vectors, min(vec_offset) AS first
FROM (SELECT *, row_number() OVER (ORDER BY doc_id, ord) - 1 AS vec_offset FROM chunks) c JOIN documents d ON d.doc_id = c.doc_id GROUP BY source""",
}
