"""Queries on matching, session reports and table changes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import ivf
from ..operators import match as M
from ..operators import reports as R
from ..operators import chunking, tables, tfidf
from ..operators import store as S
from ..sources import scratch
from . import fixtures, text_queries

SESSION = "s3"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(fixtures.incoming(spark, sf_dir), fixtures.templates(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs_inserted: the incoming documents with their best templates."""
    best = _matched(spark, sf_dir).select("id", F.col("template_id").alias("similar_id"), F.round("score", 6).alias("similarity_score"))
    return fixtures.incoming(spark, sf_dir).drop("embedding", "title_emb").join(best, "id", "left")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.templates(spark, sf_dir).drop("embedding", "title_emb")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def template_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matched(spark, sf_dir).drop("rank"), "doc_score", "title_score", "score")


def template_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.nearest(fixtures.incoming(spark, sf_dir), fixtures.templates(spark, sf_dir), 3, 0.2)
    return _rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "similarity")


def template_doc_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    untitled = fixtures.incoming(spark, sf_dir).filter("title_emb IS NULL")
    return _rounded(M.match(untitled, fixtures.templates(spark, sf_dir)).select("id", "template_id", "score"), "score")


def template_blocks_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """template_top1 as a library that is too large to send is matched: in blocks, here of 16 rows."""
    found = M.match(fixtures.incoming(spark, sf_dir), fixtures.templates(spark, sf_dir), block_bytes=0, block_rows=16)
    return _rounded(found.drop("rank"), "doc_score", "title_score", "score")


def template_ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """template_topk_threshold from the index of lists, with every list probed."""
    path = scratch.folder(spark, "ivf")
    ivf.build(fixtures.templates(spark, sf_dir), path)
    found = ivf.search(fixtures.incoming(spark, sf_dir), path, 3, 0.2, probes=ivf.LISTS)
    return _rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "similarity")


def template_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in an index of 32 lists, every 50th asked for its ten nearest, at the default number of probes."""
    e = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), V.as_double(F.col("embedding")).alias("embedding"))
    path = scratch.folder(spark, "ivf")
    ivf.build(e, path, lists=32)
    asked = e.filter("CAST(id AS BIGINT) % 50 = 0")
    found = ivf.recall(M.nearest(asked, e, 10, 0.0), ivf.search(asked, path, 10))
    return found.select("neighbours", (F.col("recall") >= 0.9).alias("enough"))


def fallback_model_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are fitted on every tenth document, the library, and stored; the others are transformed with them, cut to 1024
    components, and matched."""
    docs = fixtures.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    path, is_library = scratch.folder(spark, "tfidf"), F.col("id").cast("bigint") % 10 == 0
    tfidf.fit(docs.filter(is_library), key="id").save(spark, path)
    made = tfidf.sparse(docs, "text", "embedding", tfidf.Model.load(spark, path), 1024).select("id", "embedding")
    found = M.nearest(made.filter(~is_library), made.filter(is_library), 1, 0.0)
    return found.select(F.col("id").cast("bigint").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.band_counts(_stored(spark, sf_dir).select(F.col("similarity_score").alias("score")))


def classification_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counters(_stored(spark, sf_dir).select(F.col("similarity_score").alias("score")))


def classification_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.results(_stored(spark, sf_dir), _library(spark, sf_dir), limit=100)


def session_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.results(_stored(spark, sf_dir), _library(spark, sf_dir), session=SESSION)


def document_with_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_choice(_stored(spark, sf_dir), _library(spark, sf_dir))


def template_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.options(_library(spark, sf_dir))


def default_template_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.default_option(_stored(spark, sf_dir), R.options(_library(spark, sf_dir)))


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.display(_stored(spark, sf_dir))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.session_stats(_stored(spark, sf_dir))


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks for every incoming document."""
    ids = fixtures.incoming(spark, sf_dir).select(F.col("id").alias("doc_id"))
    rows = ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"))
    return rows.select(F.concat_ws(":", "doc_id", "ord").alias("chunk_id"), "doc_id", "ord", F.lit("").alias("heading"), F.concat_ws(" ", F.lit("text"), "doc_id", "ord").alias("text"))


def clear_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = S.clear_session(fixtures.incoming(spark, sf_dir).select("id", "session_id"), _doc_chunks(spark, sf_dir), SESSION)
    return docs.join(chunks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunks")), "id", "full")


def insert_template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth template once more under a new id, without a version: the table's default fills it."""
    table = _library(spark, sf_dir).select("id", "name", "version", "is_active")
    new = table.filter("CAST(substr(id, 2) AS BIGINT) % 50 = 0").select(F.concat(F.lit("n"), "id").alias("id"), "name")
    return S.insert(table, new, {"is_active": True})


def insert_chunks_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch inserted twice, with a new chunk for every tenth document."""
    chunks = _doc_chunks(spark, sf_dir)
    extra = chunks.filter("ord = 0 AND CAST(substr(doc_id, 2) AS BIGINT) % 10 = 1").withColumns({"ord": F.lit(3), "chunk_id": F.concat_ws(":", "doc_id", F.lit(3))})
    return S.insert_new(chunks, chunks.unionByName(extra).unionByName(extra), "chunk_id").select("chunk_id", "doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


def update_user_choice_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.incoming(spark, sf_dir).select("id", "user_choice_doc_id")
    return S.update_choice(S.update_choice(docs, "d7", "t0"), "nobody", "t0")


def replace_chunks_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = spark.createDataFrame([(0, "first"), (1, "second")], "ord int, text string")
    return S.replace_chunks(_doc_chunks(spark, sf_dir), "d7", edited).select("chunk_id", "doc_id", F.col("ord").cast("bigint").alias("ord"), "text")


def delete_template_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the three tables after deleting t10."""
    library, docs = _library(spark, sf_dir), _stored(spark, sf_dir)
    chunks = library.select(F.concat_ws(":", "id", F.lit(0)).alias("chunk_id"), F.col("id").alias("template_id"))
    left = S.delete_template(library, chunks, docs, "t10")
    name = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    return name(left[0], "template", "id").unionByName(name(left[1], "chunk", "chunk_id")).unionByName(name(left[2], "doc", "id"))


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tables after a session was cleared, a choice made, chunks edited and a template deleted; every change is made twice."""
    path = scratch.folder(spark, "store")
    store = tables.Store(spark, path, path.rsplit("/", 1)[1].replace("-", "_"))
    store.create_all()
    library, docs = fixtures.templates(spark, sf_dir), _stored(spark, sf_dir)
    texts = fixtures.documents(spark, sf_dir).select("doc_id", chunking.paragraphs(F.col("text"), "\n").alias("els"))
    chunks = chunking.chunk_documents(texts, F.col("els")).withColumns({"doc_id": F.concat(F.lit("d"), "doc_id"), "chunk_id": F.concat(F.lit("d"), "chunk_id")})
    store.insert("templates", library)
    store.insert("template_chunks", library.select(F.concat_ws(":", "id", F.lit(0)).alias("chunk_id"), F.col("id").alias("template_id"), F.lit(0).alias("ord"), F.col("title").alias("text")))
    store.insert("docs_inserted", docs)
    stored = store.read("docs_inserted").select(F.col("id").alias("doc_id"), "session_id")  # as stored: nothing is matched again
    store.insert("docs_inserted_chunks", chunks.join(stored, "doc_id"))
    edited = spark.range(2).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("edited "), "id").alias("text"))
    for _ in range(2):
        store.clear_session(SESSION)
        store.choose("s4", "d11", "t0")
        store.choose("s4", "nobody", "t0")
        store.replace_chunks("s5", "d12", edited)
        store.delete_template("t10")
    part = lambda kind, key, detail, session: store.read(kind).select(F.lit(kind).alias("kind"), F.col(session).alias("session_id") if session else F.lit(None).cast("string").alias("session_id"), F.col(key).alias("key"), F.col(detail).alias("detail"))
    found = part("docs_inserted", "id", "user_choice_doc_id", "session_id").unionByName(part("docs_inserted_chunks", "chunk_id", "text", "session_id"))
    found = found.unionByName(part("templates", "id", "name", "")).unionByName(part("template_chunks", "chunk_id", "text", ""))
    return found.withColumn("detail", F.md5("detail"))


def catalog_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table of templates without titles: probed, brought to the schema and probed again; its rows stay."""
    path = scratch.folder(spark, "store")
    store = tables.Store(spark, path, path.rsplit("/", 1)[1].replace("-", "_"))
    probe = lambda: f"{store.exists('templates')}:{'title' in store.columns('templates')}:{'title_emb' in store.columns('templates')}"
    seen = [probe()]
    store.create("templates", "id string, name string, version string, created_at timestamp_ntz, is_active boolean, embedding array<float>, part int")
    store.insert("templates", fixtures.templates(spark, sf_dir).drop("title", "title_emb"))
    seen.append(probe())
    added = ",".join(store.migrate("templates"))
    seen.append(probe())
    return store.read("templates").select("id", "name", "title", F.lit("|".join(seen)).alias("probes"), F.lit(added).alias("added"))


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose chosen template is not among those with a version."""
    docs = fixtures.incoming(spark, sf_dir).select("id", "user_choice_doc_id")
    return S.orphans(docs, "user_choice_doc_id", _library(spark, sf_dir).filter("version IS NOT NULL").select("id").withColumnRenamed("id", "key"), "key").select("id", "user_choice_doc_id")


def fk_join_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their documents and the templates chosen for those."""
    docs = fixtures.incoming(spark, sf_dir).select(F.col("id").alias("doc_id"), "session_id", "user_choice_doc_id")
    library = _library(spark, sf_dir).select(F.col("id").alias("user_choice_doc_id"), F.col("name").alias("template_name"))
    return _doc_chunks(spark, sf_dir).join(docs, "doc_id").join(library, "user_choice_doc_id").groupBy("template_name", "session_id").agg(F.count("*").alias("chunks"))


def vector_resize_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors normalised, then cut or filled to as many as 48 + vec_id % 32 components."""
    e = fixtures.table(spark, sf_dir, "embeddings")
    width = (48 + F.col("vec_id") % 32).cast("int")
    v = V.resize(V.normalise(V.as_double(F.col("embedding"))), width)
    return e.select("vec_id", v.alias("v")).select("vec_id", F.size("v").cast("bigint").alias("width"), F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


def _cosine(a: str, b: str) -> str:
    total = lambda x, y: f"list_sum([{x}[i] * {y}[i] FOR i IN range(1, len({x}) + 1)])"
    return f"{total(a, b)} / sqrt({total(a, a)} * {total(b, b)})"


STORED_SQL = f"""{fixtures.VECTORS_SQL},
pr AS (SELECT d.id, t.id AS template_id, list_cosine_similarity(d.embedding, t.embedding) AS doc_score, d.title_emb IS NOT NULL AS titled, CASE WHEN d.title_emb IS NULL OR t.title_emb IS NULL THEN 0 ELSE {_cosine('d.title_emb', 't.title_emb')} END AS title_score FROM incoming d CROSS JOIN templates t),
sc AS (SELECT *, CASE WHEN NOT titled THEN doc_score ELSE 0.7 * doc_score + 0.3 * title_score END AS score FROM pr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, template_id) AS r FROM sc WHERE score >= 0) WHERE r = 1),
stored AS (SELECT i.id, i.name, i.version, i.created_at, i.session_id, i.user_choice_doc_id, i.title, best.template_id AS similar_id, round(best.score, 6) AS similarity_score FROM incoming i LEFT JOIN best ON best.id = i.id),
doc_chunks AS (SELECT id || ':' || k AS chunk_id, id AS doc_id, k AS ord, 'text ' || id || ' ' || k AS text FROM incoming, range(3) r(k))"""
_RESULTS = """SELECT s.id, s.name, coalesce(s.version, '') AS version, s.created_at, t.name AS template_name, CASE WHEN t.id IS NOT NULL THEN coalesce(t.version, '') END AS template_version, nullif(similarity_score, 0) AS score, user_choice_doc_id, session_id
FROM stored s LEFT JOIN templates t ON t.id = s.similar_id"""
_BAND = "CASE WHEN similarity_score IS NULL OR similarity_score = 0 THEN 'unknown' WHEN similarity_score BETWEEN 0.9 AND 1 THEN 'match' WHEN similarity_score >= 0.8 AND similarity_score < 0.9 THEN 'likely' ELSE 'no_match' END"
_OPTIONS = "SELECT name || ' (v' || coalesce(version, '') || ')' AS label, arg_max(id, name || '|' || id) AS id FROM templates GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        template_top1,
        template_topk_threshold,
        template_doc_only,
        template_blocks_top1,
        template_ivf_all_lists,
        template_ivf_recall,
        fallback_model_match,
        similarity_bands,
        classification_counters,
        classification_results,
        session_results,
        document_with_choice,
        template_options,
        default_template_option,
        display_rows,
        session_stats,
        clear_session_state,
        insert_template_rows,
        insert_chunks_do_nothing,
        update_user_choice_state,
        replace_chunks_state,
        delete_template_state,
        stored_tables,
        catalog_migrate,
        orphan_check,
        fk_join_three_way,
        vector_resize_normalise,
    )
}
ORACLES = {
    "template_top1": "SELECT id, template_id, round(doc_score, 6) AS doc_score, round(title_score, 6) AS title_score, round(score, 6) AS score FROM best",
    "template_topk_threshold": "SELECT id, template_id, round(doc_score, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_score DESC, template_id) AS rank FROM pr WHERE doc_score >= 0.2) WHERE rank <= 3",
    "template_doc_only": "SELECT id, template_id, round(score, 6) AS score FROM best WHERE NOT titled",
    "template_blocks_top1": "SELECT id, template_id, round(doc_score, 6) AS doc_score, round(title_score, 6) AS title_score, round(score, 6) AS score FROM best",
    "template_ivf_all_lists": "SELECT id, template_id, round(doc_score, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_score DESC, template_id) AS rank FROM pr WHERE doc_score >= 0.2) WHERE rank <= 3",
    "template_ivf_recall": "SELECT CAST(sum(least(10, n)) AS BIGINT) AS neighbours, true AS enough FROM (SELECT a.vec_id, count(*) AS n FROM e a JOIN e b ON list_cosine_similarity(a.v, b.v) >= 0 WHERE a.vec_id % 50 = 0 GROUP BY 1)",
    "similarity_bands": f"SELECT {_BAND} AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM stored GROUP BY 1",
    "classification_counters": "SELECT count(*) AS processed, count(*) FILTER (similarity_score >= 0.5) AS classified, count(*) - count(*) FILTER (similarity_score >= 0.5) AS unclassified, round(100.0 * count(*) FILTER (similarity_score >= 0.5) / count(*), 6) AS rate FROM stored",
    "classification_results": f"{_RESULTS} ORDER BY created_at DESC NULLS FIRST, score DESC NULLS FIRST, s.id LIMIT 100",
    "session_results": f"{_RESULTS} WHERE session_id = '{SESSION}'",
    "document_with_choice": "SELECT s.id, s.name, nullif(similarity_score, 0) AS score, user_choice_doc_id, t.name AS chosen_name, t.version AS chosen_version FROM stored s LEFT JOIN templates t ON t.id = s.user_choice_doc_id",
    "template_options": _OPTIONS,
    "default_template_option": f"SELECT s.id, min(label) AS label FROM stored s JOIN ({_OPTIONS}) o ON o.id = s.similar_id GROUP BY s.id",
    "display_rows": "SELECT id, strftime(created_at, '%d.%m.%Y %H:%M') AS created, CASE WHEN similarity_score IS NULL OR similarity_score = 0 THEN '0%' ELSE printf('%.1f%%', floor(similarity_score * 1000 + 0.5) / 10.0) END AS share, substr(id, 1, 8) || '...' AS short_id, coalesce(similar_id, 'Не найден') AS template FROM stored",
    "session_stats": "SELECT session_id, count(*) AS total, count(nullif(similarity_score, 0)) AS classified, round(100.0 * count(nullif(similarity_score, 0)) / count(*), 6) AS rate FROM stored GROUP BY 1",
    "clear_session_state": f"SELECT i.id, session_id, count(*) AS chunks FROM incoming i JOIN doc_chunks c ON c.doc_id = i.id WHERE session_id <> '{SESSION}' GROUP BY 1, 2",
    "insert_template_rows": "SELECT id, name, version, is_active FROM templates UNION ALL SELECT 'n' || id, name, NULL, true FROM templates WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0",
    "insert_chunks_do_nothing": "SELECT chunk_id, doc_id, ord, text FROM doc_chunks UNION ALL SELECT doc_id || ':3', doc_id, 3, text FROM doc_chunks WHERE ord = 0 AND CAST(substr(doc_id, 2) AS BIGINT) % 10 = 1",
    "update_user_choice_state": "SELECT id, CASE WHEN id = 'd7' THEN 't0' ELSE user_choice_doc_id END AS user_choice_doc_id FROM incoming",
    "replace_chunks_state": "SELECT * FROM doc_chunks WHERE doc_id <> 'd7' UNION ALL SELECT 'd7:0', 'd7', 0, 'first' UNION ALL SELECT 'd7:1', 'd7', 1, 'second'",
    "delete_template_state": "SELECT 'template' AS kind, id AS key FROM templates WHERE id <> 't10' UNION ALL SELECT 'chunk', id || ':0' FROM templates WHERE id <> 't10' UNION ALL SELECT 'doc', id FROM stored WHERE similar_id IS DISTINCT FROM 't10' AND user_choice_doc_id IS DISTINCT FROM 't10'",
    "orphan_check": "SELECT id, user_choice_doc_id FROM incoming WHERE user_choice_doc_id IS NOT NULL AND user_choice_doc_id NOT IN (SELECT id FROM templates WHERE version IS NOT NULL)",
    "fk_join_three_way": "SELECT t.name AS template_name, session_id, count(*) AS chunks FROM doc_chunks c JOIN incoming i ON i.id = c.doc_id JOIN templates t ON t.id = i.user_choice_doc_id GROUP BY 1, 2",
    "vector_resize_normalise": """SELECT vec_id, len(w) AS width, round(sqrt(list_sum([x * x FOR x IN w])), 6) AS norm, round(w[1], 6) AS first, round(w[-1], 6) AS last FROM (
  SELECT vec_id, list_resize([x / (sqrt(list_sum([y * y FOR y IN v])) + 1e-12) FOR x IN v], CAST(48 + vec_id % 32 AS INT), 0.0::DOUBLE) AS w FROM e)""",
}
ORACLES = {k: f"WITH {STORED_SQL} {sql}" for k, sql in ORACLES.items()}
ORACLES["catalog_migrate"] = f"WITH {STORED_SQL} SELECT id, name, CAST(NULL AS VARCHAR) AS title, 'False:False:False|True:False:False|True:True:True' AS probes, 'title,title_emb' AS added FROM templates"
ORACLES["stored_tables"] = f"""WITH {text_queries.CHUNKS_SQL}, {STORED_SQL.replace('doc_chunks AS', 'made_chunks AS')},
kept AS (SELECT id, session_id, CASE WHEN id = 'd11' AND session_id = 's4' THEN 't0' ELSE user_choice_doc_id END AS choice, similar_id FROM stored WHERE session_id <> '{SESSION}'),
left_ AS (SELECT * FROM kept WHERE similar_id IS DISTINCT FROM 't10' AND choice IS DISTINCT FROM 't10'),
own AS (SELECT k.session_id, k.id, 'd' || c.chunk_id AS chunk_id, c.text FROM chunks c JOIN left_ k ON k.id = 'd' || c.doc_id WHERE k.id <> 'd12' OR k.session_id <> 's5'
  UNION ALL SELECT 's5', 'd12', 'd12:' || i, 'edited ' || i FROM range(2) r(i))
SELECT 'docs_inserted' AS kind, session_id, id AS key, md5(choice) AS detail FROM left_ UNION ALL SELECT 'docs_inserted_chunks', session_id, chunk_id, md5(text) FROM own
UNION ALL SELECT 'templates', NULL, id, md5(name) FROM templates WHERE id <> 't10' UNION ALL SELECT 'template_chunks', NULL, id || ':0', md5('title of ' || substr(id, 2)) FROM templates WHERE id <> 't10'"""
ORACLES["fallback_model_match"] = r"""
WITH t AS (SELECT doc_id, doc_id % 10 = 0 AS lib, unnest([x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') IF length(x) > 1]) AS term FROM documents),
tf AS (SELECT doc_id, lib, term, count(*) AS tf FROM t GROUP BY ALL),
vo AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE lib GROUP BY 1 ORDER BY total DESC, term LIMIT 4096),
id AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 10 = 0)) / (1 + df)) + 1 AS idf, row_number() OVER (ORDER BY term) AS pos FROM vo),
wt AS (SELECT doc_id, lib, pos, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM tf JOIN id ON id.term = tf.term),
cut AS (SELECT doc_id, lib, pos, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wt WHERE pos <= 1024),
pr AS (SELECT a.doc_id, b.doc_id AS t, sum(a.w * b.w) AS s FROM cut a JOIN cut b ON b.pos = a.pos WHERE NOT a.lib AND b.lib GROUP BY 1, 2),
known AS (SELECT DISTINCT doc_id FROM cut WHERE NOT lib)
SELECT known.doc_id, round(coalesce(max(s), 0), 6) AS similarity FROM known LEFT JOIN pr ON pr.doc_id = known.doc_id GROUP BY 1"""
