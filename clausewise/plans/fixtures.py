"""Derived tables: contracts, templates and incoming documents made from the driver's tables.

Each is given twice: as a DataFrame for the engine's queries and as SQL for their oracles.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime.date(2025, 1, 1)
STUB = "Договор поставки № 7"

# Clauses spliced into prose, by modulus of doc_id.
CLAUSES = {
    9: {
        1: "Срок действия договора составляет 2 года.",
        2: "Срок действия договора 5 лет.",
        3: "Срок действия договора 48 месяцев.",
        4: "Срок действия договора бессрочный.",
        5: "Срок действия договора до 31 декабря 2026 года.",
        6: "Срок действия договора до 31 декабря 2099 года.",
        7: "Срок действия договора до 31.12.2025.",
        8: "Договор действует до полного выполнения обязательств.",
    },
    7: {
        1: "Оплата в течение 60 календарных дней.",
        2: "Оплата в течение 30 календарных дней.",
        3: "Оплата в течение 30 календарных дней согласно 44 фз.",
        4: "Оплата в течение 20 рабочих дней.",
        5: "Оплата в течение тридцати дней.",
        6: "Оплата в течение шестидесяти дней.",
    },
    5: {1: "Предусмотрена предоплата 30 процентов.", 2: "Предоплата не предусмотрена.", 3: "Аванс выплачивается при наличии одобрения.", 4: "Работа без аванса."},
    11: {5: "Услуги: приемка в течение 3 рабочих дней.", 6: "Работы: приемка в течение 10 рабочих дней.", 7: "Оказание услуг."},
    4: {1: "Платежный день: один раз в неделю.", 2: "Платежный день: два раза в неделю."},
    13: {
        1: "Подписан протокол разногласий.",
        2: "Договор по форме контрагента.",
        3: "Установлены особые условия поставки.",
        4: "Особые условия: гарантийный срок.",
        5: "Спецификация прилагается.",
        6: "Рамочный договор на поставку.",
        7: "Рамочный договор, лимит 100.",
        8: "Дополнительное соглашение.",
        9: "Отзыв заявки.",
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where the table has fewer files than there are cores: a file may be one row group,
    and so one task, and texts take far longer to work on than to move. A table of many files is read as it lies."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores, "doc_id") if len(docs.inputFiles()) < cores else docs


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: prose with clauses, and a stub of a contract, with a negative id, beside every 50th."""
    docs, text = documents(spark, sf_dir), F.col("text")
    for modulus, clauses in CLAUSES.items():
        added = F.lit("")
        for k, clause in clauses.items():
            added = F.when(F.col("doc_id") % modulus == k, F.lit("\n" + clause)).otherwise(added)
        text = F.concat(text, added)
    stubs = docs.filter("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(STUB).alias("text"))
    return docs.select("doc_id", text.alias("text")).unionByName(stubs)


def contracts_sql() -> str:
    parts = ["CASE doc_id % {} {} ELSE '' END".format(m, " ".join(f"WHEN {k} THEN chr(10) || '{c}'" for k, c in clauses.items())) for m, clauses in CLAUSES.items()]
    return "SELECT doc_id, text || " + " || ".join(parts) + f" AS text FROM documents UNION ALL SELECT -1 - doc_id, '{STUB}' FROM documents WHERE doc_id % 50 = 0"


MIX = [0.0, 1.0, 1.5, 2.0, 3.0, 5.0]


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e, e.count()


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the templates table; every tenth vector is one."""
    e, n = _vectors(spark, sf_dir)
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    title = e.select(F.col("vec_id").alias("tid"), F.col("v").alias("tv"))
    own = e.filter("vec_id % 10 = 0").join(events, F.col("event_id") == F.col("vec_id"), "left").join(title, F.col("tid") == (F.col("vec_id") + 1) % n, "left")
    return own.select(
        F.concat(F.lit("t"), "vec_id").alias("id"),
        F.concat(F.lit("template_"), "label", F.lit("_"), "vec_id").alias("name"),
        F.when(F.col("vec_id") % 20 != 0, "1").alias("version"),
        F.date_trunc("hour", "ts").alias("created_at"),
        (F.col("vec_id") % 40 != 0).alias("is_active"),
        F.col("v").alias("embedding"),
        F.concat(F.lit("title of "), "vec_id").alias("title"),
        F.when(F.col("vec_id") % 30 != 0, F.col("tv")).alias("title_emb"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of docs_inserted without the results of matching; vectors lean towards those of a base template."""
    e, n = _vectors(spark, sf_dir)
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    base = F.col("vec_id") - F.col("vec_id") % 10
    share = F.element_at(F.array(*map(F.lit, MIX)), (F.col("vec_id") % len(MIX) + 1).cast("int"))
    side = lambda name: e.select(F.col("vec_id").alias(name), F.col("v").alias(name + "v"))
    own = e.filter("vec_id % 10 <> 0").withColumns({"base": base, "share": share})
    own = own.join(events, F.col("event_id") == F.col("vec_id"), "left").join(side("b"), F.col("b") == F.col("base")).join(side("q"), F.col("q") == (F.col("vec_id") + 7) % n).join(side("p"), F.col("p") == (F.col("base") + 1) % n)
    mixed = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.col("share") * y)
    return own.select(
        F.concat(F.lit("d"), "vec_id").alias("id"),
        F.concat(F.lit("doc_"), "vec_id").alias("name"),
        F.lit("").alias("version"),
        F.date_trunc("hour", "ts").alias("created_at"),
        F.lit(True).alias("is_active"),
        mixed("v", "bv").alias("embedding"),
        F.concat(F.lit("s"), F.col("vec_id") % 7).alias("session_id"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("t"), "base")).alias("user_choice_doc_id"),
        F.when(F.col("vec_id") % 11 == 0, "").otherwise(F.concat(F.lit("title of "), "vec_id")).alias("title"),
        F.when(F.col("vec_id") % 11 != 0, mixed("qv", "pv")).alias("title_emb"),
    )


VECTORS_SQL = """
e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
templates AS (
  SELECT 't' || e.vec_id AS id, 'template_' || e.label || '_' || e.vec_id AS name, CASE WHEN e.vec_id % 20 <> 0 THEN '1' END AS version,
         date_trunc('hour', ts) AS created_at, e.vec_id % 40 <> 0 AS is_active, e.v AS embedding, CASE WHEN e.vec_id % 30 <> 0 THEN t.v END AS title_emb
  FROM e CROSS JOIN n LEFT JOIN events ON event_id = e.vec_id LEFT JOIN e t ON t.vec_id = (e.vec_id + 1) % n WHERE e.vec_id % 10 = 0
), incoming AS (
  SELECT 'd' || e.vec_id AS id, 'doc_' || e.vec_id AS name, '' AS version, date_trunc('hour', ts) AS created_at,
         [e.v[i] + ([0.0, 1.0, 1.5, 2.0, 3.0, 5.0])[e.vec_id % 6 + 1]::DOUBLE * b.v[i] FOR i IN range(1, len(e.v) + 1)] AS embedding,
         's' || e.vec_id % 7 AS session_id, CASE WHEN e.vec_id % 3 = 0 THEN 't' || (e.vec_id - e.vec_id % 10) END AS user_choice_doc_id,
         CASE WHEN e.vec_id % 11 = 0 THEN '' ELSE 'title of ' || e.vec_id END AS title,
         CASE WHEN e.vec_id % 11 <> 0 THEN [q.v[i] + ([0.0, 1.0, 1.5, 2.0, 3.0, 5.0])[e.vec_id % 6 + 1]::DOUBLE * p.v[i] FOR i IN range(1, len(e.v) + 1)] END AS title_emb
  FROM e CROSS JOIN n LEFT JOIN events ON event_id = e.vec_id JOIN e b ON b.vec_id = e.vec_id - e.vec_id % 10
  JOIN e q ON q.vec_id = (e.vec_id + 7) % n JOIN e p ON p.vec_id = (e.vec_id - e.vec_id % 10 + 1) % n WHERE e.vec_id % 10 <> 0
)"""
