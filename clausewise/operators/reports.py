"""Reports on stored documents: joins with templates, lists, options, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(score: str):
    """A stored score of 0 stands for none."""
    return F.nullif(F.col(score), F.lit(0.0))


def results(docs: DataFrame, templates: DataFrame, limit: int | None = None, session: str | None = None) -> DataFrame:
    """Documents with the names of their templates, latest and best first (nulls before both), ties by id.

    session restricts to one session before the join.
    """
    if session is not None:
        docs = docs.filter(F.col("session_id") == session)
    t = templates.select(F.col("id").alias("similar_id"), F.col("name").alias("template_name"), F.coalesce("version", F.lit("")).alias("template_version"))
    out = docs.join(t, "similar_id", "left").select(
        "id", "name", F.coalesce("version", F.lit("")).alias("version"), "created_at", "template_name", "template_version", _known("similarity_score").alias("score"), "user_choice_doc_id", "session_id"
    )
    ordered = out.orderBy(F.desc_nulls_first("created_at"), F.desc_nulls_first("score"), "id")
    return ordered if limit is None else ordered.limit(limit)


def with_choice(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents with the template that the user chose, if any."""
    t = templates.select(F.col("id").alias("user_choice_doc_id"), F.col("name").alias("chosen_name"), F.col("version").alias("chosen_version"))
    return docs.join(t, "user_choice_doc_id", "left").select("id", "name", _known("similarity_score").alias("score"), "user_choice_doc_id", "chosen_name", "chosen_version")


def options(templates: DataFrame) -> DataFrame:
    """One option per label "name (vversion)"; of templates with the same label the last in order of name and id counts."""
    label = F.concat(F.col("name"), F.lit(" (v"), F.coalesce("version", F.lit("")), F.lit(")"))
    return templates.groupBy(label.alias("label")).agg(F.max_by("id", F.struct("name", "id")).alias("id"))


def by_name(templates: DataFrame, collation: str | None = None) -> DataFrame:
    """Templates in order of their names, ties by id; a collation (such as UNICODE) orders them as a language does."""
    name = F.col("name") if collation is None else F.collate("name", collation)
    return templates.orderBy(name, "id")


def browse(table: DataFrame, limit: int = 100, key: str = "id") -> DataFrame:
    """The first rows in order of the key."""
    return table.orderBy(key).limit(limit)


def lookup(table: DataFrame, key_value: str, key: str = "id") -> DataFrame:
    """The rows with one key; none for a key that is unknown or null."""
    return table.filter(F.col(key) == key_value)


def referred(templates: DataFrame, docs: DataFrame, key: str = "similar_id") -> DataFrame:
    """Those templates for which a document with their id as key exists."""
    return templates.join(docs.select(F.col(key).alias("id")), "id", "left_semi")


def default_option(docs: DataFrame, opts: DataFrame) -> DataFrame:
    """The first label, in order, of each document's matched template."""
    return docs.join(opts.withColumnRenamed("id", "similar_id"), "similar_id").groupBy(docs["id"]).agg(F.min("label").alias("label"))


def display(docs: DataFrame) -> DataFrame:
    """Dates, shares and ids as they are shown."""
    share = F.when(_known("similarity_score").isNull(), "0%").otherwise(F.format_string("%.1f%%", F.floor(F.col("similarity_score") * 1000 + 0.5) / 10.0))
    return docs.select(
        "id", F.date_format("created_at", "dd.MM.yyyy HH:mm").alias("created"), share.alias("share"), F.concat(F.substring("id", 1, 8), F.lit("...")).alias("short_id"), F.coalesce("similar_id", F.lit("Не найден")).alias("template")
    )


def session_stats(docs: DataFrame) -> DataFrame:
    """Documents of each session, those with a score, and the rate in percent."""
    hit = F.count(_known("similarity_score"))
    return docs.groupBy("session_id").agg(F.count("*").alias("total"), hit.alias("classified"), F.round(100.0 * hit / F.count("*"), 6).alias("rate"))
