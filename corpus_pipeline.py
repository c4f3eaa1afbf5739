"""From raw documents to training tokens: language, repeated lines, near copies, benchmark leaks, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import decontaminate, lang_id, line_dedup, ngram_join, piece_sampling, queries, token_store

#: The mean probability under which a language is not believed, for texts of any length: little above chance among four
#: languages, as short clean texts are unsure.
LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (nulls and empty texts too) and those whose language is not recognised go.

    Other columns are kept as they are, also such as are called lang_pred or score; rows that repeat have the
    same fate; of an empty table nothing is left. Whole texts are read, however long.
    """
    model = lang_id.fit(docs, F.lit(True))
    return lang_id.identify(docs, model, reject_below=LANGUAGE_SCORE, labels=False)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents that had nothing else.

    Nulls, empty texts and texts of blank lines stay as they are. Rows that repeat id and text are one document and
    keep the same lines; of different texts with one id that of the least hash comes first. A column n_chars, if
    there is one, is counted anew; all others are kept, but for n_lines, n_removed and kept_sha256, which are not
    columns of documents and go.
    """
    kept = line_dedup.deduplicate(docs, drop_emptied=True)
    kept = kept.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_sha256")])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Nulls, texts without words and rows without id stay. Rows that repeat both id and text stay or go together: an exact
    repeat of a kept row is kept too. All columns are kept.
    """
    return ngram_join.keep_one(docs, n=5, threshold=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or all words of a shorter one, go.

    Nulls and texts without words stay, and so does everything if the benchmark is empty. Rows that repeat have the
    same fate. All columns are kept.
    """
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), n=10)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with text as it is decoded from the pieces, pieces and n_pieces (columns of these names are replaced).

    Nulls become empty texts, which have no pieces. Rows that repeat id and text get the same pieces. Other columns
    are kept as they are.
    """
    keep = [c for c in docs.columns if c not in ("text", "pieces", "n_pieces")]
    encoded = piece_sampling.encode(docs, queries.vocabulary("piece_bpe_32k.model"), keep=keep, decoded="text", checks=False)
    return encoded.select(*keep, "pieces", "n_pieces", "text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", pieces),
]

#: A trained network, edit distances between all lines and sampled pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    out, docs = token_store.scratch(spark), queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
    return docs
