"""The named queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embed_dedup, exact_dedup, lang_id, license_scan, line_dedup, ngram_join, oracles, piece_sampling, suffix_dedup, token_store, toxicity, turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers that are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("th")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; documents are taken to lie in directories by source and by thousands and hundreds of their ids."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.inherit(license_scan.scan(docs.select("doc_id", place.alias("path"), "text")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), length=200, with_bytes=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    path = token_store.scratch(spark)
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_file or vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.read(spark, path, with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"), 3, 1)
    model = lang_id.fit(docs, ~held)
    return lang_id.identify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), model_file or vocabulary("piece_bpe_32k.model"), keep=["doc_id"], digest=True)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return turns.with_all(turns.report(turns.damage(given)), given)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_ngram_jaccard, op3_license_scan, op4_suffix_dedup, op5_line_dedup, op6_token_files, op7_language_id, op8_toxicity, op9_sentencepiece, op10_decontaminate, op11_exact_dedup, op12_source_divergence, op13_conversation_repair)}
ORACLES = {"op1_embedding_dedup": oracles.OP1, "op2_ngram_jaccard": oracles.OP2, "op4_suffix_dedup": oracles.OP4, "op5_line_dedup": oracles.OP5, "op10_decontaminate": decontaminate.SQL, "op11_exact_dedup": exact_dedup.SQL, "op12_source_divergence": divergence.SQL, "op13_conversation_repair": turns.SQL}
