"""Columns of callers may have any name: also all names that operators and stages use within."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewise import llm
from clausewise.llm import exact_dedup, lang_id, license_scan, line_dedup, piece_sampling, queries, toxicity

SF = "/root/testdata/sf0.001"
NAMES = set()
for file in pathlib.Path(llm.__file__).parent.glob("*.py"):
    NAMES |= set(re.findall(r"[\"'](\w{1,20})[\"']", file.read_text("utf-8")))
#: Columns that operators read or replace; all others are the caller's.
OWN = {"doc_id", "text", "path", "lang", "source", "n_chars", "lang_pred", "score", "predicted", "pieces", "n_pieces", "pieces_crc32", "lossless", "n_lines", "n_removed", "kept_sha256", "licence", "licence_score", "licence_from", *license_scan.MADE}
EXTRA = sorted(n for n in {n.lower(): n for n in NAMES if not n.isdigit()}.values() if n.lower() not in OWN)


@pytest.fixture(scope="module")
def both(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("*", F.concat_ws("/", "source", "doc_id").alias("path")).cache()
    return docs, docs.select("*", *[F.lit(f"own {n}").alias(n) for n in EXTRA])


def test_there_are_names_to_try():
    assert {"gone", "above", "dl", "ds", "__id", "__doc", "__dir", "__packed"} <= set(EXTRA) and len(EXTRA) > 100


OPERATORS = {
    "op3": lambda df: license_scan.inherit(license_scan.scan(df)),
    "op5": line_dedup.deduplicate,
    "op7": lambda df: lang_id.identify(df, None),
    "op8": lambda df: toxicity.score(df, toxicity.Model(toxicity.np.zeros(0, int), toxicity.np.zeros(0), -1.0)),
    "op9": lambda df: piece_sampling.encode(df, queries.vocabulary("piece_bpe_32k.model")),
    "op11": exact_dedup.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_columns_of_any_name(spark, both, name):
    docs, more = both
    more = more.withColumns({n: F.lit(f"own {n}") for n in ("__text", "__key", "__letters")})
    plain, extra = OPERATORS[name](docs), OPERATORS[name](more)
    columns = plain.columns
    assert set(EXTRA) <= set(extra.columns) and {"__text", "__key", "__letters"} <= set(extra.columns)
    assert all(extra.filter(F.col(n) != f"own {n}").isEmpty() for n in ("gone", "above", "__text", "__key", "__id"))
    key = lambda df: sorted(str(r) for r in df.select(*columns).collect())
    assert key(plain) == key(extra)


def test_stages_keep_columns_of_any_name_and_take_empty_tables_and_repeated_rows(spark, both):
    docs, more = both
    more = more.withColumns({n: F.lit(f"own {n}") for n in ("__text", "__key", "__letters")})
    twice, none = docs.unionByName(docs), more.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        plain, extra = stage(spark, docs, SF), stage(spark, more, SF)
        key = lambda df, columns=plain.columns: sorted(str(r) for r in df.select(*columns).collect())
        assert key(plain) == key(extra) and {"gone", "above", "__text", "__id"} <= set(extra.columns)
        assert stage(spark, none, SF).count() == 0
        once = {r["doc_id"] for r in plain.collect()}
        assert {r["doc_id"] for r in stage(spark, twice, SF).collect()} == once
