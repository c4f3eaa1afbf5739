"""Operator 12 against plain sums over all terms and its SQL, and its edge cases."""

import random
import re
from collections import Counter
from itertools import islice

import duckdb
import pytest

from clausewise.llm import divergence, queries

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, scale=10**9, top=10):
    rows = [[x or "" for x in r] for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, total, own = Counter(), Counter(), {}
        for _, source, w in (x for x in words if x[0] == lang):
            df.update(set(w)), total.update(w), own.setdefault(source, Counter()).update(w)
        kept = [t for t in df if df[t] >= min_docs]
        share = lambda c: {t: 1 + scale * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = share(total), {s: share(c) for s, c in own.items()}
        for s in own:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s], "term": [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "Été", "straße", "x1y", "don't", "日本", "_a_b", "zz"] + [f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(24)]
    rows = []
    for k in range(500):
        lang = rng.choice(["en", "en", "de", None, "", "rare"]) if k % 50 else "lone"
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "é", None, "", "z"])
        own = words[:6] + rng.sample(words, 8)
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randrange(30))), lang, source))
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("123 456", "numbers", "only"), ("1", "numbers", "too"), ("the " * 50_000, "en", "long"), ("q" * 30_000 + " the", "en", "long")]
    return rows


@pytest.mark.parametrize("groups", [100_000, 0])
def test_op12_equals_sums_over_all_terms(spark, monkeypatch, groups):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(divergence, "HELD", 150)
    monkeypatch.setattr(divergence, "PART", 1000)
    rows = corpus()
    df = spark.createDataFrame([(*r, k, 1, "x") for k, r in enumerate(rows)], "text string, lang string, source string, doc_id int, n int, term string").repartition(4)
    assert shown(divergence.audit(df)) == brute(rows)


def test_op12_parameters_repeated_rows_and_empty_tables(spark):
    rows = corpus(6)[:120] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert shown(divergence.audit(df, min_docs=3, scale=1000, top=2)) == brute(rows, 3, 1000, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_op12_shares_are_exact_beyond_64_bits(spark):
    n, total = 7 * 10**17 + 3, 9 * 10**17 + 11
    row = spark.range(1).select(divergence._share(divergence.F.lit(n), divergence.F.lit(total), 10**9).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // total


def test_op12_cuts_long_texts_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 10)
    text = "Ab cd efghijklmnopqrstuvwxyz 12 ÄÖ, the end of it".encode()
    assert [w.decode() for part in divergence.terms(text) for w in part] == ["ab", "cd", "efghijklmnopqrstuvwxyz", "ÄÖ", "the", "end", "of", "it"]


@pytest.mark.parametrize("text", [" " + "q" * 30, "a " + "q" * 30, "a " + "q" * 30 + " " + "r" * 30, "   " + "q" * 9 + " b", " " * 25, "q" * 25 + " "])
def test_op12_comes_to_an_end_with_long_words_behind_blanks(monkeypatch, text):
    monkeypatch.setattr(divergence, "PART", 10)
    parts = list(islice(divergence.terms(text.encode()), 50))
    assert len(parts) < 50 and [w.decode() for part in parts for w in part] == text.split()


def test_op12_counts_words_longer_than_a_part(spark):
    rows = [(f"the {'q' * (divergence.PART + 5)} the x{'y' * k}", "en", "ab"[k % 2]) for k in range(4)]
    assert shown(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=2)) == brute(rows, 2)


def test_op12_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = shown(queries.op12_source_divergence(spark, sf))
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.SQL})").fetchall()) and any(r[2] == "term" for r in got)
