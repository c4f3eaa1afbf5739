"""Operators 1, 2 and 4 against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.llm import embed_dedup, ngram_join, queries, suffix_dedup

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def roots(nodes, pairs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def cosine_pairs(rows, threshold=0.9):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)]


def test_op1_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    more = [(1000 + i, (np.array(base[i % 40][1]) + rng.normal(0, 0.04, 64)).astype(np.float32).tolist()) for i in range(400)]
    hot = [(2000 + i, base[7][1]) for i in range(150)]
    rows = base + more + hot
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    pairs = cosine_pairs(rows)
    links = Counter(x for p in pairs for x in p)
    assert len(pairs) > 10_000
    found, wanted = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert found >= 0.995 * wanted
    assert all(r["n_links"] <= links[k] for k, r in got.items())
    want = roots([r[0] for r in rows], pairs)
    assert sum(got[k]["component_id"] == want[k] for k in want) >= 0.99 * len(want)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_op1_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, None), (4, [0.0] * 3), (5, [float("nan"), 1.0, 2.0]), (6, [1.0, None, 2.0]), (7, []), (8, [1.0, 2.0]), (9, [2.0, 4.0, 6.0]), (10, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, size int, rep string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False)} | {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10)}
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_op1_repeated_ids_with_different_vectors(spark):
    v, u = np.array([1.0, 0, 0, 0]), np.array([0, 0, 1.0, 0])
    tilt = np.array([0, 0.1, 0, 0])
    rows = [(5, v), (5, u), (6, v + tilt), (7, u + tilt), (8, u + 2 * tilt)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in rows], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False)]


def test_op1_recall_with_many_bits_and_blocks(spark, monkeypatch):
    """Buckets of as many bits as 10,000,000 vectors have, cut into blocks."""
    monkeypatch.setattr(embed_dedup, "BUCKET", 4)
    monkeypatch.setattr(embed_dedup, "BLOCK", 48)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(150, 64))
    rows = [(i, (centre[i % 150] + rng.normal(size=64) * rng.choice([0.1, 0.2, 0.33])).tolist()) for i in range(2000)]
    rows += [(3000 + i, (centre[0] + rng.normal(size=64) * 0.05).tolist()) for i in range(300)]
    assert embed_dedup.plan(len(rows), 0.9, 0.999)[0] >= 9
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = Counter(x for p in cosine_pairs(rows) for x in p)
    assert sum(r["n_links"] for r in got.values()) >= 0.999 * sum(links.values())
    assert all(r["n_links"] <= links[k] for k, r in got.items())


def gram_sets(rows, n=5):
    out = {}
    for k, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[k] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    return out


def jaccard_links(sets, threshold=0.8):
    where = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    both = Counter()
    for ks in where.values():
        both.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1 :])
    return [(a, b) for (a, b), c in both.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000").collect()]
    rng = random.Random(5)
    base = next(t for _, t in rows if 900 < len(t) < 1500).split(" ")
    for k in range(300):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(words)))
    return rows


def test_op2_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in ngram_join.links(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = gram_sets(texts)
    pairs = jaccard_links(sets)
    links, want = Counter(x for p in pairs for x in p), roots(sets, pairs)
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * sum(links.values())
    assert all(r["n_links"] <= links[k] for k, r in got.items())
    assert sum(got[k]["component_id"] == want[k] for k in want) >= 0.99 * len(want)
    kept = ngram_join.keep_one(spark.createDataFrame([(a, b, "q") for a, b in texts], "doc_id long, text string, rep string"))
    assert kept.columns == ["doc_id", "text", "rep"]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_op2_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one, TWO!"), (5, "..."), (6, "é" * 50_000), (None, "one two"), (7, "one two"), (7, "one two")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    got = sorted((tuple(r) for r in ngram_join.links(df).drop("th").collect()), key=str)
    linked = (3, 3, 3, 3, True), (4, 3, 3, 3, False), (7, 3, 3, 3, False), (7, 3, 3, 3, False)
    alone = [(k, k, 0, k, True) for k in (1, 2, 5, 6, None)]
    assert got == sorted([*linked, *alone], key=str)
    assert ngram_join.links(df.limit(0)).collect() == []


def test_op2_repeated_ids_with_different_texts(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(5, a), (5, a + " zz"), (6, a + " yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[0:1] + tuple(r)[2:] for r in ngram_join.links(df).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(5, 2, 5), (5, 2, 5), (6, 2, 5)]
    assert sum(r[4] for r in got) == 1
    kept = ngram_join.keep_one(df).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 5
    assert ngram_join.keep_one(spark.createDataFrame([*rows, *rows], df.schema)).distinct().count() == 1


@pytest.mark.parametrize("n", [2048, 4096])
def test_op2_tells_crafted_texts_apart(spark, n):
    """Texts whose polynomial hashes modulo 2 ** 64 are equal for any base."""
    rows = [(k, "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n))) for k in range(2)]
    got = ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_links"] for r in got] == [0, 0]


def test_op2_plan_reaches_recall():
    bands, rows = ngram_join.plan(0.8, 0.999)
    assert bands * rows <= 224 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def removed(rows, length=200):
    seen = Counter()
    data = {i: (k, (t or "").encode()) for i, (k, t) in enumerate(rows)}
    for _, b in data.values():
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, b in data.values():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [256, 3])
def test_op4_equals_brute_force(spark, texts, shard):
    rng = random.Random(9)
    rows = texts[:300] + texts[-60:]
    passage = texts[3][1][:700]
    for k in range(40):
        start, end = rng.randrange(300), rng.randrange(400, 700)
        rows.append((9000 + k, f"{rng.random()} {passage[start:end]} {rng.random()}"))
    rows += [(9500, "ab" * 900), (9501, "z" * 500), (9502, "q" * 200), (9503, "q" * 201), (9504, None), (9505, ""), (9506, "é" * 150), (9507, "é" * 99 + "x")]
    rows += [(9508, "the same row " * 30), (9508, "the same row " * 30), (None, passage)]
    df = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, packed binary")
    got = suffix_dedup.deduplicate(df, shard=shard, with_bytes=False)
    assert sorted((tuple(r) for r in got.collect()), key=str) == removed(rows)


def test_op4_returns_the_bytes(spark):
    rows = [(1, "a" * 10 + "0123456789" * 3 + "b" * 10), (2, "0123456789" * 3)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), length=24).collect()}
    assert got == {1: b"a" * 10 + b"b" * 10, 2: b""}
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.op4_suffix_dedup(spark, SF)
    assert got.count() == n and got.agg(F.sum("n_removed")).first()[0] > 0
