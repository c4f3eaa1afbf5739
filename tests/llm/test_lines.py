"""Operator 5 against brute force, and its edge cases."""

import hashlib
import random

import numpy as np
import pytest

from clausewise.llm import bytesops, line_dedup

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\r\x0b\x0c"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute(rows, near_chars):
    """Of rows in order: (doc_id, lines, removed, digest, text)."""
    seen, long, out = set(), [], []
    for k, text in rows:
        lines, keep, total, gone = (text or "").split("\n"), [], 0, 0
        for x in lines:
            s = x.strip(SPACE)
            total += bool(s)
            near = len(s) >= near_chars and s not in seen and any(within_one(s, y) for y in long)
            if s and (s in seen or near):
                gone += 1
            else:
                keep.append(x)
            if s and s not in seen:
                seen.add(s)
                if len(s) >= near_chars - 1:
                    long.append(s)
        new = None if text is None else "\n".join(keep)
        out.append((k, total, gone, hashlib.sha256((new or "").encode()).hexdigest(), new))
    return out


def near_edits(rng, line):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + "é" + line[k:], line[:k] + line[k + 1 :], line[:k] + "#" + line[k + 1 :]])


def test_op5_equals_brute_force(spark):
    rng = random.Random(4)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2500").limit(150).collect())
    pool = [x for _, t in docs for x in t.split("\n") if len(x) > 20][:60]
    for k in range(120):
        lines = [near_edits(rng, rng.choice(pool)) for _ in range(4)] + [f"unique line number {rng.random()}"] + [rng.choice(pool)]
        docs.append((10_000 + k, "\n".join(rng.sample(lines, 6)) + rng.choice(["", "\n", "\n\n"])))
    docs += [(20_000 + k, f"a line of a large group of near lines {chr(97 + k % 26)}\nshort {k % 7}") for k in range(300)]
    short = [f"ab {k:05d}" for k in range(0, 400, 7)] + ["1234567", "12345678", "1234567x", "\u00e9" * 7, "\u00e9" * 8]
    docs += [(25_000 + k, "\n".join(rng.sample(short, 3))) for k in range(40)]
    docs += [(30_000, None), (30_001, ""), (30_002, " \n\t\n"), (30_003, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (30_004, "aaaaaaaaaaaaaaaaaaaaaaaaaaa"), (30_005, "x" * 70_000), (30_006, "x" * 70_001)]
    df = spark.createDataFrame([(*r, 1) for r in random.Random(1).sample(docs, len(docs))], "doc_id long, text string, n_lines int")
    got = sorted(line_dedup.deduplicate(df).select("doc_id", "n_lines", "n_removed", "kept_sha256", "text").collect())
    want = brute(docs, line_dedup.NEAR_CHARS)
    assert [tuple(r) for r in got] == want
    kept = line_dedup.deduplicate(df, drop_emptied=True)
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in want if not w[1] or w[2] < w[1]}


def test_op5_tells_crafted_lines_apart(spark):
    """Lines whose polynomial hashes modulo 2 ** 64 are equal for any base."""
    texts = [(k, "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n))) for n in (2048, 4096) for k in range(2)]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(9, texts[1][1])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {9: ""}


def test_op5_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicate(empty).collect() == []
    rows = [(5, "one line here and there"), (5, "one line here and there"), (None, "one line here and there\nb"), (6, "one line here and theree")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # rows without an id come first
    assert got == [("5", ""), ("5", ""), ("6", ""), ("None", "one line here and there\nb")]


@pytest.mark.parametrize("regions", [2, 16])
def test_frames_lose_no_neighbour(regions):
    rng = random.Random(2)
    for _ in range(300):
        line = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 50)))
        other = near_edits(rng, line)
        keys = []
        for x in (line, other):
            data = np.frombuffer(x.encode(), np.uint8)
            place, before = line_dedup.characters(data)
            keys.append(set(line_dedup.frames(bytesops.prefix_hash(data), place, before[[0]], before[[len(data)]], regions)[0].tolist()))
        assert keys[0] & keys[1]
