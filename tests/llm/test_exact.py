"""Operator 11 against brute force and its SQL, and its edge cases."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from clausewise.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for k, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(k)
    out = []
    for text, ids in groups.items():
        keep = max((k for k in ids if k is not None), default=None)
        ids = sorted(ids, key=lambda k: k != keep)
        out += [(k, keep, len(ids), j == 0, hashlib.sha256(text.encode()).hexdigest()) for j, k in enumerate(ids)]
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(3)
    rows = [(k, rng.choice(["One Copy", "one copy", "ONE COPY", "Ünder", "ünder"])) for k in range(400)]
    rows += [(1000 + k, "".join(rng.choice("abcXYZ é\n") for _ in range(rng.randrange(200)))) for k in range(300)]
    rows += [(2000 + k, rng.choice(rows)[1]) for k in range(200)]
    rows += [(3000, None), (3001, ""), (3002, " "), (3003, "x" * 300_000), (3004, "X" * 300_000), (3005, "x" * 300_001)]
    rows += [(None, "one copy"), (None, "nameless"), (None, "nameless"), (3006, "twice"), (3006, "Twice"), (3006, "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"table_bytes": 2000, "fan_out": 3}, {"table_bytes": 300, "table_ids": 7, "fan_out": 2}])
def test_op11_equals_brute_force_with_tables_of_any_size(spark, bounds):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "a", True) for r in rows], "doc_id long, text string, n int, bucket string, kept boolean").repartition(5)
    assert shown(exact_dedup.report(df, **bounds)) == brute(rows)


def test_op11_small_tables_are_spilled_more_than_once(spark, monkeypatch):
    spills = []
    written = exact_dedup.graph.table
    monkeypatch.setattr(exact_dedup.graph, "table", lambda df: spills.append(1) or written(df))
    rows = [(k, f"text number {k}") for k in range(500)]
    got = exact_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), table_bytes=60, fan_out=2)
    assert shown(got) == brute(rows) and len(spills) > 3


def test_op11_tells_texts_apart_whatever_their_hash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: b"\0" * 32)
    table = exact_dedup.Table()
    texts = [b"%d" % (k % 700) for k in range(1400)]
    assert [table.number(t, exact_dedup._digest(t)) for t in texts] == [k % 700 for k in range(1400)]
    assert table.bytes == sum(len(b"%d" % k) for k in range(700))


def test_op11_sends_records_in_bounded_batches():
    texts = [b"%05d" % k * 400 for k in range(4000)] + [b"x" * (3 << 20), b"y", b"Y"]
    source = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    got = list(exact_dedup._compact(iter([source]), 7, 4 << 20, 1 << 20))
    assert max(b.nbytes for b in got if b.num_rows > 1) < (1 << 20) + (1 << 18) and len(got) < 20
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["rid"] for r in rows] == list(range(7, 7 + len(texts) - 1)) and [r["text"] for r in rows] == [x.lower() for x in texts[:-1]]
    assert [r["ids"] for r in rows] == [[k] for k in range(4001)] + [[4001, 4002]] and rows[-1]["last"] == 4002


def test_op11_takes_other_kinds_of_ids_and_empty_tables(spark):
    rows = [("b", "x"), ("a", "X"), ("c", None), (None, "x")]
    got = shown(exact_dedup.report(spark.createDataFrame(rows, "doc_id string, text string")))
    assert got == brute(rows) and ("a", "b", 3, False, hashlib.sha256(b"x").hexdigest()) in got
    assert exact_dedup.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op11_keeps_one_row_with_all_columns(spark):
    rows = [(1, "A", 1, 2), (2, "a", 3, 4), (3, None, 5, 6), (4, "", 7, 8), (None, "é", 9, 0), (None, "É", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __SHA int")
    assert sorted(exact_dedup.keep_one(docs).collect(), key=repr) == sorted([rows[k] for k in (1, 3, 4, 5)], key=repr)


def test_op11_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({exact_dedup.SQL})").fetchall()
    assert shown(queries.op11_exact_dedup(spark, SF)) == sorted(want, key=repr)
