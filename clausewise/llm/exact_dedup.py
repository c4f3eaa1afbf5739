"""Exact deduplication by Grace hashing: records are dealt to buckets by a hash until the texts of each bucket fit a table.

Every task first meets its own copies in an open-addressing table and sends one record for each
different text, whatever the number of copies, so a group that holds a third of all rows is a
record a task. The records are written (the spill files of the first level), dealt to buckets, and
each bucket's texts meet in a table again. A bucket whose different texts are more than the
bound is spilled and dealt anew by a fresh hash, and so on. Tables compare complete contents;
hashes only say where to look. Ids stay with the records and are joined by record, never by text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops, graph

#: Bytes of different texts in a table, ids that a task holds at most beside them, and buckets that a spilled one is dealt to.
TABLE_BYTES, TABLE_IDS, FAN_OUT = 32 << 20, 1 << 20, 64
#: Rows that are taken from a batch at once, and bytes of texts and number of ids that are sent at once; a longer text is sent alone.
TAKEN, SENT_BYTES, SENT_IDS = 256, 1 << 20, 1 << 16


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class Table:
    """Numbers for texts, in order of first sight. A slot holds the number of an entry or -1; steps are linear."""

    def __init__(self) -> None:
        self.slots, self.texts, self.digests, self.bytes = array("i", [-1]) * 1024, [], [], 0

    def number(self, text: bytes, digest: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.texts[k] == text:
                return k
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.texts.append(text)
        self.digests.append(digest)
        self.bytes += len(text)
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = array("i", [-1]) * (mask + 1)
        for k, digest in enumerate(self.digests):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """The rows of a batch; only a few of them are Python objects at a time."""
    for at in range(0, batch.num_rows, TAKEN):
        yield from zip(*(batch.column(c).slice(at, TAKEN).to_pylist() for c in names), strict=True)


def _compact(source: Iterator[pa.RecordBatch], rid: int, table_bytes: int, table_ids: int) -> Iterator[pa.RecordBatch]:
    """The records of doc_id, text in batches of bounded size, numbered from rid."""
    table, ids, held = Table(), [], 0

    def flush(of: pa.DataType) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(ids):
            to, size, n = at, 0, 0
            while to < len(ids) and (to == at or (size + len(table.texts[to]) <= SENT_BYTES and n + len(ids[to]) <= SENT_IDS)):
                size, n, to = size + len(table.texts[to]), n + len(ids[to]), to + 1
            last = [max((x for x in group if x is not None), default=None) for group in ids[at:to]]
            arrays = [pa.array(range(rid + at, rid + to), pa.int64()), pa.array(table.digests[at:to], pa.binary()), pa.array(table.texts[at:to], pa.binary()), pa.array(map(len, table.texts[at:to]), pa.int64()), pa.array(last, of), pa.array(ids[at:to], pa.list_(of))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "digest", "text", "size", "last", "ids"])
            at = to

    for b in bytesops.batches(source):
        of = b.column(0).type
        for key, text in _rows(b, ["doc_id", "text"]):
            text = (text or b"").lower()  # of bytes: A-Z alone
            k = table.number(text, _digest(text))
            if k == len(ids):
                ids.append([])
            ids[k].append(key)
            held += 1
            if table.bytes >= table_bytes or held >= table_ids:
                yield from flush(of)
                rid, table, ids, held = rid + len(ids), Table(), [], 0
    if ids:
        yield from flush(of)


def _records(docs: DataFrame, table_bytes: int, table_ids: int) -> DataFrame:
    """rid, digest, text, size, last (the largest id), ids: a record for each different text that a table of a task held."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compact(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compact(source, TaskContext.get().partitionId() << 40, table_bytes, table_ids)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(compact, f"rid bigint, digest binary, text binary, size bigint, last {kind}, ids array<{kind}>")


def _tables(dealt: DataFrame) -> DataFrame:
    """rid, keep, n, holder of the records of whole buckets: the largest id and the number of rows of the record's text, and
    whether the record is the first that has that id."""
    kind = dealt.schema["last"].dataType.simpleString()

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, groups = None, Table(), []

        def solved(of: pa.DataType) -> Iterator[pa.RecordBatch]:
            rids, keep, n, holder = [], [], [], []
            for group in groups:
                group.sort()
                best = max((x for _, x, _ in group if x is not None), default=None)
                total, first = sum(x for _, _, x in group), next(r for r, x, _ in group if x == best)
                for r, _, _ in group:
                    rids.append(r), keep.append(best), n.append(total), holder.append(r == first)
            for at in range(0, len(rids), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(rids[at:to], pa.int64()), pa.array(keep[at:to], of), pa.array(n[at:to], pa.int64()), pa.array(holder[at:to], pa.bool_())], ["rid", "keep", "n", "holder"])

        for b in bytesops.batches(source):
            of = b.column("last").type
            for x, rid, digest, text, last, n in _rows(b, ["bucket", "rid", "digest", "text", "last", "n"]):
                if x != bucket:
                    yield from solved(of)
                    bucket, table, groups = x, Table(), []
                k = table.number(text, digest)
                if k == len(groups):
                    groups.append([])
                groups[k].append((rid, last, n))
        if groups:
            yield from solved(of)

    sorted_ = dealt.select("bucket", "rid", "digest", "text", "last", "n").repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(meet, f"rid bigint, keep {kind}, n bigint, holder boolean")


def report(docs: DataFrame, table_bytes: int = TABLE_BYTES, table_ids: int = TABLE_IDS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Other columns are ignored.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and all empty texts are one
    group. Of equal texts the row with the largest doc_id stays (null ids are below all others; of rows that repeat that
    id one stays). doc_id may have any type that has an order. Texts of any length are compared whole; one that is
    longer than a table is a table of its own. An empty table gives no rows.
    """
    records = graph.table(_records(docs, table_bytes, table_ids))
    todo = records.select("rid", "digest", "text", "size", "last", F.size("ids").cast("bigint").alias("n"))
    total = records.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    buckets, level, done = max(1, -(-2 * total // table_bytes)), 0, []
    bucket = F.pmod(F.xxhash64("digest", F.lit(0)), F.lit(buckets))
    while True:
        dealt = todo.withColumn("bucket", bucket)
        each = dealt.groupBy("bucket", "digest").agg(F.max("size").alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("texts"))
        over = graph.cut(each.filter((F.col("size") > table_bytes) & (F.col("texts") > 1)).select("bucket"))
        spilled = over.count()
        done.append(_tables(dealt.join(over, "bucket", "left_anti") if spilled else dealt))
        if not spilled:
            break
        todo, level = graph.table(dealt.join(over, "bucket", "left_semi")), level + 1
        bucket = F.col("bucket") * fan_out + F.pmod(F.xxhash64("digest", F.lit(level)), F.lit(fan_out))
    met = records.select("rid", "digest", "ids").join(reduce(DataFrame.unionByName, done), "rid")
    place = F.coalesce(F.array_position("ids", F.col("keep")), F.lit(1))
    rows = met.select("keep", "n", "holder", place.alias("place"), F.lower(F.hex("digest")).alias("sha"), F.posexplode("ids").alias("pos", "id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("holder") & (F.col("pos") + 1 == F.col("place"))).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, **bounds: int) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has, with all columns. Rows that repeat both id and
    text, which report tells apart by nothing but their number, stay together."""
    id_, mine, sha = (graph.unused(docs, name) for name in ("id", "mine", "sha"))
    stay = report(docs, **bounds).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    own = docs.withColumn(mine, F.sha2(_normal(F.coalesce(F.col("text"), F.lit(""))), 256))
    return own.join(stay, [F.col("doc_id").eqNullSafe(F.col(id_)), F.col(mine) == F.col(sha)], "left_semi").select(*docs.columns)


def _normal(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM d WINDOW g AS (PARTITION BY t)
"""
