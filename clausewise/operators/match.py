"""Matching documents to templates by blended cosine similarity.

A library whose size is checked to fit is sent to the executors, and documents are multiplied with it
batch by batch; documents are not exchanged. A larger library is dealt out to tasks, as many rows as
one may hold, and documents pass by it there; no template passes the driver. Either way a task
multiplies bounded blocks in single precision, which only tell the pairs that may be among the best;
these are scored in double precision and ranked, so pairs never exist as rows and equal templates have
equal scores.

Vectors are arrays, or structs of the places and values of their components that are not zero.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector

#: Bytes of template vectors that are sent at once or held by a task, and rows of a library that are multiplied at once.
BLOCK_BYTES, HELD_BYTES, BLOCK_ROWS = 32 << 20, 32 << 20, 4096
#: Documents that are multiplied at once, bytes of a block of dense rows, and pairs that wait to be scored.
ROWS, TILE_BYTES, PAIRS = 1024, 32 << 20, 1 << 20
MATCHED = "id string, template_id string, doc_score double, title_score double, score double, rank int"


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows have a direction; vectors of another width, with nulls or without a direction have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    whole = np.flatnonzero(sizes == width)
    out = np.zeros((len(column), width))
    out[whole] = values[(np.cumsum(sizes) - sizes)[whole, None] + np.arange(width)]
    good = np.isfinite(out).all(1) & out.any(1)
    out[~good] = 0
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1), good


class _Sparse:
    """Unit rows by their components that are not zero; those beyond width count for the length alone."""

    def __init__(self, start: np.ndarray, at: np.ndarray, of: np.ndarray, width: int):
        self.start, self.at, self.of, self.shape = start, at, of, (len(start) - 1, width)

    @staticmethod
    def read(column: pa.StructArray, width: int, unit: bool = True) -> tuple[_Sparse, np.ndarray]:
        """The rows as they are, or of length 1, and which have a direction."""
        at, of = (pc.struct_field(column, k) for k in (0, 1))  # null where the struct is
        size = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
        row, at, of = np.repeat(np.arange(len(size)), size), at.flatten().to_numpy(zero_copy_only=False), of.flatten().to_numpy(zero_copy_only=False)
        length = np.sqrt(np.bincount(row, of * of, len(size)))
        good = np.isfinite(length) & (length > 0)
        kept = (at < width) & good[row]
        row, at, of = row[kept], at[kept], of[kept]
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
        return _Sparse(start, at.astype(np.int32), of / length[row] if unit else of, width), good

    def __len__(self) -> int:
        return self.shape[0]

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (self.start[1:] - self.start[:-1])[rows]
        return np.repeat(np.arange(len(rows)), size), np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def __getitem__(self, rows: np.ndarray | slice) -> _Sparse:
        rows = np.arange(len(self))[rows]
        row, place = self._places(rows)
        return _Sparse(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]), self.at[place], self.of[place], self.shape[1])

    def dense(self, rows: np.ndarray, kind: type = float) -> np.ndarray:
        out = np.zeros((len(rows), self.shape[1]), kind)
        row, place = self._places(rows)
        out[row, self.at[place]] = self.of[place]
        return out

    def key(self, k: int) -> bytes:
        part = slice(self.start[k], self.start[k + 1])
        return self.at[part].tobytes() + self.of[part].tobytes()


class _Dense:
    """Unit rows as they are."""

    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, rows: np.ndarray | slice) -> _Dense:
        return _Dense(self.x[rows])

    def dense(self, rows: np.ndarray, kind: type = float) -> np.ndarray:
        return self.x[rows].astype(kind, copy=False)

    def key(self, k: int) -> bytes:
        return self.x[k].tobytes()


def _rows(column: pa.Array, width: int) -> tuple[_Dense | _Sparse, np.ndarray]:
    """Unit rows of a column of vectors, and which have a direction."""
    if pa.types.is_struct(column.type):
        return _Sparse.read(column, width)
    x, good = _matrix(column, width)
    return _Dense(x), good


def _arrays(part: pa.RecordBatch | pa.Table, width: int) -> tuple:
    """Unit vectors of documents, which of them have a direction, those of titles (None if there are no titles), and which titles are asked for."""
    column = lambda c: part.column(c).combine_chunks() if isinstance(part, pa.Table) else part.column(c)
    titles = column("title_emb")
    has_title = np.array(titles.is_valid())
    return *_rows(column("embedding"), width), _Dense(_matrix(titles, width)[0]) if has_title.any() else None, has_title


def _prepared(library: pa.Table, width: int, k: int) -> tuple:
    """Names and vectors of a library in order of names, without those that can never be among the k best: those without a
    direction, and of equal ones all but the first k."""
    library = library.sort_by("id")
    own, good, titles, _ = _arrays(library, width)
    seen: Counter = Counter()
    kept = []
    for i in np.flatnonzero(good):
        key = hashlib.blake2b(own.key(i) + (titles.key(i) if titles else b""), digest_size=16).digest()
        seen[key] += 1
        if seen[key] <= k:
            kept.append(i)
    kept = np.array(kept, int)
    return np.array(library.column("id").to_pylist(), object)[kept], own[kept], titles[kept] if titles else None


def _best(row: np.ndarray, col: np.ndarray, q: tuple, t: tuple, k: int, threshold: float, w_doc: float, w_title: float) -> tuple:
    """Pairs scored in double precision: row, column, both scores, their blend and rank of the k best of each row. Every pair is
    summed in the same way, wherever it lies."""
    (own, titles, has_title), (_, t_own, t_titles) = q, t
    doc, title = np.zeros(len(row)), np.zeros(len(row))
    step = max(1, (TILE_BYTES >> 4) // max(1, own.shape[1]))
    for at in range(0, len(row), step):
        r, c = row[at : at + step], col[at : at + step]
        doc[at : at + step] = (own.dense(r) * t_own.dense(c)).sum(1)
        if titles and t_titles:
            title[at : at + step] = (titles.dense(r) * t_titles.dense(c)).sum(1)
    score = np.where(has_title[row], w_doc * doc + w_title * title, doc)
    order = np.lexsort((col, -score, row))
    order = order[score[order] >= threshold]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    order, rank = order[rank < k], rank[rank < k]
    return row[order], col[order], doc[order], title[order], score[order], rank


def _ranked(ids: pa.Array, asked: tuple, library: tuple, k: int, threshold: float, w_doc: float, w_title: float, block_rows: int = BLOCK_ROWS) -> pa.RecordBatch:
    """The k best of a prepared library for each asked row, of which there are few; block_rows of the library are multiplied at a time."""
    own, good, titles, has_title = asked
    names, t_own, t_titles = library
    if not good.all():
        able = np.flatnonzero(good)
        ids, own, titles, has_title = ids.take(pa.array(able)), own[able], titles[able] if titles else None, has_title[able]
    q, every, width, pairs = (own, titles, has_title), np.arange(len(own)), own.shape[1], bool(titles and t_titles)
    a = own.dense(every, np.float32) * np.where(has_title, w_doc, 1).astype(np.float32)[:, None]
    if pairs:
        a = np.hstack([a, titles.dense(every, np.float32) * np.float32(w_title)])
    # what single precision can be off by, for both of two scores that are compared
    slack = 2 * (a.shape[1] + 4) * 2.0**-24 * max(1, abs(w_doc) + abs(w_title))
    top = np.full((len(own), k), -np.inf, np.float32)
    rows, cols, waiting = [np.zeros(0, int)], [np.zeros(0, int)], 0
    step = max(1, min(block_rows, TILE_BYTES // (4 * a.shape[1])))
    for at in range(0, len(names) if len(own) else 0, step):
        part = np.arange(at, min(at + step, len(names)))
        b = t_own.dense(part, np.float32)
        score = a @ (np.hstack([b, t_titles.dense(part, np.float32)]) if pairs else b).T
        peak, least = score.max(1), np.maximum(top.min(1), np.float32(threshold))
        row = np.flatnonzero(peak >= least - slack)
        if not len(row):
            continue
        score = score[row]
        best = peak[row, None] if k == 1 else np.partition(score, -min(k, len(part)), axis=1)[:, -k:]
        top[row] = np.partition(np.hstack([top[row], best]), -k, axis=1)[:, -k:]
        place = np.flatnonzero(score >= (np.maximum(top[row].min(1), np.float32(threshold)) - slack)[:, None])
        rows.append(row[place // len(part)])
        cols.append(at + place % len(part))
        waiting += len(place)
        if waiting > PAIRS:  # many that are nearly equal: only the best of them wait on
            row, col, *_ = _best(np.concatenate(rows), np.concatenate(cols), q, library, k, threshold, w_doc, w_title)
            rows, cols, waiting = [row], [col], 0
    row, col, doc, title, score, rank = _best(np.concatenate(rows), np.concatenate(cols), q, library, k, threshold, w_doc, w_title)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(names[col], pa.string()), pa.array(doc), pa.array(title), pa.array(score), pa.array(rank + 1, pa.int32())],
        ["id", "template_id", "doc_score", "title_score", "score", "rank"],
    )


def _slices(part: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, part.num_rows, rows):
        yield part.slice(at, rows)


def _sent(docs: DataFrame, library: pa.Table, width: int, k: int, *how) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_prepared(library, width, k))

    def match(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for part in _slices(b):
                yield _ranked(part.column("id"), _arrays(part, width), sent.value, k, *how)

    return docs.select("id", "embedding", "title_emb").mapInArrow(match, MATCHED)


def _placed(docs: DataFrame, library: DataFrame, groups: int) -> DataFrame:
    """Both sides with the place (a task) of each row: a document is in one task of every group, a row of the library in every task of its group."""
    tasks = max(1, -(-2 * docs.sparkSession.sparkContext.defaultParallelism // groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    side = lambda df, asked, group, task: df.select("id", "embedding", "title_emb", F.lit(asked).alias("asked"), group.alias("g"), task.alias("t"))
    both = side(library, False, own(groups), every(tasks)).unionByName(side(docs, True, every(groups), own(tasks)))
    both = both.select((F.col("g") * tasks + F.col("t")).alias("place"), "asked", "id", "embedding", "title_emb")
    return both.repartitionById(groups * tasks, F.col("place")).sortWithinPartitions("place", "asked")


def _runs(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Iterator[pa.RecordBatch]]]:
    """Of rows as _placed has them: each place with the rows that are held there, and those that pass. All of a place's runs must be
    taken before the next place; one without rows on either side is left out."""

    def pieces() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for b in source:
            place, asked = b.column("place").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), b.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at < end:
                    yield int(place[at]), bool(asked[at]), b.slice(at, end - at)

    for place, rows in itertools.groupby(pieces(), key=lambda x: x[0]):
        held, first = [], None
        for _, asked, run in rows:
            if asked:
                first = run
                break
            held.append(run)
        if held and first is not None:
            table = [pa.Table.from_batches(held)]
            held.clear()  # what is made of the table takes its place
            yield place, table.pop(), itertools.chain([first], (run for _, _, run in rows))


def _dealt(docs: DataFrame, library: DataFrame, width: int, groups: int, k: int, *how) -> DataFrame:
    """The k best of a library in groups: each task holds its rows of the library while its documents pass by."""

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, library, runs in _runs(source):
            held, library = _prepared(library, width, k), None
            for run in runs:
                for part in _slices(run):
                    yield _ranked(part.column("id"), _arrays(part, width), held, k, *how)

    return _first(_placed(docs, library, groups).mapInArrow(meet, MATCHED), k)


def _first(best: DataFrame, k: int) -> DataFrame:
    """The k best of each document among the best of several parts of a library."""
    by_score = Window.partitionBy("id").orderBy(F.col("score").desc(), "template_id")
    return best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def in_blocks(docs: DataFrame, library: DataFrame, width: int, k: int, threshold: float, w_doc: float, w_title: float) -> DataFrame:
    """The k best templates among those of a document's cells: docs and library (cell, id, embedding, title_emb and the number of
    blocks of the cell on either side, doc_blocks and blocks) meet by pairs of blocks. A document may have several cells."""
    own, other = F.pmod(F.xxhash64("id"), F.col("doc_blocks")), F.pmod(F.xxhash64("id"), F.col("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    place = ["cell", "i", "j"]
    left = docs.withColumn("i", own).withColumn("j", every("blocks")).select(*place, "id", "embedding", "title_emb")
    right = library.withColumn("j", other).withColumn("i", every("doc_blocks"))
    right = right.select(*[F.col(c).alias(c) for c in (*place, "id", "embedding", "title_emb")])  # columns of its own, should both sides come from one frame

    def meet(d: pa.Table, t: pa.Table) -> pa.Table:
        if not (d.num_rows and t.num_rows):  # an empty side has no columns
            return schema.empty_table()
        held = _prepared(t, width, k)
        found = [_ranked(part.column("id"), _arrays(part, width), held, k, threshold, w_doc, w_title) for part in d.to_batches(ROWS)]
        return pa.Table.from_batches(found, schema=schema)

    schema = pa.schema([("id", pa.string()), ("template_id", pa.string()), *[(c, pa.float64()) for c in ("doc_score", "title_score", "score")], ("rank", pa.int32())])
    return _first(left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(meet, MATCHED), k)


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, width and bytes of the vectors of a library (embedding and title_emb)."""
    if isinstance(rows.schema["embedding"].dataType, T.StructType):
        at = F.col("embedding").getField("at")
        x = rows.agg(F.count("*").alias("n"), (F.max(F.array_max(at)) + 1).alias("width"), F.sum(F.size(at)).alias("parts")).first()
        return x["n"], max(x["width"] or 1, 1), 12 * (x["parts"] or 0) + 64 * x["n"]
    x = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = max(x["width"] or 1, 1)
    return x["n"], width, x["n"] * width * 16


def match(
    docs: DataFrame, templates: DataFrame, k: int = 1, threshold: float = 0.0, w_doc: float = 0.7, w_title: float = 0.3, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k best templates of each document: id, template_id, doc_score, title_score, score, rank (from 1).

    docs and templates: id, embedding, title_emb. With a title vector the score is w_doc * doc + w_title * title,
    where a template without a title vector has 0 for it; without one it is the similarity of the documents, and title_score is 0.
    Scores below threshold are left out, and so are vectors that are null or zero; ties go to the lesser id.
    Documents without any template at the threshold have no row. Ids are unique on either side.
    A library of at most block_bytes is sent to the executors; of a larger one only the number of rows and their width
    are asked for, and it is dealt to tasks. At most block_rows of it are multiplied at a time.
    """
    rows = templates.select("id", "embedding", "title_emb")
    n, width, size = extent(rows)
    if not n:
        return docs.sparkSession.createDataFrame([], MATCHED)
    how = (threshold, w_doc, w_title, block_rows)
    if size <= block_bytes:
        return _sent(docs, rows.toArrow(), width, k, *how)
    return _dealt(docs.select("id", "embedding", "title_emb"), rows, width, -(-size // HELD_BYTES), k, *how)


def _untitled(df: DataFrame) -> DataFrame:
    return df.select("id", "embedding", F.lit(None).cast("array<double>").alias("title_emb"))


def nearest(docs: DataFrame, templates: DataFrame, k: int, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest templates by document vector alone: id, template_id, similarity, rank."""
    return match(_untitled(docs), _untitled(templates), k, threshold, block_bytes=block_bytes).select("id", "template_id", F.col("score").alias("similarity"), "rank")

def with_nearest(docs: DataFrame, templates: DataFrame, out: str, threshold: float = 0.0, block_bytes: int = BLOCK_BYTES, key: str = "id") -> DataFrame:
    """docs with a struct of the nearest template (template_id, similarity) by document vector, or null where none reaches
    the threshold. A library of more than block_bytes is matched apart and joined by key; docs may be a stream only if it is smaller."""
    rows = _untitled(templates)
    n, width, size = extent(rows)
    if size > block_bytes:
        if docs.isStreaming:
            raise ValueError("the library is too large to be sent to a stream; match its batches as tables")
        found = nearest(docs.withColumn("id", F.col(key).cast("string")), templates, 1, threshold, block_bytes)
        found = found.select(F.col("id").alias("_id"), F.struct("template_id", "similarity").alias(out))
        return docs.join(found, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")
    sent = docs.sparkSession.sparkContext.broadcast(_prepared(rows.toArrow(), width, 1) if n else None)
    kind = pa.struct([("template_id", pa.string()), ("similarity", pa.float64())])

    @F.arrow_udf("struct<template_id: string, similarity: double>")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            found = [None] * len(v)
            ids = pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int64()), v, pa.nulls(len(v), pa.list_(pa.float64()))], ["id", "embedding", "title_emb"])
            for part in _slices(ids) if n else ():
                ranked = _ranked(part.column("id"), _arrays(part, width), sent.value, 1, threshold, 1.0, 0.0)
                for k, name, score in zip(*(ranked.column(c).to_pylist() for c in ("id", "template_id", "score")), strict=True):
                    found[k] = {"template_id": name, "similarity": score}
            yield pa.array(found, kind)

    return docs.withColumn(out, best(F.col("embedding")))


# The bounds and names of the bands.
BANDS = [("match", 0.9, 1.0), ("likely", 0.8, 0.9)]


def band(score: Column) -> Column:
    """unknown for null and 0, match within [0.9, 1], likely within [0.8, 0.9), no_match for anything else."""
    return F.when(score.isNull() | (score == 0), "unknown").when((score >= 0.9) & (score <= 1.0), "match").when((score >= 0.8) & (score < 0.9), "likely").otherwise("no_match")


def band_counts(scored: DataFrame) -> DataFrame:
    """Documents per band and their share in percent."""
    counts = scored.groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the four bands
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def counters(scored: DataFrame, bound: float = 0.5) -> DataFrame:
    """processed, classified (score of bound or more), unclassified and the rate of classified ones in percent."""
    hit = F.count_if(F.col("score") >= bound)
    rate = F.when(F.count("*") > 0, F.round(100.0 * hit / F.count("*"), 6)).otherwise(0.0)
    return scored.agg(F.count("*").alias("processed"), hit.alias("classified"), (F.count("*") - hit).alias("unclassified"), rate.alias("rate"))


__all__ = ["band", "band_counts", "counters", "match", "nearest", "vector"]
