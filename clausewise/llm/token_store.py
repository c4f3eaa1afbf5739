"""Token files: whole corpora as range-coded token ids, in order of document.

Documents are range-partitioned by id and sorted, tokenized, ended with an id of their own and
packed into files of FILE ids to one and a half of it (a longer document makes a longer file), each coded by
range_coder in blocks that can be read alone. The files and the index of their documents are
written as rows of a Parquet table, so any store that Spark writes to will do, and its commit
protocol covers retried tasks. A document's place among all ids follows from the files' counts.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops, graph, range_coder, units

FILE, PIECE = 4_000_000, 1 << 20
#: Units that a worker remembers, about 100 bytes each, and the bits of the table that finds them.
REMEMBERED, REMEMBERED_SLOTS = 900_000, 22
#: Bytes of new units that are encoded together.
RUN = 1 << 13
SCHEMA = "part int, seq int, n_tokens bigint, doc_ids array<bigint>, lengths array<int>, file binary"


#: Letters of ASCII, its marks, and the first bytes of two-byte characters that are letters: U+00C0-017F but for two, and U+0400-047F.
_LETTER, _MARK, _LEAD = np.zeros((3, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: The characters that stand for bytes in the tokens of byte-level vocabularies.
_SHOWN = np.array([33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)])
_CHARACTER = np.where(_SHOWN, np.arange(256), 255 + np.cumsum(~_SHOWN)).astype("<u4")


@functools.cache  # once in each worker process
def _tokenizer(file: str):
    """The tokenizer of a file; the bytes of each of its ids, if the characters of its tokens stand for bytes; its model for
    words in these characters with a blank before each, or None; and the marks before which a text may be cut behind a letter.

    With the usual pattern of byte-level vocabularies no token joins a letter to a mark behind it, and a blank with letters is one word.
    Where added tokens could say otherwise, or the tokenizer is of another kind, there are no such marks or no such model.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(file)
    size = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        size[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        size[i] = len(token.content.encode())
    spec = json.loads(tokenizer.to_str())
    pattern, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
    words, marks = None, np.zeros(256, bool)
    usual = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") and not pattern.get("add_prefix_space") and spec["model"]["type"] == "BPE"
    if usual and not spec["normalizer"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        marks = _MARK.copy()
        for raw in (t["content"].encode() for t in added):
            marks[[y for x, y in zip(raw, raw[1:], strict=False) if _LETTER[x]]] = False
        if not any(t["content"].strip().isalpha() for t in added):
            words = Tokenizer(tokenizer.model)
            words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return tokenizer, size, words, marks


def _one_word(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each part of the bytes is a blank and letters after it; parts begin where begin says."""
    good = _LETTER[data] | _LEAD[data]
    behind = data[:-1]
    good[1:] |= _LEAD[behind] & (data[1:] & 0xC0 == 0x80) & ~((behind == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    good[begin] = data[begin] == 32
    return np.logical_and.reduceat(good, begin) & (np.diff(begin, append=len(data)) > 1)


class Encoder:
    """Ids of texts by a file of the tokenizers library. Units between blanks, and before marks where no token joins these to
    letters, are encoded once and remembered."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer, self.size, self.words, self.marks = _tokenizer(tokenizer_file)
        self.clear()

    def clear(self) -> None:
        self.seen = units.Seen(REMEMBERED, REMEMBERED_SLOTS)
        self.first, self.length, self.ids = units.Grow(np.int64), units.Grow(np.int64), units.Grow(np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start, end = units.blank_units(data, offsets)
        if self.marks.any():
            first = np.zeros(len(data), bool)
            first[1:] = self.marks[data[1:]] & _LETTER[data[:-1]]
            first[start] = True
            start, end = units.spans(first, len(data))
        if self.seen.full():
            self.clear()
        number, new = self.seen.look_up(data, start, end)
        if len(new):
            ids, first, count = self._encode(data, start[new], end[new])
            self.first.add(first + self.ids.size)
            self.length.add(count)
            self.ids.add(ids)
        count = self.length.values[number]
        ids = self.ids.values[units.expand(self.first.values[number], count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offsets)]

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each unit begin, number of them). Units that begin with a blank and end without one are encoded in runs,
        for no token joins one to the next; their ids are told apart by the tokens' bytes, as far as these add up."""
        found, held = [], 0
        first, count = np.full(len(start), -1), np.zeros(len(start), np.int64)
        some = np.flatnonzero(units.BLANK[data[start]] & ~units.ends_blank(data, start, end))
        word = np.zeros(len(some), bool)
        if self.words and len(some):
            size = (end - start)[some]
            word = _one_word(data[units.expand(start[some], size)], np.cumsum(size) - size)
        for own, encode in ((some[word], self._word_ids), (some[~word], self._ids)):
            if not len(own):
                continue
            size = (end - start)[own]
            joined = data[units.expand(start[own], size)].tobytes()
            stop = np.cumsum(size)
            begin = np.append(0, stop)
            cuts = np.unique(np.append(0, np.minimum(np.searchsorted(stop, np.arange(RUN, len(joined) + RUN, RUN)) + 1, len(own)))).tolist()
            runs = list(zip(cuts, cuts[1:], strict=False))
            for (lo, hi), ids in zip(runs, encode([joined[begin[lo] : begin[hi]] for lo, hi in runs]), strict=True):
                reached = np.cumsum(self.size[ids]) + begin[lo]
                at = np.searchsorted(reached, stop[lo:hi])
                if len(ids) and at[-1] == len(ids) - 1 and np.array_equal(reached[at], stop[lo:hi]):
                    cut = np.append(0, at + 1)
                    first[own[lo:hi]], count[own[lo:hi]] = cut[:-1] + held, np.diff(cut)
                    found.append(ids)
                    held += len(ids)
        raw = data.tobytes()
        rest = np.flatnonzero(first < 0)
        for k, ids in zip(rest.tolist(), self._ids([raw[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]), strict=True):
            first[k], count[k] = held, len(ids)
            found.append(ids)
            held += len(ids)
        return np.concatenate(found), first, count

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def _word_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts of words with a blank before each."""
        blank = chr(_CHARACTER[32])
        shown = [_CHARACTER[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le").replace(blank, " " + blank) for x in texts]
        return [np.array(e.ids, np.int32) for e in self.words.encode_batch_fast(shown, add_special_tokens=False)]


@functools.cache  # a worker's tasks go on with what the ones before have learnt
def _encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Write the ids of docs (doc_id, text), each document's ended with end_id, in order of doc_id.

    Null texts count as empty: they have the end id alone. Rows without doc_id come first; rows
    that repeat a doc_id follow each other in order of their texts. The tokenizer file must be
    on every executor.
    """
    first = F.col("doc_id").asc_nulls_first()
    # samples of the range's keys go to the driver, so only the beginning of a text is one; it does not change the order
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(first, F.substring("text", 1, 16)).sortWithinPartitions(first, "text")

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        held, lengths, names = [], [], []

        def flush(n: int) -> pa.RecordBatch:
            """The first n pieces as a file."""
            ids, count = np.concatenate(held[:n]), np.concatenate(lengths[:n])
            row = {"part": [part], "seq": [seq], "n_tokens": [len(ids)], "doc_ids": [[k for x in names[:n] for k in x]], "lengths": [count.tolist()], "file": [range_coder.encode(ids)]}
            del held[:n], lengths[:n], names[:n]
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text"), PIECE):
                ids, before = encoder(data, offsets)
                count = np.diff(before) + 1
                stop = np.cumsum(count)
                out = np.full(stop[-1], end_id, np.int32)
                body = np.ones(len(out), bool)
                body[stop - 1] = False
                out[body] = ids
                held.append(out)
                lengths.append(count)
                names.append(b.column("doc_id").slice(at, end - at).to_pylist())
                # the next file has half its ids by then, so none is a small remainder
                if (upto := np.cumsum([len(x) for x in held]))[-1] >= FILE + FILE // 2:
                    yield flush(int(np.searchsorted(upto, FILE)) + 1)
                    seq += 1
        if held:
            yield flush(len(held))

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("file", pa.binary())])
    ordered.mapInArrow(pack, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 and, with_ids, ids; from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    within, across = Window.partitionBy("part").orderBy("seq"), Window.orderBy("part")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(across) - F.col("n")).alias("of_part"))  # a row per partition
    place = files.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("of_file")).join(parts, "part")

    def unpack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for k in range(b.num_rows):
                ids, count = range_coder.decode(b.column("file")[k].as_py()), b.column("lengths")[k].values.to_numpy().astype(np.int64)
                before = np.concatenate([[0], np.cumsum(count)])
                if before[-1] != len(ids):
                    raise ValueError("a token file does not have the ids of its index")
                step = 4096
                for at in range(0, len(count), step):
                    cut = before[at : at + step + 1]
                    n = len(cut) - 1
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut, cut[1:], strict=False)]
                    arrays = [pa.array([b.column(c)[k].as_py()] * n, pa.int32()) for c in ("part", "seq")] + [b.column("doc_ids")[k].values.slice(at, n), pa.array(cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())]
                    arrays += [pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(ids[cut[0] : cut[-1]].astype(np.int32)))] * with_ids
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    rows = files.select("part", "seq", "doc_ids", "lengths", "file").mapInArrow(unpack, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    return rows.join(place, ["part", "seq"]).select("doc_id", (F.col("local") + F.col("of_file") + F.col("of_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{graph.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
