"""Exact removal of repeated substrings by prefix-free parsing, in shards.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus. Windows of that length are never all hashed or sorted. Instead:

1. Parse. A rolling hash over every position triggers phrase boundaries: the position of the
   least hash among the first ``SPAN`` positions of a window is the window's trigger. It depends
   on the window's bytes alone, so equal windows have equal triggers at equal offsets, and
   neighbouring windows share one (about ``length / 80`` times fewer triggers than bytes).
2. Dictionary. Triggers are counted by the bytes that follow them in every one of their windows.
   Windows of a trigger whose key is unique cannot repeat; most of a corpus ends here.
3. Triggers that repeat with all their context (phrases of the dictionary that occur twice) are
   settled whole; each such phrase goes on once, whatever its number of copies.
4. Order. In the shard of a key, the texts left of its triggers (dictionary) are sorted by their
   suffixes, those right of it (the parse that follows) by their prefixes; runs of equal suffixes
   of the one and equal prefixes of the other combine to the corpus order of the windows, in which
   equal windows are neighbours. Only the ends of repeats get so far.
5. A key with more than ``SHARD`` phrases is not sorted in one task. The range of its windows' offsets
   is halved, and its phrases are dealt to finer shards by the bytes that all windows of a half have
   in common; phrases that agree in all bytes of a half are settled whole for it, as in step 3. That
   goes on until no shard is too large; each step makes two rows of a phrase at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops, graph

LENGTH, GRAM, SHARD = 200, 16, 2048
#: Offsets that are compared at once in a shard.
COLUMNS = 32
U64 = np.uint64


def span_of(length: int) -> int:
    """Positions of a window among which its trigger is sought."""
    return max(1, min(length * 4 // 5, length - GRAM + 1))


def triggers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window, hash prefix) of every run of windows with the same trigger, as positions in data."""
    span, prefix = span_of(length), bytesops.prefix_hash(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, prefix
    n = len(data) - GRAM + 1
    at = np.arange(n)
    h = bytesops.span_hash(prefix, at, at + GRAM)
    h >>= U64(32)
    h <<= U64(32)
    h |= U64(0xFFFFFFFF) - at.astype(U64)  # of equal hashes the last wins
    padded = np.full(-(-n // span) * span + span, np.iinfo(np.uint64).max, U64)
    padded[:n] = h
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    count = len(data) - length + 1
    least = np.minimum(back[:count], ahead[span - 1 : span - 1 + count])
    trigger = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[:count]
    valid = np.arange(count) + length <= end
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, prefix
    trigger = trigger[window]
    new = np.ones(len(window), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return trigger[first], window[first], window[last], prefix


def _anchors(docs: DataFrame, length: int, keys_only: bool) -> DataFrame:
    tail = length - span_of(length) + 1

    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                t, p1, p2, prefix = triggers(data, offsets, length)
                key = pa.array(bytesops.span_hash(prefix, t, t + tail).view(np.int64))
                if keys_only:
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                    continue
                whole = pa.array(bytesops.span_hash(prefix, p1, p2 + length).view(np.int64))
                row = np.searchsorted(offsets, t, "right") - 1
                start = p1 - offsets[row]
                columns = [b.column(c).slice(at, end - at).take(pa.array(row)) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(start), pa.array((t - p1).astype(np.int32)), pa.array((p2 - p1).astype(np.int32)), key, whole],
                    ["doc_id", "th", "start", "left", "more", "key", "whole"],
                )

    if keys_only:
        return docs.select("text").mapInArrow(parse, "key bigint")
    return docs.mapInArrow(parse, "doc_id bigint, th int, start bigint, left int, more int, key bigint, whole bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """The texts as compressed bytes, for the shuffle."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in source:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([press.compress(x or b"") for x in texts], pa.binary())], ["doc_id", "th", "packed"])

    return docs.mapInArrow(pack, "doc_id bigint, th int, packed binary")


def repeated_in_shard(lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For phrases i with windows of offsets l, low[i] <= l <= high[i]: a matrix (phrases x
    offsets) that is true where the window also belongs to another phrase. Windows are the last l
    bytes of the left text and the first length - l of the right one."""
    n, widest = len(lefts), int(high.max()) + 1
    left_class = _classes([x[::-1] for x in lefts], widest - 1)  # by length of the common suffix
    right = _classes(rights, length)
    out = np.zeros((n, widest), bool)
    for at in range(int(low.min()), widest, COLUMNS):
        offset = np.arange(at, min(at + COLUMNS, widest))
        code = left_class[:, offset].astype(np.int64) * n + right[:, length - offset]
        inside = (offset[None] >= low[:, None]) & (offset[None] <= high[:, None])
        code[~inside] = -1 - np.broadcast_to(np.arange(n)[:, None], code.shape)[~inside]
        order = np.argsort(code, axis=0, kind="stable")
        ranked = np.take_along_axis(code, order, 0)
        twin = np.zeros(code.shape, bool)
        twin[1:] |= ranked[1:] == ranked[:-1]
        twin[:-1] |= ranked[1:] == ranked[:-1]
        part = np.zeros(code.shape, bool)
        np.put_along_axis(part, order, twin, 0)
        out[:, offset] = part & inside
    return out


def _classes(texts: list[bytes], longest: int) -> np.ndarray:
    """For each text and each length up to longest, the number of its class: texts have the same class if they agree so far."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    rows = np.zeros((len(texts), longest), np.int16) - 1
    for k, i in enumerate(order):
        part = np.frombuffer(texts[i], np.uint8)[:longest]
        rows[k, : len(part)] = part
    differ = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    out = np.zeros((len(texts), longest + 1), np.int32)
    out[1:, 1:] = np.cumsum(differ, axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, th, start, more: windows start .. start + more of that document also start elsewhere.

    docs: doc_id, th (hash of the text) and text.
    """
    twice = graph.cut(_anchors(docs, length, True).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    found = graph.cut(graph.join_dealt(_anchors(docs, length, False), twice, twice, ["key"], ["doc_id", "th", "start"]))
    phrases = found.groupBy("key", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "left", "more")).alias("one"))
    phrases = graph.cut(phrases.select("key", "whole", "copies", "one.*"))
    whole = phrases.filter("copies > 1").select("key", "whole", F.col("copies").alias("n"))
    settled = graph.join_dealt(found, whole, whole, ["key", "whole"], ["doc_id", "th", "start"]).select("doc_id", "th", "start", "more")
    ends = phrases.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 AND least = 1").select("key", "kinds")
    ends = phrases.join(ends, "key").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "kinds", "copies", "start", "left", "more")).alias("ends"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    packed = _packed(docs)
    fetch = packed.join(ends, same(packed, ends)).select(packed["doc_id"], packed["th"], "packed", "ends")

    def contexts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, seen = zstandard.ZstdDecompressor(), set()
        for b in source:
            out: dict[str, list] = {k: [] for k in schema.names}
            for doc, th, packed, ends in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "packed", "ends")], strict=True):
                if (doc, th) in seen:  # a repeated row
                    continue
                seen.add((doc, th))
                text = loose.decompress(packed)
                for e in ends:
                    row = {k: e[k] for k in ("key", "kinds", "copies", "start", "left")} | {"doc_id": doc, "th": th, "low": e["left"] - e["more"], "high": e["left"], "first": 0, "last": span_of(length) - 1}
                    for k, v in (row | {"context": text[e["start"] : e["start"] + e["more"] + length]}).items():
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    # a phrase in a shard: low and high bound the offsets of its windows that the shard is to compare, first and last those of any phrase there
    schema = pa.schema([("key", pa.int64()), ("kinds", pa.int64()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("start", pa.int64()), ("left", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("context", pa.binary())])
    kind = "key bigint, kinds bigint, copies bigint, doc_id bigint, th int, start bigint, left int, low int, high int, first int, last int, context binary"
    context = graph.cut(fetch.mapInArrow(contexts, kind))

    def halve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            data, offsets = bytesops.column_bytes(_as_text(b.column("context")))
            prefix = bytesops.prefix_hash(data)
            left, low, high, first, last = (b.column(c).to_numpy() for c in ("left", "low", "high", "first", "last"))
            middle = (first + last) // 2
            for lo, hi in ((first, middle), (middle + 1, last)):
                some = np.flatnonzero((low <= hi) & (high >= lo) & (lo <= hi))
                at, lo, hi = offsets[:-1][some] + left[some], lo[some], hi[some]
                own_lo, own_hi = np.maximum(low[some], lo), np.minimum(high[some], hi)
                frame = lambda tail, rest, at=at: bytesops.span_hash(prefix, at - tail, at) * U64(0x9E3779B97F4A7C15) + bytesops.span_hash(prefix, at, at + rest)
                key = bytesops.mix(b.column("key").to_numpy().view(U64)[some] + frame(lo, length - hi) + lo.astype(U64))
                whole = bytesops.mix(frame(own_hi, length - own_lo) + own_lo.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                part = b.take(pa.array(some))
                new = {"key": key.view(np.int64), "low": own_lo.astype(np.int32), "high": own_hi.astype(np.int32), "first": lo.astype(np.int32), "last": hi.astype(np.int32)}
                yield pa.RecordBatch.from_arrays([*[pa.array(new[c]) if c in new else part.column(c) for c in schema.names], pa.array(whole.view(np.int64))], [*schema.names, "whole"])

    shards, hot = [context.filter(F.col("kinds") <= shard)], context.filter(F.col("kinds") > shard)
    while not hot.isEmpty():
        halves = hot.mapInArrow(halve, kind + ", whole bigint")
        place = F.struct("doc_id", "th", "start", "left", "low", "high", "first", "last", "context")
        kinds = graph.cut(halves.groupBy("key", "whole").agg(F.sum("copies").alias("copies"), F.min(place).alias("one")))
        same = halves.filter("copies = 1").join(kinds.filter("copies > 1").select("key", "whole"), ["key", "whole"])
        settled = settled.unionByName(same.select("doc_id", "th", (F.col("start") + F.col("left") - F.col("high")).alias("start"), (F.col("high") - F.col("low")).alias("more")))
        sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 AND least = 1").drop("least")
        finer = kinds.select("key", "copies", "one.*").join(sizes, "key").select(*schema.names)
        shards.append(finer.filter(F.col("kinds") <= shard))
        hot = finer.filter(F.col("kinds") > shard)

    def sort(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in graph.groups(source, ["key"]):
            text, left, low, high = g.column("context").to_pylist(), *[g.column(c).to_numpy() for c in ("left", "low", "high")]
            twin = repeated_in_shard([x[:k] for x, k in zip(text, left, strict=True)], [x[k:] for x, k in zip(text, left, strict=True)], low, high, length)
            twin &= g.column("copies").to_numpy()[:, None] == 1
            row, offset = np.nonzero(twin[:, ::-1])  # windows in order of position
            if len(row):
                offset = twin.shape[1] - 1 - offset
                position = left[row] - offset
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(row)) - 1
                g = g.take(pa.array(row[first]))
                start = g.column("start").to_numpy() + position[first]
                yield pa.RecordBatch.from_arrays([g.column("doc_id").combine_chunks(), g.column("th").combine_chunks(), pa.array(start), pa.array((position[last] - position[first]).astype(np.int32))], ["doc_id", "th", "start", "more"])

    sharded = reduce(DataFrame.unionByName, shards).repartition("key").sortWithinPartitions("key").mapInArrow(sort, "doc_id bigint, th int, start bigint, more int")

    return settled.unionByName(sharded)


def _as_text(column: pa.Array) -> pa.Array:
    """A binary column under the type that column_bytes takes; the bytes are not looked at."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)


def deduplicate(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_bytes, kept (the bytes left); one row for each row of docs.

    Texts are taken as UTF-8; a null is an empty text. Matches never cross documents, but rows that
    repeat a text match each other, and one place of a document matches another of the same document.
    Texts shorter than length bytes lose nothing. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int").alias("th"), "text")
    spans = repeats(rows, length, shard).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "more")).alias("spans"))
    packed = _packed(rows)
    joined = packed.join(spans, packed["doc_id"].eqNullSafe(spans["doc_id"]) & (packed["th"] == spans["th"]), "left")
    joined = joined.select(packed["doc_id"], "packed", F.transform("spans", lambda s: s["start"]).alias("start"), F.transform("spans", lambda s: s["more"]).alias("more"))

    def remove(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for b in source:
            out = []
            for packed, start, more in zip(b.column("packed").to_pylist(), b.column("start"), b.column("more"), strict=True):
                text = loose.decompress(packed)
                kept, spans = text, np.zeros((0, 2), np.int64)
                if start.is_valid:
                    first = start.values.to_numpy().astype(np.int64)
                    spans = merged(first, first + more.values.to_numpy() + length)
                    edges = [0, *spans.ravel().tolist(), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            n_bytes, n_removed, n_spans, digest, kept = zip(*out, strict=True) if out else ([],) * 5
            arrays = [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            arrays += [pa.array(kept, pa.binary())] * with_bytes
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    return joined.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes)


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maximal runs that the spans cover (rows of start, end); spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], 1)
