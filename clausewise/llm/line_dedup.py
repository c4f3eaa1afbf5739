"""Removal of lines that repeat an earlier line, exactly or within one edit.

Lines are compared without white space at their ends; blank lines stay. Documents are ordered by
id, lines by place. A line goes if the same line stands earlier, or, if it has ``near_chars``
characters or more, if an earlier line is one insertion, deletion or substitution away.

The texts are parsed once, into a table of compressed texts and of digests of their lines.
Deletion neighbourhoods of all lines would be as many keys as the corpus has characters, so two
filters that lose nothing come first: a line and its neighbour agree before and after a region
that holds the edit. With two regions (the halves), then with sixteen, lines that share no such
frame with another line drop out. The rest emit as hashed keys the variants with one character
deleted in a region whose frame they share, and themselves. Lines that share the variant of the
same place differ there by a substitution; lines equal to a variant by an insertion. An aggregate
of the earliest line per key suffices, so no pairs within a group are made; the found partner is
verified by its edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops, graph, units

#: The edit bound is one edit for lines of so many characters, and none for shorter ones, of which one edit makes others.
NEAR_CHARS = 8
REGIONS = 16
U64 = np.uint64
_SPACE = [9, 10, 11, 12, 13, 32]
_BLANK = np.zeros(256, bool)
_BLANK[_SPACE] = True


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, text numbers, line numbers) of the lines that are not blank, stripped, as places in data."""
    feed = data == 10
    ink = np.flatnonzero(~_BLANK[data])
    # a line begins at each byte of ink that has a line feed or the start of a text between itself and the ink before
    feeds = np.concatenate([[0], np.cumsum(feed)])
    text = np.searchsorted(offsets, ink, "right") - 1
    new = np.ones(len(ink), bool)
    new[1:] = (feeds[ink[1:]] != feeds[ink[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ink))[: len(first)] - 1
    start, text = ink[first], text[first]
    return start, ink[last] + 1, text, feeds[start] - feeds[offsets[text]]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each character and the end, the number of characters before each place)."""
    head = (data & 0xC0) != 0x80
    return np.append(np.flatnonzero(head), len(data)), np.concatenate([[0], np.cumsum(head)])


def frames(prefix: np.ndarray, place: np.ndarray, start: np.ndarray, stop: np.ndarray, regions: int) -> np.ndarray:
    """Keys (lines x 2 * regions) such that lines within one edit share one: what stands before and after
    each region of a line of as many characters, and of one more. start and stop count characters, place has the bytes of these."""
    n = stop - start
    out = np.empty((len(start), 2 * regions), U64)
    for more in range(2):
        size = n + more
        for r in range(regions):
            a, b = size * r // regions, size * (r + 1) // regions
            # of a line of one character less, so much of what stands before the region as there is
            head = bytesops.span_hash(prefix, place[start], place[start + np.minimum(a, n)])
            tail = bytesops.span_hash(prefix, place[np.maximum(stop - (size - b), start)], place[stop])
            out[:, more * regions + r] = bytesops.mix(head * U64(0x9E3779B97F4A7C15) + tail + (size * regions + r).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return out


def _parsed(source: DataFrame, near_chars: int) -> DataFrame:
    """source (with __id, __th and text) as a written table without text: __packed (the text, compressed) and, by line
    that is not blank, __no, __h1 and __h2 (a digest of 128 bits) and __keys (four of the halves; none for lines that are too
    short to be within one edit of a line of near_chars characters)."""
    others = [c for c in source.columns if c != "text"]
    lists = {"__h1": T.LongType(), "__h2": T.LongType(), "__no": T.IntegerType(), "__keys": T.ArrayType(T.LongType())}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in bytesops.batches(batches):
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                part, raw = b.slice(at, end - at), data.tobytes()
                start, stop, text, no = lines_of(data, offsets)
                digest = b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), stop.tolist(), strict=True)])
                h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                place, before = characters(data)
                first, last = before[start], before[stop]
                long = last - first >= near_chars - 1
                keys = frames(bytesops.prefix_hash(data), place, first[long], last[long], 2).view(np.int64)
                by_line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long * 4)]), pa.int32()), pa.array(keys.ravel()))
                cut = pa.array(np.searchsorted(text, np.arange(end - at + 1)), pa.int32())
                made = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(no.astype(np.int32)), by_line)]
                bounds = offsets.tolist()
                packed = [press.compress(raw[x:y]) if there else None for x, y, there in zip(bounds, bounds[1:], part.column("text").is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(packed, pa.binary()), *made], [*others, "__packed", *lists])

    schema = T.StructType([*[source.schema[c] for c in others], T.StructField("__packed", T.BinaryType())])
    for name, kind in lists.items():
        schema = schema.add(name, T.ArrayType(kind))
    return graph.table(source.mapInArrow(parse, schema))


def _occurrences(parsed: DataFrame, *more: str) -> DataFrame:
    """h1, h2, doc_id, th, no and keys, if they are wanted, of each line."""
    lists = {"__h1": "h1", "__h2": "h2", "__no": "no"} | dict.fromkeys(more, "keys")
    each = parsed.select(F.col("__id").alias("doc_id"), F.col("__th").alias("th"), F.explode(F.arrays_zip(*lists)).alias("line"))
    return each.select("doc_id", "th", *[F.col("line")[c].alias(name) for c, name in lists.items()])


def _sharing(keyed: DataFrame) -> DataFrame:
    """line_id and frames (which of its keys, from 0) of the lines of keyed that share a key with another. The keys of a line differ."""
    spread = keyed.select("line_id", F.posexplode("keys").alias("frame", "key"))
    twice = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return spread.join(twice, "key").groupBy("line_id").agg(F.collect_set("frame").alias("frames"))


def _texts(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """line_id, first, line, keys (of REGIONS) of the lines of wanted (line_id, first)."""
    per_doc = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("line_id", F.col("first.no").alias("no"))).alias("lines"))
    packed = parsed.select("__id", "__th", "__packed")
    found = packed.join(per_doc, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("th"))).select("doc_id", "th", "__packed", "lines")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for b in bytesops.batches(batches):
            owner, entries = b.column("lines").value_parent_indices(), b.column("lines").flatten()
            line_id, no = (entries.field(c) for c in ("line_id", "no"))
            picked, last, lines = [], -1, []
            for k, n in zip(owner.to_pylist(), no.to_pylist(), strict=True):
                if k != last:
                    lines, last = loose.decompress(b.column("__packed")[k].as_py()).split(b"\n"), k
                picked.append(lines[n].strip(bytes(_SPACE)))
            ids = [b.column(c).take(owner) for c in ("doc_id", "th")]
            first = pa.StructArray.from_arrays([*ids, no], fields=list(schema.field("first").type))
            line = pa.array(picked, pa.binary()).cast(pa.string())
            for at, end, data, offsets in bytesops.pieces(line):
                place, before = characters(data)
                keys = frames(bytesops.prefix_hash(data), place, before[offsets[:-1]], before[offsets[1:]], REGIONS).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * 2 * REGIONS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([x.slice(at, end - at) for x in (line_id, first, line)] + [keys], schema=schema)

    schema = pa.schema([("line_id", pa.int64()), ("first", pa.struct([("doc_id", pa.int64()), ("th", pa.int64()), ("no", pa.int32())])), ("line", pa.string()), ("keys", pa.list_(pa.int64()))])
    return found.mapInArrow(fetch, "line_id bigint, first struct<doc_id:bigint,th:bigint,no:int>, line string, keys array<bigint>")


def _variants(lines: DataFrame) -> DataFrame:
    """line_id, first, variant, place of lines with frames: the line's own hash at place -1, if it shares the frame of a line of one
    character more, and those with the character at a place deleted, for the places of the regions whose frames it shares."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(batches):
            for at, end, data, offsets in bytesops.pieces(b.column("line"), 1 << 18):
                part = b.slice(at, end - at)
                byte, before = characters(data)
                head = before[offsets]
                n, prefix = np.diff(head), bytesops.prefix_hash(data)
                row, frame = part.column("frames").value_parent_indices().to_numpy(), part.column("frames").flatten().to_numpy().astype(np.int64)
                own = np.unique(row[frame >= REGIONS])
                row, frame = row[frame < REGIONS], frame[frame < REGIONS]
                low = n[row] * frame // REGIONS
                count = n[row] * (frame + 1) // REGIONS - low
                place = np.concatenate([np.full(len(own), -1), units.expand(low, count)])
                row = np.concatenate([own, np.repeat(row, count)])
                start, stop = offsets[:-1][row], offsets[1:][row]
                gone = np.where(place < 0, stop, byte[head[:-1][row] + np.maximum(place, 0)])
                rest = np.where(place < 0, stop, byte[head[:-1][row] + np.maximum(place, 0) + 1])
                # the hash of what stands before the deleted character and after it, as of one run
                back, power = bytesops.powers(bytesops._INVERSE, len(data) + 1), bytesops.powers(bytesops._BASE, len(data) + 1)
                left = (prefix[gone] - prefix[start]) * back[start]
                right = (prefix[stop] - prefix[rest]) * back[rest] * power[gone - start]
                variant = bytesops.mix(left + right + (stop - start - (rest - gone)).astype(U64) * U64(0xA0761D6478BD642F))
                taken = [part.column(c).take(pa.array(row)) for c in ("line_id", "first")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(variant.view(np.int64)), pa.array(place)], ["line_id", "first", "variant", "place"])

    schema = "line_id bigint, first struct<doc_id:bigint,th:bigint,no:int>, variant bigint, place bigint"
    return lines.select("line_id", "first", "line", "frames").mapInArrow(delete, schema)


def _near(lines: DataFrame, near_chars: int) -> DataFrame:
    """The lines (line_id) of lines (line_id, first, line, frames) that have an earlier one within one edit."""
    variants = graph.cut(_variants(lines))
    own = F.col("place") < 0
    line = F.struct("first", "line_id")
    by_place = variants.filter(~own).groupBy("variant", "place").agg(F.min(line).alias("least"), F.max(line).alias("most")).filter("least.first < most.first").drop("most")
    by_text = variants.groupBy("variant").agg(F.min(F.when(own, line)).alias("whole"), F.min(F.when(~own, line)).alias("least"))
    by_text = by_text.filter("whole IS NOT NULL AND least IS NOT NULL")
    at_place = variants.filter(~own).join(by_place, ["variant", "place"]).select("line_id", "first", "least")
    longer = variants.filter(~own).join(by_text.select("variant", F.col("whole").alias("least")), "variant").select("line_id", "first", "least")
    shorter = variants.filter(own).join(by_text.select("variant", "least"), "variant").select("line_id", "first", "least")
    pairs = at_place.unionByName(longer).unionByName(shorter).filter(F.col("least.first") < F.col("first")).select("line_id", F.col("least.line_id").alias("earlier")).distinct()
    named = lines.select("line_id", "line")
    partner = named.select(F.col("line_id").alias("earlier"), F.col("line").alias("other"))
    good = pairs.join(named.filter(F.length("line") >= near_chars), "line_id").join(partner, "earlier").filter(F.levenshtein("line", "other", 1).between(0, 1))
    return good.select("line_id").distinct()


def _removals(parsed: DataFrame, near_chars: int) -> DataFrame:
    """doc_id, th, gone (the numbers of the lines that go, from 0) of the documents that lose lines."""
    lines = _occurrences(parsed, "__keys").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "no")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    lines = graph.table(lines.withColumn("line_id", F.monotonically_increasing_id()))  # written, so the numbers do not change
    wanted = lines.select("line_id", "first").join(_sharing(lines).select("line_id"), "line_id")
    texts = graph.cut(_texts(parsed, wanted))
    close = graph.cut(texts.select("line_id", "first", "line").join(_sharing(texts), "line_id"))
    near = _near(close, near_chars).withColumn("near", F.lit(True))
    bad = lines.select("line_id", "h1", "h2", "first", "n").join(near, "line_id", "left").filter("n > 1 OR near").select("h1", "h2", "first", "n", F.col("near").isNotNull().alias("near"))
    here = graph.join_dealt(_occurrences(parsed), bad, lines, ["h1", "h2"], ["doc_id", "th", "no"])
    later = ~F.struct("doc_id", "th", "no").eqNullSafe(F.col("first"))
    return here.filter(F.col("near") | later).groupBy("doc_id", "th").agg(F.collect_set("no").alias("gone"))


def deduplicate(docs: DataFrame, near_chars: int = NEAR_CHARS, drop_emptied: bool = False) -> DataFrame:
    """docs without the lines that repeat an earlier one, and the columns n_lines, n_removed and kept_sha256
    (of the text left; columns of these names are replaced).

    Lines end at line feeds; n_lines counts those that are not blank. Texts that lose nothing stay as they are,
    nulls too (their digest is that of an empty text). Among rows with the same doc_id the order is that
    of their texts' hashes; rows that repeat both are one document, which keeps its lines in every copy.
    drop_emptied: leave out documents of which only blank lines are left, if they had others.
    """
    made = ["n_lines", "n_removed", "kept_sha256"]
    docs, back = graph.aside(docs.select(*[f"`{c}`" for c in docs.columns if c not in made]), ("doc_id", "text"))
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    parsed = _parsed(docs.select(*columns, F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__th")), near_chars)
    gone = _removals(parsed, near_chars).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__hash"), "gone")
    joined = parsed.select(*others, "__id", "__th", "__packed", F.size("__no").cast("bigint").alias("__lines"))
    joined = joined.join(gone, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left").select(*others, "__packed", "__lines", F.col("gone").alias("__gone"))
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def remove(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for b in bytesops.batches(source):
            texts, counts = [], []
            for packed, gone in zip(b.column("__packed").to_pylist(), b.column("__gone").to_pylist(), strict=True):
                text = None if packed is None else loose.decompress(packed)
                if gone:
                    away = set(gone)
                    text = b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in away])
                texts.append(text)
                counts.append((len(gone or ()), hashlib.sha256(text or b"").hexdigest()))
            removed = pa.array([c[0] for c in counts], pa.int64())
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in columns]
            out = pa.RecordBatch.from_arrays([*arrays, b.column("__lines"), removed, pa.array([c[1] for c in counts], pa.string())], [*columns, *made])
            total, lost = b.column("__lines").to_numpy(), removed.to_numpy()
            yield out.filter(pa.array((total == 0) | (lost < total))) if drop_emptied else out

    return back(joined.mapInArrow(remove, schema))
