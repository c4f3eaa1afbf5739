"""SentencePiece segmentation by forward filtering and backward sampling, and its lossless inverse.

A text is a blank and the text itself, blanks standing for the word mark of the pieces. Its
segmentations form a lattice whose edges are pieces; characters that no piece covers have one edge
per byte. Forward filtering sums the weights of all paths to each node; walking back from the end,
each edge is drawn with its share of that sum, so a segmentation comes up with its exact
probability. Draws are a function of the row's key, the place in the text and a seed, hence the
same on every run and machine.

Pieces never cross the start of a run of blanks or a line end (models where one does are refused),
so lattices are built per unit between those; each distinct unit once, all new units of a batch at a
time. A node that no edge spans is on every path, so the sums begin anew there: long units take as
many steps as their longest run without such a node. Files with merge ranks instead of log
probabilities as scores get the weights of Zipf's law, 1 / rank ** alpha.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops, graph, units

#: Units and nodes of lattices that are remembered, about; bytes of text that are taken at a time.
REMEMBERED, NODES, PIECE = 120_000, 1_000_000, 1 << 19
MARK = "▁"
U64 = np.uint64


class Vocabulary:
    """The pieces of a model file, their bytes and weights."""

    def __init__(self, model_file: str, alpha: float):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.vocab_size()
        score = np.array([p.get_score(i) for i in range(n)])
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1)
        plain = []
        for i in range(n):
            if p.is_byte(i):
                self.byte_id[int(p.id_to_piece(i)[3:5], 16)] = i
                self.bytes[i] = bytes([int(p.id_to_piece(i)[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.bytes[i] = p.id_to_piece(i).replace(MARK, " ").encode()
                plain.append(i)
                if re.search(rb"[^ ] |.\n|\n.", self.bytes[i], re.DOTALL):
                    raise ValueError(f"piece {i} goes on over the start of a run of blanks or a line end")
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so not every text could be decoded again")
        ranks = all(s == round(s) for s in score[plain]) and score[plain].min() < -1000
        weight = -np.log(2 - score) if ranks else score
        self.weight = np.where(self.byte_id_mask(n), weight[plain].min() - 4, weight) * alpha
        self.length = np.array([len(b) for b in self.bytes])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        by_length: dict[int, list[int]] = {}
        for i in plain:
            by_length.setdefault(len(self.bytes[i]), []).append(i)
        self.lookup = {}
        for size, ids in sorted(by_length.items()):
            data = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * size
            h = bytesops.span_hash(bytesops.prefix_hash(data), at, at + size)
            order = np.argsort(h)
            # the hashes in order, with the place of the first one for each value of their first 16 bits
            self.lookup[size] = (np.append(h[order], U64(0)), np.append(np.array(ids)[order], -1), np.searchsorted(h[order] >> U64(48), np.arange(1 << 16)).astype(np.int32))

    def byte_id_mask(self, n: int) -> np.ndarray:
        mask = np.zeros(n, bool)
        mask[self.byte_id] = True
        return mask

    def find(self, prefix: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """The piece of so many bytes at each start, or -1."""
        if size not in self.lookup:
            return np.full(len(start), -1)
        known, ids, first = self.lookup[size]
        h = bytesops.span_hash(prefix, start, start + size)
        at = first[h >> U64(48)]
        there = known[at]
        hit = there == h
        behind = np.flatnonzero(~hit & (there >> U64(48) == h >> U64(48)))  # others begin with the same bits
        if len(behind):
            at[behind] = np.searchsorted(known[:-1], h[behind])
            hit[behind] = known[at[behind]] == h[behind]
        return np.where(hit, ids[at], -1)


@functools.cache  # once in each worker process
def _vocabulary(model_file: str, alpha: float) -> Vocabulary:
    return Vocabulary(model_file, alpha)


class Lattices:
    """The lattices of the units seen so far: nodes numbered unit by unit; per node its edges, with cumulated chances."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.seen = units.Seen(REMEMBERED)
        self.first_node = units.Grow(np.int64)
        self.nodes = 0
        self.edge = units.Grow(np.int32)  # the first of each node
        self.key, self.source, self.piece = units.Grow(np.float64), units.Grow(np.int32), units.Grow(np.int32)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last node of each unit."""
        if self.seen.full() or self.nodes > NODES:
            self.clear()
        number, new = self.seen.look_up(data, start, end)
        if len(new):
            self._add(data, bytesops.prefix_hash(data), start[new], (end - start)[new])
        first = self.first_node.values[number]
        return first, first + (end - start)

    def _add(self, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        v, base = self.vocabulary, np.cumsum(length + 1) - (length + 1)
        source, size, piece = [], [], []
        for width in v.lookup:
            some = np.flatnonzero(length >= width)
            if not len(some):
                continue
            count = length[some] - width + 1
            at = units.expand(start[some], count)
            found = v.find(prefix, at, width)
            hit = np.flatnonzero(found >= 0)
            source.append(units.expand(base[some], count)[hit])
            size.append(np.full(len(hit), width))
            piece.append(found[hit])
        at, node = units.expand(start, length), units.expand(base, length)
        head = (data[at] & 0xC0) != 0x80
        of = np.maximum(np.cumsum(head) - 1, 0)
        lead, width = at[head], np.bincount(of)
        covered = np.zeros(len(lead), bool)
        for w in np.unique(width):
            same = width == w
            covered[same] = v.find(prefix, lead[same], int(w)) >= 0
        bare = ~covered[of]
        source.append(node[bare])
        size.append(np.ones(int(bare.sum()), np.int64))
        piece.append(v.byte_id[data[at[bare]]])
        source, size, piece = (np.concatenate(x) for x in (source, size, piece))
        target = source + size
        count = int(base[-1] + length[-1] + 1)
        spanned = np.cumsum(np.bincount(source + 1, minlength=count + 1) - np.bincount(target, minlength=count + 1))[:count]
        free = spanned == 0  # nodes that no edge spans, the ends of units among them
        # places count from the free node before a node; at a free node also that from the one before it
        since = np.maximum.accumulate(np.where(free, np.arange(count), 0))
        place = np.arange(count) - np.where(free, np.append(0, since[:-1]), since)
        # forward, by place; a node has one edge of each size at most, so no two keys are equal
        order = np.argsort((place[target] * len(place) + target << 8) + size)
        s, t, w = source[order], target[order], v.weight[piece[order]]
        forward = np.where(free, 0.0, -np.inf)
        chance = np.empty(len(s))
        steps = np.searchsorted(place[t], np.arange(1, place[t].max() + 2))
        for lo, hi in zip(steps, steps[1:], strict=False):
            if lo == hi:
                continue
            value = forward[s[lo:hi]] + w[lo:hi]
            cut = np.flatnonzero(np.append(True, t[lo + 1 : hi] != t[lo : hi - 1]))
            count = np.diff(np.append(cut, hi - lo))
            most = np.maximum.reduceat(value, cut)
            share = np.exp(value - np.repeat(most, count))
            total = np.add.reduceat(share, cut)
            ends = t[lo:hi][cut]
            forward[ends] = np.where(free[ends], 0, most + np.log(total))
            chance[lo:hi] = share / np.repeat(total, count)
        by_node = np.argsort((t << 28) + (((1 - chance) * (1 << 20)).astype(np.int64) << 8) + (t - s))  # likely edges first
        s, t, chance = s[by_node], t[by_node], chance[by_node]
        upto = np.cumsum(chance)
        last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
        count = np.diff(np.append(-1, last))
        upto -= np.repeat(np.append(0, upto[last[:-1]]), count)
        key = t + np.clip(upto, 0, 1)
        key[last] = t[last] + 1
        self.edge.add((np.searchsorted(t, np.arange(len(place))) + self.key.size).astype(np.int32))
        self.key.add(key + self.nodes)
        self.source.add(s + self.nodes)
        self.piece.add(piece[order][by_node])
        self.first_node.add(base + self.nodes)
        self.nodes += len(place)

    def draw(self, first: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each unit: (pieces of all units in order, number of pieces of each)."""
        key, source, piece, start = self.key.values, self.source.values, self.piece.values, self.edge.values
        node, alive, drawn, count = last.copy(), np.arange(len(last)), [], np.zeros(len(last), np.int64)
        while len(alive):
            u = (bytesops.mix(seed[alive] + (last[alive] - node[alive]).astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)) * 2.0**-53
            edge, bar = start[node[alive]], node[alive] + u
            more = np.flatnonzero(key[edge] <= bar)
            while len(more):
                edge[more] += 1
                more = more[key[edge[more]] <= bar[more]]
            drawn.append((alive, piece[edge]))
            count[alive] += 1
            node[alive] = source[edge]
            alive = alive[node[alive] != first[alive]]
        out = np.empty(int(count.sum()), np.int32)
        end = np.cumsum(count)
        for k, (who, what) in enumerate(drawn):
            out[end[who] - 1 - k] = what
        return out, count


def with_blank(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that are not empty with a blank before each."""
    full = offsets[:-1] < offsets[1:]
    shifted = np.concatenate([[0], np.cumsum(np.diff(offsets) + full)])
    out = np.full(shifted[-1], 32, np.uint8)
    keep = np.ones(shifted[-1], bool)
    keep[shifted[:-1][full]] = False
    out[keep] = data
    return out, shifted


def cut_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank, line = data == 32, data == 10
    first = line.copy()
    first[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
    first[units.text_starts(offsets)] = True
    return units.spans(first, len(data))


def encode_piece(lattices: Lattices, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, number of pieces before each text)."""
    data, offsets = with_blank(data, offsets)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    start, end = cut_units(data, offsets)
    first, last = lattices.of(data, start, end)
    before = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    place = np.arange(len(start)) - before[:-1][text]
    seed = bytesops.mix(keys[text] + place.astype(U64) * U64(0xD1B54A32D192ED03))
    pieces, count = lattices.draw(first, last, seed)
    return pieces, np.concatenate([[0], np.cumsum(count)])[before]


def decode_piece(vocabulary: Vocabulary, pieces: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets: the inverse of encode_piece."""
    length = vocabulary.length[pieces]
    data = vocabulary.flat[units.expand(vocabulary.start[pieces], length)]
    offsets = np.concatenate([[0], np.cumsum(length)])[before]
    full = offsets[:-1] < offsets[1:]
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][full]] = False
    return data[keep], np.concatenate([[0], np.cumsum(np.diff(offsets) - full)])


def encode(docs: DataFrame, model_file: str, seed: int = 0, alpha: float = 1.0, keep: list[str] | None = None, digest: bool = False, decoded: str | None = None, checks: bool = True) -> DataFrame:
    """docs with pieces (array<int>), n_pieces, pieces_crc32 (of the ids as little-endian 32-bit integers) and
    lossless (whether decoding gives the text back, which is checked for every row).

    The draws follow seed and doc_id alone, so rows that repeat both get the same pieces for the same text.
    Null texts count as empty; empty texts have no pieces. Columns of docs with these names are replaced.
    keep: the columns returned with them (all by default); digest: leave out pieces; checks: with pieces_crc32 and
    lossless; decoded: the name of a column for the text that the pieces give again.
    """
    made = ["pieces", "n_pieces", *["pieces_crc32", "lossless"] * checks, *[decoded] * bool(decoded)]
    keep = [c for c in docs.columns if c not in made] if keep is None else keep
    kinds = {"pieces": T.ArrayType(T.IntegerType()), "n_pieces": T.LongType(), "pieces_crc32": T.LongType(), "lossless": T.BooleanType()}
    fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in made]
    schema = T.StructType([docs.schema[c] for c in keep] + fields[int(digest) :])
    text, key = graph.unused(docs, "text"), graph.unused(docs, "key")
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias(text), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias(key))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model_file, alpha)
        lattices = Lattices(vocabulary)
        for b in bytesops.batches(source):
            keys = b.column(key).to_numpy().view(U64)
            for at, end, data, offsets in bytesops.pieces(b.column(text), PIECE):
                pieces, before = encode_piece(lattices, data, offsets, keys[at:end])
                back, upto = decode_piece(vocabulary, pieces, before)
                good = np.ones(end - at, bool)
                if not (np.array_equal(upto, offsets) and np.array_equal(back, data)):
                    good[:] = [np.array_equal(back[upto[i] : upto[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(end - at)]
                crc = checks and [zlib.crc32(pieces[x:y].astype("<u4").tobytes()) for x, y in zip(before, before[1:], strict=False)]
                arrays = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(pieces)), pa.array(np.diff(before)), *([pa.array(crc, pa.int64()), pa.array(good)] if checks else []), *([_text(back, upto)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, end - at) for c in keep], *arrays[int(digest) :]], [*keep, *made[int(digest) :]])

    return source.mapInArrow(run, schema)


def _text(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def decode(encoded: DataFrame, model_file: str, column: str = "text") -> DataFrame:
    """encoded with the text of its pieces in column (replaced if it is there); null pieces give an empty text."""
    others = [c for c in encoded.columns if c != column]
    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(column, T.StringType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model_file, 1.0)
        for b in bytesops.batches(source):
            lists = b.column("pieces")
            count = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            data, offsets = decode_piece(vocabulary, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(count)]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], _text(data, offsets)], [*others, column])

    return encoded.select(*others).mapInArrow(run, schema)
