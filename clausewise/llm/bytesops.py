"""Whole-batch text primitives on numpy arrays: no loop runs over rows, words or bytes.

A batch of texts is one array of UTF-8 bytes with offsets, as Arrow holds it. Batches
are cut into pieces of about PIECE bytes (a longer text is a piece of its own), which
bounds the temporary arrays whatever the size of a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
LONG_WORD = 256
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[0] = 0, so that bytes [a, b) hash to span_hash(P, a, b)."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes between start and end, the same wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive pieces of a string column."""
    data, offsets = column_bytes(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def release() -> None:
    """Give freed memory back to the system. Workers are reused, and what one task has freed would count against the next one."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    release()
    for b in source:
        if b.num_rows:
            yield b
    release()


#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and whatever is not ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each text (rows + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] = inside[cut]
    cut = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words. Polynomials modulo 2 ** 64 agree for some long texts, whatever the base, so the hashes of words of
    over LONG_WORD bytes are parts of their digests."""
    out = span_hash(prefix_hash(data), start, end)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of a digest of the words of each text, as they follow each other (texts x 2); data is lower-cased."""
    inside = WORD[data]
    behind = np.append(False, inside[:-1])[: len(data)]
    behind[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = inside | behind
    raw = np.where(inside, data, 32).astype(np.uint8)[keep].tobytes()
    cut = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
    parts = [hashlib.blake2b(raw[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(cut, cut[1:], strict=False)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word, and the number of words before each text."""
    data = LOWER[data]
    start, end, before = word_spans(data, offsets)
    return word_hash(data, start, end), before


def shingles(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text (a text of fewer words, but not none, is one run),
    and the number of runs before each text."""
    counts = np.diff(before)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    after = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    start = np.arange(after[-1], dtype=np.int64) + np.repeat(before[:-1] - after[:-1], runs)
    padded = np.concatenate([words, np.zeros(n, U64)])
    short = np.repeat(np.where(counts < n, counts, n), runs)
    out = np.zeros(after[-1], U64)
    for j in range(n):
        term = padded[start + j] * U64(pow(_BASE, 2 * j + 3, 1 << 64))
        out += np.where(short > j, term, U64(0)) if (short < n).any() else term
    return mix(out + short.astype(U64)), after


def letters_of(texts: list[str]) -> list[bool]:
    return [any(map(str.isalpha, t)) for t in texts]
