"""Cutting texts into short units that repeat, and remembering what was made of each.

Tokenizers never join text across certain boundaries (a blank after another character). The
bytes between two boundaries are a unit; each distinct unit is handled once and then looked up.
"""

from __future__ import annotations

import numpy as np

from . import bytesops

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The last two bytes of the white-space characters beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[0xC2, 0x9A, 0x80, 0x81]] = True
_WIDE_LAST = np.zeros(256, bool)
_WIDE_LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


def spans(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(first)
    return start, np.append(start[1:], size)[: len(start)]


def text_starts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[:-1] < offsets[1:]]


def blank_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of blanks with what follows them up to the next blank. No unit
    starts after white space, so patterns over runs of white space see them whole."""
    blank = BLANK[data]
    first = np.zeros(len(data), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    first[2:] &= ~(_WIDE_LAST[data[1:-1]] & _WIDE_FIRST[data[:-2]])
    first[text_starts(offsets)] = True
    return spans(first, len(data))


def ends_blank(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span ends with white space, or may do so."""
    last = data[end - 1]
    return BLANK[last] | (_WIDE_LAST[last] & _WIDE_FIRST[data[np.maximum(end - 2, 0)]] & (end - start > 1))


class Grow:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.array, self.size = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.array):
            self.array = np.concatenate([self.array, np.zeros(max(need, len(self.array)), self.array.dtype)])
        self.array[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.array[: self.size]


#: By a number of bytes from 0 to 8: the bits of a word that hold them.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Seen:
    """Numbers for units, in order of first sight; forgets all when it has over limit of them.

    Units of up to 16 bytes are two words. A table of 2 ** slots places finds the last unit of each hash; it is taken
    only if the words and the length are the same, so no two units share a number. Longer ones are looked up one by one.
    A unit that lost its place to another gets a new number.
    """

    def __init__(self, limit: int, slots: int = 20):
        self.limit, self.slots, self.size = limit, slots, 0
        self.place = np.full(1 << slots, -1, np.int32)
        self.words, self.length = (Grow(np.uint64), Grow(np.uint64)), Grow(np.int64)
        self.long: dict[bytes, int] = {}

    def full(self) -> bool:
        return self.size > self.limit

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit, and the places of the first sight of the new ones, in order of their numbers."""
        length = end - start
        padded = np.append(data, np.zeros(16, np.uint8))
        window = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))
        words = window[start] & _HELD[np.minimum(length, 8)], window[np.minimum(start + 8, len(data))] & _HELD[np.clip(length - 8, 0, 8)]
        hashes = bytesops.mix(words[0] * np.uint64(0x9E3779B97F4A7C15) + bytesops.mix(words[1] + length.astype(np.uint64)))
        slot = (hashes >> np.uint64(64 - self.slots)).astype(np.int64)
        out = self.place.take(slot).astype(np.int64)
        known = out >= 0
        known[known] = self._same(words, length, np.flatnonzero(known), out[known])
        known &= length <= 16
        some = np.flatnonzero(~known & (length <= 16))
        new = some[:0]
        if len(some):
            _, first, inverse = np.unique(hashes[some], return_index=True, return_inverse=True)
            new = some[first]
            out[some] = self.size + inverse
            self._keep(words, length, new)
            other = some[~self._same(words, length, some, out[some])]  # equal hashes of different units
            out[other] = np.arange(self.size, self.size + len(other))
            self._keep(words, length, other)
            self.place[slot[new]] = out[new]
            new = np.append(new, other)
        raw, late = data.tobytes(), []
        for k in np.flatnonzero(length > 16).tolist():
            number = self.long.setdefault(raw[start[k] : end[k]], self.size + len(late))
            if number == self.size + len(late):
                late.append(k)
            out[k] = number
        late = np.array(late, np.int64)
        self._keep(words, length, late)
        return out, np.append(new, late)

    def _same(self, words: tuple, length: np.ndarray, which: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (self.words[0].values[number] == words[0][which]) & (self.words[1].values[number] == words[1][which]) & (self.length.values[number] == length[which])

    def _keep(self, words: tuple, length: np.ndarray, which: np.ndarray) -> None:
        for held, own in zip((*self.words, self.length), (*words, length), strict=True):
            held.add(own[which])
        self.size += len(which)


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)


__all__ = ["Grow", "Seen", "blank_units", "bytesops", "expand", "spans", "text_starts"]
