"""An adaptive context-mixing range coder for token ids, many blocks at a time.

The next id is predicted by models of three orders. Ids are followed by much the same ids as others of
their class, so order 1 is a table of shares for each class of the id before; order 0, the shares of all
ids, is mixed into each of these tables, the more, the more kinds of ids follow a class. Order 2 expects
the id that last followed the same two ids in the block; its weight adapts to how often that came true
lately, by the length of its success. One step of a range coder with 62 bits and carry propagation takes
an id by the mixture.

The classes and tables are counted over a file and stand in its header. Every block begins with
them, with an empty memory and with the same weights: it can be read with the header alone, and
carries a checksum. Blocks are independent, so numpy runs a step of all blocks at a time (lanes);
only integers are used, and decoding repeats the encoder's arithmetic exactly.

The SINGLES most frequent ids of a file have a share each; the others follow by frequency in groups
of 2 ** GROUP with a share each, and their places in the group are written plainly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 1024, 4096
MAGIC = b"CMR2"
SLOTS, MIX = 16, 8  # bits of a table's shares, and of the weights of the tables and the memory
TOP, WORD = 62, 32  # bits of the coder, and of what it writes at a time
_LEAST = 1 << TOP - WORD  # of the span; low has room for one carry above TOP
SINGLES, GROUP = 4096, 8  # of ids; bits of a place in a group
CLASSES, CLASS_IDS, SKETCH, ROUNDS = 32, 16_384, 128, 6
_MEMORY = 11  # bits of the memory's places
#: The value of a code of 3 bits behind the leading one and 5 bits of exponent; 0 is 0.
_VALUE = np.array([0] + [(8 + (c & 7)) << (c >> 3) >> 3 for c in range(255)], np.int64)


class _Tables:
    """What a file's header has: the ids by symbol, the class of each symbol (0 stands for the start of a block), and the shares by class."""

    def __init__(self, ids: np.ndarray, singles: int, classes: int, class_of: np.ndarray, codes: np.ndarray):
        self.ids, self.singles, self.classes, self.class_of, self.codes = ids, singles, classes, class_of.astype(np.int64), codes
        value = _VALUE[codes]  # classes x symbols
        n, total = value.shape[1], value.sum(0)
        shares = np.zeros((classes, n), np.int64)
        for k in range(classes):
            # the more kinds of ids follow a class, the more likely is one that has not yet
            weight = value[k] * max(1, int(total.sum())) + total * int((value[k] > 0).sum()) + (value[k].sum() == 0)
            weight = weight >> max(0, int(weight.max()).bit_length() - 40)
            shares[k] = 1 + weight * ((1 << SLOTS) - n) // max(1, int(weight.sum()))
            shares[k, weight.argmax()] += (1 << SLOTS) - shares[k].sum()
        self.n = n
        self.upto = np.concatenate([np.zeros((classes, 1), np.int64), np.cumsum(shares, 1)], 1).ravel()
        self.symbol_of = np.repeat(np.tile(np.arange(1, n + 1, dtype=np.uint16), classes), shares.ravel())

    @classmethod
    def count(cls, ids: np.ndarray, block: int) -> tuple[_Tables, np.ndarray, np.ndarray | None]:
        """The tables of a file, and its ids as symbols (from 1) and places in their groups (None without groups)."""
        if ids.max() < max(1 << 16, 4 * len(ids)):
            often = np.bincount(ids)
            known, number = np.flatnonzero(often), ids
            often, width = often[known], len(often)
        else:
            known, number, often = np.unique(ids, return_inverse=True, return_counts=True)
            width = len(known)
        if len(known) > SINGLES + ((1 << 14) - 2 - SINGLES << GROUP):
            raise ValueError("too many different ids for a file")
        by_count = np.argsort(-_code(often).astype(np.int64), kind="stable")
        order = np.concatenate([np.sort(by_count[:SINGLES]), by_count[SINGLES:]])
        singles, rank = min(SINGLES, len(known)), np.arange(len(known))
        table, places = np.zeros(width, np.uint16), np.zeros(width, np.uint8)
        at = known[order] if width > len(known) else order
        table[at] = np.where(rank < singles, rank, singles + (rank - singles >> GROUP)) + 1
        symbol, place = table[number.ravel()], None
        if len(known) > singles:
            places[at] = np.where(rank < singles, 0, (rank - singles) & (1 << GROUP) - 1)
            place = places[number.ravel()]
        n, classes = int(table.max()), int(np.clip(len(ids) // CLASS_IDS, 1, CLASSES))
        before = np.zeros(len(symbol), np.int64)
        before[1:] = symbol[:-1]
        before[::block] = 0
        class_of = _classes(before, symbol, n, classes)
        codes = _code(np.bincount(class_of[before] * (n + 1) + symbol, minlength=classes * (n + 1))).reshape(classes, n + 1)[:, 1:]
        return cls(known[order], singles, classes, class_of, codes), symbol, place

    def pack(self) -> bytes:
        parts = [np.diff(self.ids, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), self.class_of.astype(np.uint8).tobytes(), self.codes.tobytes()]
        return zlib.compress(struct.pack("<IIII", len(self.ids), self.singles, self.n, self.classes) + b"".join(parts), 6)

    @classmethod
    def unpack(cls, packed: bytes) -> _Tables:
        raw = zlib.decompress(packed)
        count, singles, n, classes = struct.unpack_from("<IIII", raw)
        ids = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * count, 16).reshape(8, count).T).view("<i8").ravel()
        class_of = np.frombuffer(raw, np.uint8, n + 1, 16 + 8 * count)
        return cls(np.cumsum(ids), singles, classes, class_of, np.frombuffer(raw, np.uint8, classes * n, 16 + 8 * count + n + 1).reshape(classes, n))


def _code(count: np.ndarray) -> np.ndarray:
    """The codes whose values are nearest below the counts."""
    return (np.searchsorted(_VALUE[:250], np.minimum(count, _VALUE[249]), "right") - 1).astype(np.uint8)


def _classes(before: np.ndarray, after: np.ndarray, n: int, classes: int) -> np.ndarray:
    """The class of each symbol: symbols that are followed by much the same symbols have one (k-means on
    hashed counts of what follows). Symbols that no other follows are of class 0."""
    out = np.zeros(n + 1, np.int64)
    often = np.bincount(before, minlength=n + 1)
    some = np.flatnonzero(often)
    if classes == 1 or not len(some):
        return out
    bucket = (np.arange(n + 1) * 2654435761 >> 8) % SKETCH
    sketch = np.bincount(before * SKETCH + bucket[after], minlength=(n + 1) * SKETCH).reshape(n + 1, SKETCH)[some].astype(np.float32)
    sketch = np.sqrt(sketch / often[some, None])
    centre = sketch[np.argsort(-often[some], kind="stable")[:classes]]
    for _ in range(ROUNDS):
        near = (2 * sketch @ centre.T - (centre**2).sum(1)).argmax(1)
        weight = np.zeros((len(centre), len(some)), np.float32)
        weight[near, np.arange(len(some))] = often[some]
        total = weight.sum(1, keepdims=True)
        centre = np.where(total > 0, weight @ sketch / np.maximum(total, 1), centre)
    out[some] = near
    return out


class _Model:
    """The state of all lanes. begin() makes the mixture, cut() and find() use it, end() takes the symbol that came.

    Symbols count from 1. An entry of the memory is the symbol that came last, and in two bits the length of its
    success; 0 expects nothing. All places that are looked up lie within their tables; "clip" spares numpy its check of that.
    """

    def __init__(self, lanes: int, tables: _Tables):
        lane, symbol = np.arange(lanes), np.arange(tables.n + 1)
        self.upto, self.symbol_of = tables.upto, tables.symbol_of
        self.table_at, self.slots_at = tables.class_of * (tables.n + 1), tables.class_of << SLOTS
        self.hash_last, self.hash_before = symbol * 2654435761 >> 7 & (1 << _MEMORY) - 1, symbol * 2246822519 >> 9 & (1 << _MEMORY) - 1
        self.memory = np.zeros(lanes << _MEMORY, np.uint16)
        self.first, self.slots = lane << _MEMORY, lane * 4
        # by lane and length of success: how often the expected symbol came, in parts of 2 ** 16
        self.trust = np.tile(np.array([0, 1 << 13, 3 << 14, 7 << 13], np.int64), lanes)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def shrink(self, lanes: int) -> None:
        if lanes < len(self.last):
            self.first, self.slots, self.last, self.before = self.first[:lanes], self.slots[:lanes], self.last[:lanes], self.before[:lanes]

    def begin(self) -> None:
        self.at = self.hash_last.take(self.last, mode="clip")
        self.at ^= self.before
        self.at += self.first
        entry = self.memory.take(self.at, mode="clip")
        self.seen = entry & 3
        entry >>= 2
        self.guess = entry.astype(np.int64)
        self.slot = self.slots + self.seen
        self.trusted = self.trust.take(self.slot, mode="clip")
        self.extra = self.trusted >> 16 - MIX
        self.rest = (1 << MIX) - self.extra
        self.extra <<= SLOTS
        self.base = self.table_at.take(self.last, mode="clip")

    def cut(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixture's share of the symbols below symbol, and of symbol."""
        at = self.base + symbol
        width = self.upto.take(at, mode="clip")
        at -= 1
        below = self.upto.take(at, mode="clip")
        width -= below
        width *= self.rest
        below *= self.rest
        self.right = self.guess == symbol
        width += self.right * self.extra
        below += (self.guess < symbol) * self.extra
        return below, width

    def find(self, share: np.ndarray) -> np.ndarray:
        """The symbol in whose part of the mixture the share lies."""
        end = self.upto.take(self.base + self.guess, mode="clip")
        end *= self.rest
        share = np.where(share < end + self.extra, np.minimum(share, np.maximum(end - 1, share * (self.extra == 0))), share - self.extra)
        share = (share / self.rest).astype(np.int64)  # exact, for both are far below 2 ** 53
        share += self.slots_at.take(self.last, mode="clip")
        return self.symbol_of.take(share, mode="clip").astype(np.int64)

    def end(self, symbol: np.ndarray) -> None:
        moved = self.right * 65535
        moved -= self.trusted
        moved >>= 5
        moved += self.trusted
        self.trust[self.slot] = moved
        entry = np.minimum(self.seen, 2)
        entry *= self.right
        entry += 1
        entry |= symbol.astype(np.uint16) << 2
        self.memory[self.at] = entry
        self.before, self.last = self.hash_before.take(self.last, mode="clip"), symbol


class _Writer:
    """Words are kept in order of time and dealt to their lanes at the end; then carries go into the words before them."""

    def __init__(self, lanes: int):
        self.low, self.span, self.used = np.zeros(lanes, np.int64), np.full(lanes, (1 << TOP) - 1, np.int64), np.zeros(lanes, np.int64)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.carries: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, below: np.ndarray, width: np.ndarray, alive: int) -> None:
        """A share of 2 ** (SLOTS + MIX) for each of the first lanes."""
        low, span = self.low[:alive], self.span[:alive]  # views
        span >>= SLOTS + MIX
        below *= span
        low += below
        span *= width
        self._renew(np.flatnonzero(span < _LEAST))

    def put_plain(self, lane: np.ndarray, place: np.ndarray) -> None:
        """GROUP bits for some lanes."""
        part = self.span[lane] >> GROUP
        self.low[lane] += part * place
        self.span[lane] = part
        self._renew(lane[part < _LEAST])

    def _renew(self, lane: np.ndarray) -> None:
        """Write a word of each lane; after that a span is large enough for any share."""
        low = self.low.take(lane)
        over = np.flatnonzero(low >> TOP)
        if len(over):
            self.carries.append((lane[over], self.used.take(lane[over])))
        self.words.append((lane.astype(np.int32), (low >> TOP - WORD).astype(np.uint32)))
        low &= _LEAST - 1
        low <<= WORD
        self.low[lane] = low
        self.used[lane] += 1
        self.span[lane] <<= WORD

    def done(self) -> list[bytes]:
        for _ in range(2):
            self._renew(np.arange(len(self.low)))
        lane = np.concatenate([x[0] for x in self.words])
        words = np.concatenate([x[1] for x in self.words])[np.argsort(lane, kind="stable")]
        first = np.cumsum(self.used) - self.used
        if self.carries:
            at = first[np.concatenate([x[0] for x in self.carries])] + np.concatenate([x[1] for x in self.carries]) - 1
            while len(at):
                np.add.at(words, at, np.uint32(1))
                at = at[words[at] == 0] - 1
        return [words[a : a + n].astype("<u4").tobytes() for a, n in zip(first.tolist(), self.used.tolist(), strict=True)]


def _at_once(blocks: int, lanes: int) -> int:
    """Blocks of a pass, about lanes; passes are even, for one of few blocks takes hardly less time."""
    return max(1, -(-blocks // max(1, round(blocks / lanes))))


def _alive(count: np.ndarray) -> np.ndarray:
    """By step: the lanes that have one more id; they come first, for count falls."""
    return np.searchsorted(-count, -np.arange(int(count.max(initial=0))), "left")


def _encode_lanes(symbol: np.ndarray, place: np.ndarray | None, count: np.ndarray, tables: _Tables) -> list[bytes]:
    """symbol, place: steps x lanes, padded; count: the ids of each lane, falling."""
    model, out = _Model(symbol.shape[1], tables), _Writer(symbol.shape[1])
    for t, alive in enumerate(_alive(count).tolist()):
        model.shrink(alive)
        now = symbol[t, :alive].astype(np.int64)
        model.begin()
        out.put(*model.cut(now), alive)
        if tables.n > tables.singles:
            group = np.flatnonzero(now > tables.singles)
            out.put_plain(group, place[t, group].astype(np.int64))
        model.end(now)
    return out.done()


def _decode_lanes(words: np.ndarray, count: np.ndarray, tables: _Tables) -> np.ndarray:
    """The ids (lanes x steps). words: lanes x words, padded; count: the ids of each lane, falling."""
    lanes, width = words.shape
    model = _Model(lanes, tables)
    words = words.ravel()
    at = np.arange(lanes) * width
    # the coder is two bits short of two words, so the last bits of a word wait for the next one
    code = words.take(at).astype(np.int64) << TOP - WORD | words.take(at + 1) >> 2 * WORD - TOP
    span, at = np.full(lanes, (1 << TOP) - 1, np.int64), at + 2
    alive = _alive(count).tolist()
    ranks = np.zeros((len(alive), lanes), np.int32)

    def fill(small: np.ndarray) -> None:
        if len(small):
            own = at.take(small)
            code[small] = code.take(small) << WORD | (words.take(own - 1) & 3).astype(np.int64) << WORD - 2 | words.take(own) >> 2
            at[small] = own + 1
            span[small] <<= WORD

    for t, some in enumerate(alive):
        model.shrink(some)
        model.begin()
        own_code, own_span = code[:some], span[:some]  # views
        own_span >>= SLOTS + MIX
        now = model.find(np.minimum(own_code // own_span, (1 << SLOTS + MIX) - 1))
        below, share = model.cut(now)
        own_code -= own_span * below
        own_span *= share
        fill(np.flatnonzero(own_span < _LEAST))
        ranks[t, :some] = now
        if tables.n > tables.singles:
            group = np.flatnonzero(now > tables.singles)
            part = span[group] >> GROUP
            place = np.minimum(code[group] // part, (1 << GROUP) - 1)
            code[group] -= part * place
            span[group] = part
            fill(group[part < _LEAST])
            ranks[t, group] = tables.singles + 1 + (now[group] - tables.singles - 1 << GROUP) + place
        model.end(now)
    ranks -= 1
    if ranks.max(initial=-1) >= len(tables.ids):
        raise ValueError("a block of a token file has a wrong checksum")
    return tables.ids[ranks.T]


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """The ids (from 0 to 2 ** 32 - 1) as a file: a header with the tables, then blocks, each with its own header,
    checksum and payload."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >= 1 << 32):
        raise ValueError("ids must be from 0 to 2 ** 32 - 1")
    if not len(ids):
        return MAGIC + struct.pack("<IQI", block, 0, 0)
    tables, symbol, place = _Tables.count(ids.astype(np.int64), block)
    head = tables.pack()
    out = [MAGIC, struct.pack("<IQI", block, len(ids), len(head)), head]
    width = block * _at_once(-(-len(ids) // block), lanes)
    for at in range(0, len(ids), width):
        raw = ids[at : at + width].astype("<u4")
        rows = -(-len(raw) // block)
        count = np.minimum(len(raw) - np.arange(rows) * block, block)
        steps = []
        for values, kind in ((symbol, np.uint16), (place, np.uint8)):
            if values is None:
                steps.append(None)
                continue
            padded = np.zeros((rows, block), kind)
            padded.ravel()[: len(raw)] = values[at : at + len(raw)]
            steps.append(np.ascontiguousarray(padded.T[: count[0]]))
        for k, payload in enumerate(_encode_lanes(*steps, count, tables)):
            own = raw[k * block : k * block + count[k]]
            out += [struct.pack("<III", len(own), zlib.crc32(own.tobytes()), len(payload)), payload]
    return b"".join(out)


def decode(file: bytes, lanes: int = LANES) -> np.ndarray:
    """The ids of a file; ValueError if a block's checksum is wrong or the file is cut short."""
    if file[:4] != MAGIC or len(file) < 20:
        raise ValueError("not a token file")
    _, total, size = struct.unpack_from("<IQI", file, 4)
    at, heads = 20 + size, []
    while at < len(file):
        if at + 12 > len(file):
            raise ValueError("a token file is cut short")
        n, crc, length = struct.unpack_from("<III", file, at)
        heads.append((n, crc, at + 12, length))
        at += 12 + length
    if at > len(file) or sum(h[0] for h in heads) != total:
        raise ValueError("a token file is cut short")
    if not total:
        return np.zeros(0, np.uint32)
    try:
        tables = _Tables.unpack(file[20 : 20 + size])
    except (zlib.error, struct.error) as e:
        raise ValueError("the header of a token file is damaged") from e
    out = np.zeros(total, np.uint32)
    done = 0
    lanes = _at_once(len(heads), lanes)
    for first in range(0, len(heads), lanes):
        part = heads[first : first + lanes]
        count = np.array([h[0] for h in part])
        words = np.zeros((len(part), max(h[3] for h in part) // 4 + 8), np.uint32)
        for k, (_, _, start, length) in enumerate(part):
            words[k, : length // 4] = np.frombuffer(file, "<u4", length // 4, start)
        order = np.argsort(-count, kind="stable")
        try:
            ids = _decode_lanes(words[order], count[order], tables)
        except IndexError as e:
            raise ValueError("a block of a token file has a wrong checksum") from e
        back = np.argsort(order)
        for k, (n, crc, _, _) in enumerate(part):
            block = ids[back[k], :n].astype("<u4")
            if zlib.crc32(block.tobytes()) != crc:
                raise ValueError("a block of a token file has a wrong checksum")
            out[done : done + n] = block
            done += n
    return out
