"""Pieces of text for the tokenising operators: where they lie in a block of bytes, and a
bounded memory of the identifiers that each distinct piece has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Kinds of bytes.
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)
_KIND = np.full(256, FOREIGN, np.uint8)
_KIND[:128] = OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Distinct pieces that a memory holds, and bytes of text that are looked up at once.
MEMO, BLOCK = 1 << 20, 1 << 20

#: (identifiers one after another, how many each piece has) of pieces and their marks.
Learn = Callable[[list[bytes], list[bool]], tuple[np.ndarray, np.ndarray]]


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; Latin-1 letters are letters, dashes, quotes and dots from U+2010 to
    U+2027 are other marks, and what else isn't ASCII is foreign."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
    lead = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else lead[:0]
    if len(lead):
        lead = lead[(data[lead + 1] == 0x80) & (data[lead + 2] >= 0x90) & (data[lead + 2] <= 0xA7)]
        kind[lead] = kind[lead + 1] = kind[lead + 2] = OTHER
    return kind


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) of all i, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not total or starts.max() < 1 << 31) else np.int64
    out = np.repeat((starts - ends + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Arena:
    """Byte strings or identifiers, one after another; ``gather`` joins those of many numbers."""

    def __init__(self, parts: list[bytes], kind: str = "u1"):
        item = np.dtype(kind).itemsize
        self.sizes = np.array([len(x) // item for x in parts], np.int32)
        self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int64)
        self.data = np.frombuffer(b"".join(parts), kind)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[numbers], self.sizes[numbers])]


def columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, size: int = 4 << 20) -> Iterator[pa.Array]:
    """The array in slices of about ``size`` bytes, of a text each at least."""
    _, offsets = columns(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def _edge(data: np.ndarray, offsets: np.ndarray, a: int, block: int) -> int:
    """Where a block that begins at ``a`` ends: after a text, or within one before white space
    that follows an ASCII character; pieces don't reach from there into the white space."""
    b = min(a + block, len(data))
    if b == len(data):
        return b
    text = int(np.searchsorted(offsets, b, side="right")) - 1
    if offsets[text] > a:
        return int(offsets[text])
    while b < offsets[text + 1]:
        some = data[b - 1 : min(b + block, int(offsets[text + 1]))]
        space = np.flatnonzero((_KIND[some[1:]] == SPACE) & (_KIND[some[:-1]] != SPACE) & (some[:-1] < 128))
        if len(space):
            return b + int(space[0])
        b = min(b + block, int(offsets[text + 1]))
    return b


def blocks(data: np.ndarray, offsets: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, stops): blocks of texts that lie one after another.  ``begins`` are the
    places where texts, or the rest of one, begin, and ``stops`` those where texts end."""
    a = text = 0
    while text < len(offsets) - 1:
        b = _edge(data, offsets, a, block)
        last = int(np.searchsorted(offsets, b, side="right")) - 1
        begins = np.unique(np.concatenate([[a], offsets[text : last + 1]]).clip(a, b)) - a
        yield data[a:b], begins[begins < b - a], offsets[text + 1 : last + 1] - a
        a, text = b, last


class PieceMemo:
    """Numbers of the distinct pieces that were seen, and their identifiers.  Pieces of up to 16
    bytes are found in a hash table by their bytes (two 64-bit numbers), longer ones in a
    dictionary.  Number 0 has the identifiers ``zero``.  A full memory is emptied, and grows
    where one block has more distinct pieces than it holds."""

    def __init__(self, learn: Learn, zero: list[int], size: int):
        self.learn, self.zero, self.limit, self.cleared = learn, zero, size, -1
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.table = np.full(2 * self.limit, -1, np.int32)
        self.low, self.high = np.zeros(self.limit, np.uint64), np.zeros(self.limit, np.uint64)
        self.at, self.size = np.zeros(self.limit, np.int32), np.zeros(self.limit, np.int32)
        self.ids = np.zeros(4 * self.limit, "<u4")
        self.n, self.used = 1, len(self.zero)
        self.size[0], self.ids[: self.used] = self.used, self.zero
        self.long: dict[bytes, int] = {}

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, sizes) of pieces."""
        size = self.size[numbers]
        return self.ids[ragged(self.at[numbers], size)], size

    def look_up(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The numbers of the pieces of a block of bytes (24 bytes longer than its text), which
        ``marks`` tell apart for ``learn``; equal pieces have equal marks."""
        size = ends - starts
        view = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        a = view[starts] & _KEEP[np.minimum(size, 8)]
        b = view[starts + 8 * (size > 8)] & _KEEP[np.clip(size - 8, 0, 8)]
        long = size > 16
        zero = np.flatnonzero(low[:-24] == 0)  # would tell no lengths apart
        if len(zero):
            long[np.searchsorted(starts, zero, side="right") - 1] = True
        out = self._find(a, b)
        out[long] = -1
        for i in np.flatnonzero(long).tolist():
            out[i] = self.long.get(low[starts[i] : ends[i]].tobytes(), -1)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        short = new[~long[new]]
        order = short[np.lexsort((b[short], a[short]))]
        apart = np.ones(len(order), bool)
        apart[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        some = order[apart]
        rest = new[long[new]]
        said = [low[s:e].tobytes() for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        words = dict(zip(said, marks[rest].tolist(), strict=True))
        if self.n + len(some) + len(words) > self.limit:
            if len(some) + len(words) >= self.limit:  # a very long text without white space
                self.limit = 2 * (len(some) + len(words))
            self.clear()
            return self.look_up(low, starts, ends, marks)
        if len(some):
            numbers = self._remember(*self.learn([low[s:e].tobytes() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], marks[some].tolist()))
            self.low[numbers], self.high[numbers] = a[some], b[some]
            self._place(numbers)
            out[order] = numbers[np.cumsum(apart) - 1]
        if words:
            self.long.update(zip(words, self._remember(*self.learn(list(words), list(words.values()))).tolist(), strict=True))
            out[rest] = [self.long[w] for w in said]
        return out

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + len(sizes))
        self.at[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)
        return new

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(len(self.table))).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot, out = self._slots(low, high), np.full(len(low), -1, np.int64)
        entry = self.table[slot]
        hit = (entry >= 0) & (self.low[entry] == low) & (self.high[entry] == high)
        out[hit] = entry[hit]
        rows = np.flatnonzero(~hit & (entry >= 0))
        while len(rows):
            slot[rows] = (slot[rows] + 1) % len(self.table)
            entry = self.table[slot[rows]]
            hit = (entry >= 0) & (self.low[entry] == low[rows]) & (self.high[entry] == high[rows])
            out[rows[hit]] = entry[hit]
            rows = rows[~hit & (entry >= 0)]
        return out

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slots(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.table[slot] < 0
            self.table[slot[free]] = numbers[free]
            lost = self.table[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + 1) % len(self.table)
