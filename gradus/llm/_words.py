"""Vectorised cutting and hashing of UTF-8 text held in Arrow buffers.

A piece starts at a space or newline that stands before a byte which can only
begin a character that is no white space, after such a newline, and between a
Latin letter and a mark of punctuation. No tokenizer used here lets a token
cross such a place, so a text's ids are its pieces' ids in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SAFE = np.zeros(256, bool)
SAFE[0x21:0x7F] = True
SAFE[0xC3:0xE0] = True
SAFE[0xE4:0xF5] = True
CUT = np.zeros(256, bool)
CUT[[0x20, 0x0A]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes of U+00C0 to U+00FF that are letters.
ACCENTED = np.zeros(256, bool)
ACCENTED[0x80:0xC0] = True
ACCENTED[[0x97, 0xB7]] = False
MARK = np.zeros(256, bool)
MARK[list(b"!\"#$%&()*,-./:;?@[]_{}~")] = True
#: White space of str.split() below U+0080.
BLANK = np.zeros(256, bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True

BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 21
_UNIT = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64's steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = _powers(n, self.base), _powers(n, self.inverse)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = POWERS.of(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _UNIT) * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes give equal hashes wherever they stand."""
    _, down = POWERS.of(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def strings(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(column) else buf[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, and the first piece of each text (n + 1 values)."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        follows = SAFE[buf[1:]]
        cut[: len(buf) - 1] = CUT[buf[:-1]] & follows
        cut[1 : len(buf)] |= (buf[:-1] == 0x0A) & follows
        ends = LETTER[buf]
        ends[1:] |= (buf[:-1] == 0xC3) & ACCENTED[buf[1:]]
        cut[1 : len(buf)] |= ends[:-1] & MARK[buf[1:]]
    cut[offsets[1:] - 1] = False  # what follows a text's last byte is another text
    cut[offsets] = True
    cut[len(buf)] = False
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(buf))
    return start, end, np.searchsorted(start, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run without ASCII white space, and the first word of each text."""
    blank = BLANK[buf]
    solid = ~blank
    begin = solid.copy()
    begin[1:] &= blank[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    begin[inner] |= solid[inner]
    stop = np.zeros(len(buf) + 1, bool)
    stop[1:] = solid
    stop[: len(buf)] &= blank
    stop[inner] |= solid[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return start, end, np.searchsorted(start, offsets)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each.

    A text of fewer words has one shingle of them all; a text without words has none.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n_words)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    length = np.minimum(n_words, width)[doc]
    out = length.astype(np.uint64)
    for j in range(width):
        here = j < length
        step = out * np.uint64(BASE) + word_hash[np.minimum(at + j, len(word_hash) - 1)] if len(word_hash) else out
        out = np.where(here, step, out)
        out = np.where(here, out ^ (out >> np.uint64(29)), out)
    return mix(out), doc


class HashIndex:
    """Open-addressing table from 64-bit hashes to 0, 1, 2, … in order of insertion."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, slot, last = np.arange(len(h)), self._slot(h), (1 << self.bits) - 1
        while len(todo):
            value = self.value[slot]
            hit = (self.key[slot] == h[todo]) & (value >= 0)
            out[todo[hit]] = value[hit]
            go = ~hit & (value >= 0)
            todo, slot = todo[go], (slot[go] + 1) & last
        return out

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Add hashes that are distinct and not yet there; returns their numbers."""
        if (self.n + len(h)) * 2 > len(self.key):
            old_key, old_value = self.key[self.value >= 0], self.value[self.value >= 0]
            bits = max(self.bits + 1, int(np.ceil(np.log2((self.n + len(h)) * 3 + 1))))
            self.clear(bits)
            self._put(old_key, old_value)
            self.n = len(old_key)
        value = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(h, value)
        self.n += len(h)
        return value

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        slot, last = self._slot(h), (1 << self.bits) - 1
        while len(h):
            free = np.flatnonzero(self.value[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.key[slot[placed]], self.value[slot[placed]] = h[placed], value[placed]
            rest = np.ones(len(h), bool)
            rest[placed] = False
            h, value, slot = h[rest], value[rest], (slot[rest] + 1) & last


class Ragged:
    """Lists of numbers one after another, addressed by number."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.start, self.length, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def extend(self, lists: list) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lists) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        self.flat[self.used : self.used + total] = np.fromiter((x for y in lists for x in y), self.flat.dtype, total)
        self.start[self.n : self.n + len(lists)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lists)] = lengths
        self.used += total
        self.n += len(lists)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists one after another, and the n + 1 places where they begin."""
        length = self.length[which]
        begin = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=begin[1:])
        return self.flat[np.repeat(self.start[which] - begin[:-1], length) + np.arange(begin[-1])], begin
