"""Byte strings cut out of one array: their names, and tables that hold each distinct one once.

A name is 64 bits of a chained mix of eight bytes at a time; strings of more than LONG bytes are named by a
cryptographic hash. Where two strings must not be taken for each other, `same` compares their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

LONG = 64
#: Bytes after the last string of an array, so that eight can be read from every place.
SPARE = 8
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def bytes_of(data: np.ndarray, begin: int, size: int) -> bytes:
    return data[begin : begin + size].tobytes()


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of an array as a number."""
    return np.ndarray((len(data) - SPARE + 1,), np.uint64, buffer=data, strides=(1,))


def names(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Name of each string data[begin : begin + size]; data ends with SPARE further bytes."""
    word = eights(data)
    h = mix(size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) ^ word[begin] & KEEP[np.minimum(size, 8)])
    rows, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rows):
        left = size[rows] - at
        h[rows] = mix(h[rows] ^ word[begin[rows] + at] & KEEP[np.minimum(left, 8)])
        at, rows = at + 8, rows[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(bytes_of(data, begin[i], size[i]), digest_size=8).digest(), "little")
    return h


def same(data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether each string data[begin : begin + size] equals other[start : start + width]."""
    out = size == width
    if data is other:
        rows = np.flatnonzero(out & (begin != start))
    else:
        rows = np.flatnonzero(out)
    for i in rows[size[rows] > LONG].tolist():
        out[i] = bytes_of(data, begin[i], size[i]) == bytes_of(other, start[i], width[i])
    rows, at = rows[size[rows] <= LONG], 0
    a, b = eights(data), eights(other)
    while len(rows):
        left = size[rows] - at
        equal = ((a[begin[rows] + at] ^ b[start[rows] + at]) & KEEP[np.minimum(left, 8)]) == 0
        out[rows[~equal]] = False
        at, rows = at + 8, rows[equal & (left > 8)]
    return out


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of each string, name and first place of each code, and the strings that differ from the first of their code."""
    code, uniq = pd.factorize(names(data, begin, size))
    first = np.empty(len(uniq), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    like = first[code]
    return code, uniq, first, np.flatnonzero(~same(data, begin, size, data, begin[like], size[like]))


class Column:
    """An array that grows."""

    def __init__(self, dtype: type, spare: int = 0) -> None:
        self.data, self.n, self.spare = np.zeros(1024, dtype), 0, spare

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values) + self.spare
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Table:
    """Distinct byte strings of at most LONG bytes in rows from 0 on. The index is a large sorted array and a small one that joins it in time."""

    def __init__(self) -> None:
        self.text, self.at, self.size = Column(np.uint8, SPARE), Column(np.int32), Column(np.uint8)
        self.index = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2

    def __len__(self) -> int:
        return self.at.n

    def find(self, name: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Row of each string; -1 if its name is unknown, -2 if the name belongs to another string."""
        row = np.full(len(name), -1, np.int64)
        for keys, rows in self.index:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
                hit = keys[at] == name
                row[hit] = rows[at[hit]]
        hit = np.flatnonzero(row >= 0)
        start, width = self.at.data[row[hit]].astype(np.int64), self.size.data[row[hit]].astype(np.int64)
        row[hit[~same(data, begin[hit], size[hit], self.text.data, start, width)]] = -2
        return row

    def add(self, name: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Adds strings whose names are unknown and distinct; returns their rows."""
        rows = np.arange(len(self), len(self) + len(name), dtype=np.int32)
        self.at.add(self.text.n + np.cumsum(size) - size)
        self.size.add(size)
        self.text.add(gather(data, begin, size))
        large, small = self.index
        small = self._merged(small, (name, rows))
        if len(small[0]) > max(4096, len(large[0]) // 4):
            large, small = self._merged(large, small), (small[0][:0], small[1][:0])
        self.index = [large, small]
        return rows

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], rows[order]


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts, each followed by one zero byte, as an array with SPARE further bytes, and the place after each part."""
    data = np.frombuffer(b"\0".join([*parts, bytes(SPARE)]), np.uint8)
    return data, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1


class CharClasses:
    """Class of each character of UTF-8 text, asked once a character; `ask` is defined by subclasses."""

    UNKNOWN = 255

    def __init__(self, end: int) -> None:
        self.end = end
        self.table = np.full(0x110000, self.UNKNOWN, np.uint8)
        for c in range(128):
            self.table[c] = self.ask(chr(c))
        self.ascii = self.table[:256].copy()

    def ask(self, c: str) -> int:
        raise NotImplementedError

    def of(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class of each byte: that of its character, and `end` at the places `ends`."""
        kind = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int32)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0x3F >> more)
            for k in (1, 2, 3):
                rows = more >= k
                code[rows] = code[rows] << 6 | data[lead[rows] + k] & 0x3F
            got = self.table[code]
            if (got == self.UNKNOWN).any():
                for c in np.unique(code[got == self.UNKNOWN]).tolist():
                    self.table[c] = self.ask(chr(c))
                got = self.table[code]
            kind[lead] = got
            for k in (1, 2, 3):
                rows = more >= k
                kind[lead[rows] + k] = got[rows]
        kind[ends] = self.end
        return kind
