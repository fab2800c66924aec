"""Elias-Fano sequences in flat memory-mappable arrays, queried in vectors."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_BLOCK = 4  # words of 64 bits between two entries of the rank directory


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Place of the k-th one bit of a byte, at byte + 256 * k.
_IN_BYTE = np.array([([j for j in range(8) if byte >> j & 1] + [0] * 8)[k] for k in range(8) for byte in range(256)], np.int64)


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one bit (from 0) in each word: running counts of all bytes at once, then a table for one byte."""
    k = k.astype(np.uint64)
    c = x - ((x >> _ONE) & np.uint64(0x5555555555555555))
    c = (c & np.uint64(0x3333333333333333)) + ((c >> np.uint64(2)) & np.uint64(0x3333333333333333))
    c = ((c + (c >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    full = np.bitwise_count(((k * _BYTES | _TOPS) - c) & _TOPS).astype(np.uint64) << np.uint64(3)
    rest = k - (((c << np.uint64(8)) >> full) & np.uint64(255))
    byte = (x >> np.minimum(full, np.uint64(56))) & np.uint64(255)
    return full.astype(np.int64) + _IN_BYTE[(byte + (rest << np.uint64(8))).astype(np.int64) & 2047]


class Select:
    """Select over a bit vector: binary search in counts per block, then in the words of one block."""

    def __init__(self, words: np.ndarray, directory: np.ndarray, flip: bool):
        self.words, self.directory, self.flip = words, directory, flip

    @staticmethod
    def counts(words: np.ndarray, flip: bool) -> np.ndarray:
        ones = np.bitwise_count(~words if flip else words).astype(np.int64)
        pad = np.zeros(-len(ones) % _BLOCK, np.int64)
        per = np.concatenate([ones, pad]).reshape(-1, _BLOCK).sum(axis=1)
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])

    def __call__(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.directory, k, "right") - 1
        rest = k - self.directory[block]
        at = block * _BLOCK
        x = self.words[at]
        last = len(self.words) - 1
        for j in range(1, _BLOCK):
            ones = np.bitwise_count(~x if self.flip else x)
            on = np.flatnonzero((rest >= ones) & (at == block * _BLOCK + j - 1))
            if not len(on):
                break
            rest[on] -= ones[on]
            at[on] += 1
            x[on] = self.words[np.minimum(at[on], last)]
        return at * 64 + _select_in_word(~x if self.flip else x, rest)


class EliasFano:
    """A sorted sequence of numbers below `universe` in about 2 + log2(universe / n) bits each."""

    #: Arrays that make up a stored sequence.
    PARTS = 5

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones, self.zeros = Select(high, ones, False), Select(high, zeros, True)
        self.tops = int(zeros[-1])
        # A word from every byte on: values of up to 57 bits are read at once.
        self.bytewise = np.lib.stride_tricks.as_strided(low, (max(1, 8 * len(low) - 7),), (1,))

    # --- building and storing

    @staticmethod
    def encode(values: np.ndarray, spare: int = 0) -> list[np.ndarray]:
        """Arrays (header, low, high, ones, zeros) of a sorted uint64 array.

        spare: so many low bits fewer than take least room. Where values crowd, a search has shorter runs to go through.
        """
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1 - spare)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) + 2 if n else 1) + 63 >> 6
        words = np.zeros(size, np.uint64)
        np.bitwise_or.at(words, high >> 6, _ONE << (high & 63).astype(np.uint64))
        low = np.zeros((n * bits + 63 >> 6) + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        return [np.array([n, bits], np.int64), low, words, Select.counts(words, False), Select.counts(words, True)]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, ones, zeros = arrays
        return cls(int(head[0]), int(head[1]), low, high, ones, zeros)

    # --- queries

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        if self.low_bits <= 57:
            return (self.bytewise[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> shift
        spill = shift > 64 - self.low_bits
        x[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - shift[spill])
        return x & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        high = (self.ones(i) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def span(self, a: int, b: int) -> np.ndarray:
        """The values at the places from a to b - 1: their bits are read in a row, which takes less than `access`."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = (int(k) for k in self.ones(np.array([a, b - 1])))
        bits = np.unpackbits(self.high[first >> 6 : (last >> 6) + 1].view(np.uint8), bitorder="little")
        places = np.arange(a, b)
        high = np.flatnonzero(bits[first & 63 :])[: b - a] + first - places
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(places)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the place of the least value >= x (n: none), and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = x >> np.uint64(self.low_bits)
        past = top >= np.uint64(self.tops)
        top = np.minimum(top, np.uint64(self.tops - 1)).astype(np.int64)
        # Where the bucket begins; it is as long as the run of ones from there, mostly within one word.
        at = np.where(top > 0, self.zeros(np.maximum(top - 1, 0)) + 1, 0)
        lo = at - top
        word = self.high[np.minimum(at >> 6, len(self.high) - 1)] >> (at & 63).astype(np.uint64)
        run = np.bitwise_count((word ^ (word + _ONE)) >> _ONE).astype(np.int64)
        hi = lo + run
        far = np.flatnonzero(run + (at & 63) >= 63)
        hi[far] = self.zeros(top[far]) - top[far]
        equal = np.zeros(len(x), bool)
        live = np.flatnonzero((lo < hi) & ~past)
        want = (x[live] & np.uint64((1 << self.low_bits) - 1))
        place, left = lo[live], hi[live] - lo[live]
        rows = np.flatnonzero(left > 1)
        while len(rows):
            half = left[rows] >> 1
            mid = place[rows] + half
            place[rows] = np.where(self._low(mid - 1) < want[rows], mid, mid - half)
            left[rows] -= half
            rows = rows[left[rows] > 1]
        found = self._low(place)
        lo[live] = place + (found < want)
        equal[live] = found == want
        lo[past] = self.n
        return lo, equal


def pack(arrays: list[np.ndarray]) -> bytes:
    """Flat bytes of arrays: count, then (type, length) of each, then the arrays at multiples of 8 bytes."""
    kinds = {"<u8": 0, "<i8": 1, "|u1": 2, "<f4": 3, "<f8": 4}
    head = [len(arrays)]
    for a in arrays:
        head += [kinds[a.dtype.str], len(a)]
    out = [np.array(head, np.int64).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


def unpack(raw: np.ndarray) -> list[np.ndarray]:
    """The arrays again, as views of a mapped array of bytes."""
    kinds = [np.uint64, np.int64, np.uint8, np.float32, np.float64]
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * n].view(np.int64).tolist()
    at, out = 8 + 16 * n, []
    for kind, length in zip(head[::2], head[1::2], strict=True):
        size = length * np.dtype(kinds[kind]).itemsize
        out.append(raw[at : at + size].view(kinds[kind]))
        at += size + (-size % 8)
    return out
