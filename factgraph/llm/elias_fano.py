"""Elias-Fano sequences in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

CHUNK = 1 << 16  # look-ups at once
ALL_1, ALL_8, LOW_4, LOW_2, ODD_1 = (np.uint64(x) for x in (0x0101010101010101, 0x8080808080808080, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555))
#: Place of the k-th set bit of each byte.
IN_BYTE = np.zeros((256, 8), np.uint64)
for _b in range(256):
    _on = [i for i in range(8) if _b >> i & 1]
    IN_BYTE[_b, : len(_on)] = _on
IN_BYTE = IN_BYTE.ravel()


def u64(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: sums of bytes side by side find the byte, a table the bit."""
    s = word - (word >> np.uint64(1) & ODD_1)
    s = (s & LOW_2) + (s >> np.uint64(2) & LOW_2)
    s = (s + (s >> np.uint64(4)) & LOW_4) * ALL_1
    byte = np.bitwise_count((k * ALL_1 | ALL_8) - s & ALL_8).astype(np.uint64) * np.uint64(8)
    left = k - ((s << np.uint64(8)) >> byte & np.uint64(255))
    return byte + IN_BYTE[((word >> byte & np.uint64(255)) << np.uint64(3) | left).view(np.int64)]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with the ones and zeros before each 64-bit word of these."""

    def __init__(self, path: str):
        data = np.load(f"{path}.npy", mmap_mode="r").view(np.ndarray)
        self.n, self.low_bits, n_low, n_high = (int(x) for x in data[:4])
        self.low, self.high, self.ones, self.zeros = np.split(data[4:], np.cumsum([n_low, n_high, n_high]))
        self.l, self.mask = np.uint64(self.low_bits), np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def write(path: str, values: np.ndarray) -> None:
        values, n = u64(values), len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = ((values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).view(np.int64)
        bits = np.zeros(((int(places[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            part, at = values & np.uint64((1 << low_bits) - 1), np.arange(n) * low_bits
            word, shift = at >> 6, u64(at & 63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = shift + np.uint64(low_bits) > 64
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        ones = np.cumsum(np.bitwise_count(high), dtype=np.uint64)
        ones = np.r_[np.uint64(0), ones[:-1]]
        zeros = np.arange(len(high), dtype=np.uint64) * np.uint64(64) - ones
        np.save(f"{path}.npy", np.concatenate([u64([n, low_bits, len(low), len(high)]), low, high, ones, zeros]))

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.uint64)
        word = np.searchsorted(self.ones, i, "right") - 1
        high = (select(self.high[word], i - self.ones[word]) + u64(word) * np.uint64(64) - i) << self.l
        if not self.low_bits:
            return high
        at = i * self.l
        w, s = (at >> np.uint64(6)).view(np.int64), at & np.uint64(63)
        return high | (self.low[w] >> s | self.low[w + 1] << np.uint64(1) << (np.uint64(63) - s)) & self.mask

    def ends(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values up to the end of each bucket, that is, of equal high bits."""
        word = np.searchsorted(self.zeros, bucket, "right") - 1
        nth = bucket - self.zeros[word]
        inside = np.bitwise_count(~self.high[word]) > nth  # else it is beyond the last one
        return np.where(inside, select(~self.high[word], np.minimum(nth, np.uint64(63))) + u64(word) * np.uint64(64) - bucket, self.n).astype(np.int64)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of each x in [lo, hi), or -1. A wide range is first narrowed to the bucket of x; then all binary searches step together."""
        out = np.full(len(x), -1, np.int64)
        for s in range(0, len(x), CHUNK):
            out[s : s + CHUNK] = self._find(u64(x[s : s + CHUNK]), lo[s : s + CHUNK].astype(np.int64), hi[s : s + CHUNK].astype(np.int64))
        return out

    def _find(self, x, lo, hi):
        out, wide = np.full(len(x), -1, np.int64), np.flatnonzero(hi - lo > 4)
        if len(wide):
            bucket = x[wide] >> self.l
            first = np.where(bucket > 0, self.ends(np.maximum(bucket, np.uint64(1)) - np.uint64(1)), 0)
            lo[wide], hi[wide] = np.maximum(lo[wide], first), np.minimum(hi[wide], self.ends(bucket))
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            value, sought = self.get(mid), x[live]
            same, less = value == sought, value < sought
            out[live[same]] = mid[same]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[~same & (lo[live] < hi[live])]
        return out


def exists(path: str) -> bool:
    return os.path.exists(f"{path}.npy")
