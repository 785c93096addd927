"""Elias-Fano sequences over memory-mapped bytes, with whole-array access and successor search.

A monotone sequence of n values below u keeps, of each value, ``l = log2(u / n)`` low bits
packed side by side, and the high part in unary in a bit vector.  Ones and zeros counted
before every 512 bits make select a short search.  Layout: a header of six 64-bit integers,
the two directories, the bit vector, the low bits.
"""

from __future__ import annotations

import numpy as np

HEADER, PER = 6, 8  # words in the header; words in a counted block


def _in_byte() -> np.ndarray:
    """[byte, r] -> place of the r-th set bit."""
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        for r, k in enumerate(k for k in range(8) if b >> k & 1):
            out[b, r] = k
    return out


IN_BYTE = _in_byte()


def encode(values: np.ndarray) -> bytes:
    """The bytes of a monotone sequence of unsigned 64-bit integers."""
    x = np.asarray(values, np.uint64)
    n = len(x)
    top = int(x[-1]) if n else 0
    l = max(0, min(56, ((top + 1) // max(1, n)).bit_length() - 1))
    high = (x >> np.uint64(l)).astype(np.int64)
    size = n + (top >> l) + 2
    words = -(-size // (64 * PER)) * PER
    bits = np.zeros(words * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    vector = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.bitwise_count(vector).reshape(-1, PER).sum(1).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(ones)])[:-1]
    low = b""
    if l:
        parts = []
        shift = np.arange(l, dtype=np.uint64)
        for at in range(0, n, 1 << 16):  # whole bytes: 65536 * l bits
            parts.append(np.packbits(((x[at : at + (1 << 16), None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        low = b"".join(parts)
    zeros = np.arange(len(before), dtype=np.int64) * 64 * PER - before
    return b"".join([np.array([n, l, words, len(before), len(low), 0], "<i8").tobytes(), before.astype("<i8").tobytes(), zeros.astype("<i8").tobytes(), vector.tobytes(), low, bytes(8)])


class EliasFano:
    """Reads an encoded sequence from a byte array (memory-mapped or not)."""

    def __init__(self, data: np.ndarray):
        data = np.asarray(data).view(np.uint8)
        self.n, self.l, words, blocks, low, _ = (int(v) for v in data[: HEADER * 8].view("<i8"))
        at = HEADER * 8
        self.ones = data[at : at + 8 * blocks].view("<i8")
        at += 8 * blocks
        self.zeros = data[at : at + 8 * blocks].view("<i8")
        at += 8 * blocks
        self.vector = data[at : at + 8 * words].view("<u8")
        at += 8 * words
        rest = data[at:]
        self.low = np.ndarray((low + 1,), "<u8", rest, strides=(1,)) if self.l else None
        self.bytes = at + low + 8

    def _select(self, r: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the r-th ones (or zeros) of the bit vector."""
        block = np.searchsorted(directory, r, "right") - 1
        left = r - directory[block]
        words = self.vector[block[:, None] * PER + np.arange(PER)]
        if flip:
            words = ~words
        sums = np.bitwise_count(words).astype(np.int64).cumsum(1)
        k = (sums <= left[:, None]).sum(1)
        rows = np.arange(len(r))
        left = left - np.where(k > 0, sums[rows, np.maximum(k - 1, 0)], 0)
        bytes_ = np.ascontiguousarray(words[rows, k]).view(np.uint8).reshape(-1, 8)
        sums = np.bitwise_count(bytes_).astype(np.int64).cumsum(1)
        b = (sums <= left[:, None]).sum(1)
        left = left - np.where(b > 0, sums[rows, np.maximum(b - 1, 0)], 0)
        return (block * PER + k) * 64 + b * 8 + IN_BYTE[bytes_[rows, b], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._lows(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part under h."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        if len(some):
            j = h[some] - 1
            out[some] = self._select(j, self.zeros, True) - j
        return out

    def successor(self, q: np.ndarray) -> np.ndarray:
        """Index of the first value not under each query (n if there is none)."""
        q = np.asarray(q, np.uint64)
        if not len(q) or not self.n:
            return np.zeros(len(q), np.int64)
        h = (q >> np.uint64(self.l)).astype(np.int64)
        most = int(self.access(np.array([self.n - 1]))[0]) >> self.l
        past = h > most
        h = np.minimum(h, most)
        lo, hi = self._below(h), self._below(h + 1)
        want = q & np.uint64((1 << self.l) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return np.where(past, self.n, lo)

    def decode(self) -> np.ndarray:
        """All values, in one sweep."""
        bits = np.flatnonzero(np.unpackbits(self.vector.view(np.uint8), bitorder="little"))
        return ((bits - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)) | self._lows(np.arange(self.n))
