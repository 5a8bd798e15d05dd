"""Elias-Fano sequences on memory-mapped arrays, with vectorised access and search."""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(256, dtype=np.uint8)
_POP = np.unpackbits(_BYTES[:, None], axis=1).sum(1).astype(np.uint8)
#: _SELECT[b, r]: place of the r-th set bit of byte b, lowest first.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_at)] = _at


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, side by side, in 64-bit words; one word more, so that reads may run over."""
    if not width:
        return np.zeros(2, np.uint64)
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if len(values) * width <= 1 << 21 else None
    if bits is None:  # in slices whose bits fill whole words
        step = 1 << 15
        parts = [_pack(values[k : k + step], width)[:-1] for k in range(0, len(values), step)]
        parts = [p[: step * width // 64] for p in parts[:-1]] + parts[-1:]
        return np.concatenate([*parts, np.zeros(1, np.uint64)])
    flat = np.packbits(bits.ravel(), bitorder="little")
    return np.frombuffer(flat.tobytes() + bytes(-len(flat) % 8 + 8), np.uint64)


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the sequence of ascending unsigned 64-bit values."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = (int(high[-1]) if n else 0) // 64 + 2
    bits = np.zeros(words * 8, np.uint8)
    np.bitwise_or.at(bits, high >> 3, (1 << (high & 7)).astype(np.uint8))
    ones = np.r_[0, np.cumsum(_POP[bits].reshape(-1, 8).sum(1, dtype=np.int64))]
    return {"meta": np.array([n, low], np.int64), "high": bits, "ones": ones.astype(np.uint32 if n < 1 << 32 else np.int64), "low": _pack(values & np.uint64((1 << low) - 1), low)}


class EliasFano:
    """access(i): values at places; find(x): places of values, -1 where they are missing."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low = map(int, arrays["meta"])
        self.high, self.ones, self.bits = np.asarray(arrays["high"]).reshape(-1, 8), arrays["ones"].astype(np.int64), arrays["low"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def _inside(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit in rows of eight bytes."""
        sums = np.cumsum(_POP[rows], axis=1, dtype=np.int64)
        byte = (sums <= r[:, None]).sum(1)
        at = np.arange(len(rows))
        before = np.where(byte > 0, sums[at, byte - 1], 0)
        return byte * 8 + _SELECT[rows[at, byte], r - before]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        left = self.bits[word] >> shift
        right = np.where(shift > 0, self.bits[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (left | right) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        w = np.searchsorted(self.ones, i, "right") - 1
        high = w * 64 + self._inside(self.high[w], i - self.ones[w]) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values come before the k-th zero (from 0): those with a high part up to k."""
        w = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        return w * 64 + self._inside(self.high[w] ^ np.uint8(255), k - self.zeros[w]) - k

    def find(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        h = (x >> np.uint64(self.low)).astype(np.int64)
        last = int(self.zeros[-1])
        todo = np.flatnonzero(h < last)
        h = h[todo]
        start = np.where(h > 0, self._after_zero(np.maximum(h - 1, 0)), 0)
        stop = self._after_zero(h)
        end = stop.copy()
        want = x[todo] & np.uint64((1 << self.low) - 1)
        # values of one high part ascend by their low part: halved, as a node with many successors has thousands of them
        while len(live := np.flatnonzero(start < end)):
            middle = (start[live] + end[live]) >> 1
            below = self._lows(middle) < want[live]
            start[live[below]] = middle[below] + 1
            end[live[~below]] = middle[~below]
        found = np.flatnonzero(start < stop)
        found = found[self._lows(start[found]) == want[found]]
        out[todo[found]] = start[found]
        return out
