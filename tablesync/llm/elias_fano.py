"""Elias-Fano coded monotone sequences over memory-mapped arrays, queried many values at a time."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
# place of the j-th set bit of a byte
PLACE = np.array([([k for k in range(8) if i >> k & 1] + [8] * 8)[:8] for i in range(256)], np.uint8)

EACH = 0x0101010101010101  # one in each byte of a word


class EliasFano:
    """n sorted values below ``universe``: low parts in whole bytes, high parts in unary.

    The low part has the least number of bits that leaves no more high parts than values, so few
    values share a high part. A directory counts the set bits before every 64 bits.
    """

    def __init__(self, n: int, shift: int, low: np.ndarray, bits: np.ndarray, before: np.ndarray):
        self.n, self.shift, self.low, self.bits, self.before = n, shift, low, bits, before
        self.words = bits.view("<u8")[:, 0]

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        shift = 0
        while n and shift < 63 and (universe >> shift) > n:
            shift += 1
        values = values.astype("<u8")
        low = np.ascontiguousarray((values & np.uint64((1 << shift) - 1)).view(np.uint8).reshape(n, 8)[:, : -(-shift // 8)])
        high = (values >> np.uint64(shift)).astype(np.int64)
        size = n + (universe >> shift) + 2
        size += -size % 64
        flags = np.zeros(size, np.uint8)
        flags[high + np.arange(n)] = 1
        bits = np.packbits(flags, bitorder="little")
        words = ONES[bits].reshape(-1, 8).sum(axis=1)
        return {"low": low, "bits": bits, "before": (np.cumsum(words) - words).astype(np.uint32), "shape": np.array([n, shift], np.int64)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, shift = arrays[f"{name}.shape"].tolist()
        return cls(n, shift, arrays[f"{name}.low"], arrays[f"{name}.bits"].reshape(-1, 8), arrays[f"{name}.before"])

    def _select(self, block: np.ndarray, rest: np.ndarray, flip: int) -> np.ndarray:
        """Place of the set (flip 255: unset) bit number ``rest`` of each block."""
        u = np.uint64
        word = self.words[block] ^ u(flip * EACH)
        ones = word - ((word >> u(1)) & u(0x55 * EACH))
        ones = (ones & u(0x33 * EACH)) + ((ones >> u(2)) & u(0x33 * EACH))
        ones = ((ones + (ones >> u(4))) & u(0x0F * EACH)) * u(EACH)  # byte k: bits up to byte k, at most 64
        rest = rest.astype(np.uint64)
        full = ((rest * u(EACH)) | u(0x80 * EACH)) - ones & u(0x80 * EACH)  # a flag for each byte that lies before
        which = np.bitwise_count(full).astype(np.uint64) * u(8)
        rest = rest - (((ones << u(8)) >> which) & u(255))
        byte = (word >> which) & u(255)
        return 64 * block + which.astype(np.int64) + PLACE[byte.astype(np.int64), rest.astype(np.int64)]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        block = np.searchsorted(self.before, i, side="right") - 1
        high = self._select(block, i - self.before[block].astype(np.int64), 0) - i
        return (high.astype(np.uint64) << np.uint64(self.shift)) | self.low_of(i)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        out, width = np.zeros((len(i), 8), np.uint8), self.low.shape[1]
        if width:
            out[:, :width] = np.take(self.low, i, axis=0)
        return out.view("<u8")[:, 0]

    def all(self) -> np.ndarray:
        """The values at all positions."""
        high = np.flatnonzero(np.unpackbits(self.bits.ravel(), bitorder="little")) - np.arange(self.n)
        return (high.astype(np.uint64) << np.uint64(self.shift)) | self.low_of(np.arange(self.n))

    def run(self, high: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many values have each high part; ``begin`` values lie below it."""
        u, at = np.uint64, high + begin  # the first bit behind the zero that ends the part before
        word, inside = self.words[at >> 6], (at & 63).astype(np.uint64)
        zeros = ~word >> inside
        ones = np.bitwise_count(~zeros & (zeros - u(1))).astype(np.int64)  # below the first zero; 64 without one
        over = np.flatnonzero(zeros == 0)
        ones[over] = self.below(high[over] + 1) - begin[over]
        return ones

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``high``."""
        if not hasattr(self, "_zeros"):
            self._zeros = 64 * np.arange(len(self.before), dtype=np.int64) - self.before
        out = np.zeros(len(high), np.int64)
        some = high > 0
        rank = high[some] - 1
        block = np.searchsorted(self._zeros, rank, side="right") - 1
        out[some] = self._select(block, rank - self._zeros[block], 255) - rank
        return out

    def find(self, values: np.ndarray, start: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Position of each value within [start, end), or -1; of a value that repeats, any of its positions."""
        if not self.n or not len(values):
            return np.full(len(values), -1)
        # what lies above the universe is looked for in the last high part, which no value has
        high = np.minimum((values >> np.uint64(self.shift)).astype(np.int64), 64 * len(self.words) - self.n - 1)
        begin = self.below(high)
        lo = np.maximum(begin, start)
        hi = np.minimum(begin + self.run(high, begin), self.n if end is None else end)
        out = np.full(len(values), -1)
        at = np.flatnonzero(lo < hi)
        lo, hi, want = lo[at], hi[at], (values & np.uint64((1 << self.shift) - 1))[at]
        while len(at):
            mid = (lo + hi) >> 1
            low = self.low_of(mid)
            same = low == want
            out[at[same]] = mid[same]
            less = low < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            left = np.flatnonzero((lo < hi) & ~same)
            at, lo, hi, want = at[left], lo[left], hi[left], want[left]
        return out


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, visible at once: a task that runs twice replaces it with the same content."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    index, offset = {}, 0
    for name, a in arrays.items():
        index[name] = (a.dtype.str, a.shape, offset)
        offset += a.nbytes + -a.nbytes % 8
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 8)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(temporary, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(data[:8].tobytes(), "little")
    index = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, (dtype, shape, offset) in index.items():
        count = int(np.prod(shape)) * np.dtype(dtype).itemsize
        begin = 8 + size + offset
        out[name] = data[begin : begin + count].view(dtype).reshape(shape)
    return out
