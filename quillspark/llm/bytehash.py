"""Vectorised rolling hashes over UTF-8 bytes, shared by the suffix operators.

A string's hash is a polynomial over the ring of 64-bit integers with a fixed odd
base.  Prefix sums make the hash of every substring two lookups and two products,
so one pass serves any number of window lengths.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that their bits are independent (a bijection)."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = 1 << max(12, int(n).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            table = np.full(size + 1, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Substring hashes of one buffer of bytes."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        up, self.down = _powers(self.size)
        self.prefix = np.zeros(self.size + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: self.size], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of this length, by start."""
        if self.size < length:
            return np.zeros(0, dtype=np.uint64)
        raw = self.prefix[length:] - self.prefix[: self.size - length + 1]
        return mix(raw * self.down[: len(raw)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the substrings [start, end), their lengths mixed in."""
        raw = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix(raw ^ mix((end - start).astype(np.uint64)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values: block-wise prefix and suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
