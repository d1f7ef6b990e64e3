"""Rolling 64-bit hashes of any stretch of a byte array, by running sums."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing rounds of a 64-bit hash, so that each bit depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=8)
def _power_table(base: int, n: int) -> np.ndarray:
    table = np.full(n, np.uint64(base))
    table[0] = 1
    return np.cumprod(table)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64."""
    return _power_table(int(base), max(1 << 17, 1 << (n - 1).bit_length()))[:n]


class Rolling:
    """Hashes of stretches of ``data`` (uint8): equal bytes have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        self._sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _powers(ODD, len(data))))
        self._back = _powers(_INVERSE, len(data) + 1)

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        sums = self._sums[start + length] - self._sums[start]
        return mix(sums * self._back[start] + np.asarray(length).astype(np.uint64) * ODD)

    def grams(self, length: int) -> np.ndarray:
        """One hash for each place at which ``length`` bytes start; their high bits are the better ones."""
        sums = self._sums[length:] - self._sums[: len(self._sums) - length]
        return sums * self._back[: len(sums)] * _MIX[1]
