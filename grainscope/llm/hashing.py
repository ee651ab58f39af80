"""Rolling polynomial hashes modulo 2 ** 64 over byte buffers."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER_CODES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any stretch of a buffer from prefix sums."""

    def __init__(self, base: int = int(BASE)):
        self.base = base
        self.up, self.down = powers(1 << 16, base)

    def load(self, raw: np.ndarray) -> None:
        if len(self.up) < len(raw) + 1:
            self.up, self.down = powers(2 * len(raw) + 1, self.base)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_CODES[raw] * self.up[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of raw[start:end]."""
        return (self.sums[end] - self.sums[start]) * self.down[start]
