"""Small seeded rasters for the tests."""

import numpy as np


def photo(h=96, w=80, seed=0):
    """Smooth structure plus a little integer noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    v = 120 + 50 * np.sin(x / 17) + 40 * np.cos(y / 11) + rng.integers(-2, 3, (h, w))
    return np.clip(v, 0, 255).astype(int)


def noise(h=64, w=64, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w))


def gradient(h=256, w=256):
    y, x = np.mgrid[0:h, 0:w]
    return ((x + y) * 255 // (h + w)).astype(int)


def checkerboard(h=64, w=64):
    y, x = np.mgrid[0:h, 0:w]
    return ((x + y) % 2 * 255).astype(int)
