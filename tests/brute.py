"""Plain loops that state the statistics once more, for small rasters only."""

import math
from collections import Counter

import numpy as np


def stats(a: np.ndarray, prefixes: int = 20) -> dict:
    h, w = a.shape
    flat = [int(v) for v in a.ravel()]
    n, out = len(flat), Counter()
    for i, v in enumerate(flat):
        k = next(k for k in range(1, prefixes + 1) if i < max(64, n * k // prefixes))
        out["hist", k, v] += 1
    for y in range(h):
        for x in range(w):
            if x + 1 < w:
                out["diff", 0, abs(int(a[y, x + 1]) - int(a[y, x]))] += 1
            if y + 1 < h:
                out["diff", 0, abs(int(a[y + 1, x]) - int(a[y, x]))] += 1

    def rough(g):
        return sum(abs(p - q) for p, q in zip(g, g[1:]))

    for g in range(n // 4):
        q = flat[4 * g:4 * g + 4]
        out["rs", 0, 4] += 1
        for base, mask in ((0, (0, 1, 1, 0)), (2, (1, 0, 0, 1))):
            f = rough([v ^ m for v, m in zip(q, mask)])
            if f > rough(q):
                out["rs", 0, base] += 1
            elif f < rough(q):
                out["rs", 0, base + 1] += 1
    return dict(out)


def residuals(a: np.ndarray, taps: list[dict], divisors: list[int], bound: int = 4) -> list[tuple]:
    h, w = a.shape
    out = []
    for kernel, d in zip(taps, divisors):
        r = [max(-bound * d, min(bound * d, sum(
            wt * int(a[y + dy, x + dx]) for (dy, dx), wt in kernel.items() if 0 <= y + dy < h and 0 <= x + dx < w)))
            for y in range(h) for x in range(w)]
        out.append((sum(r), sum(map(abs, r)), sum(v * v for v in r)))
    return out


def auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return won / (len(pos) * len(neg)) if pos and neg else None


def chi_tail(x: float, df: int) -> float:
    """Upper tail by Simpson integration of the density of the square root."""
    top, n = math.sqrt(x) + 60.0, 200_000
    t = np.linspace(math.sqrt(x), top, n + 1)
    log_f = (df - 1) * np.log(np.maximum(t, 1e-300)) - t * t / 2 - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2)
    f = np.exp(log_f)
    return float((top - math.sqrt(x)) / n / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))
