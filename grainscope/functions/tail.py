"""The chi-square tail in NumPy, apart from its column forms so that tasks that need it do not load pandas."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])


def chi_square_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom.

    With h = x/2 the tail is a finite sum of positive terms h^s e^-h / Gamma(s+1),
    s = 0, 1, .. below df/2 for even df; for odd df s = 1/2, 3/2, .. plus erfc(sqrt h).
    Terms are taken through logarithms, so none over- or underflows early.
    """
    h = np.maximum(np.asarray(x, dtype=float), 0.0) / 2.0
    df = np.asarray(df, dtype=np.int64)
    odd = df % 2
    terms = df // 2
    log_h = np.log(np.maximum(h, 1e-300))
    out = np.where(odd == 1, _erfc(np.sqrt(h)), 0.0) if len(h) else h.copy()
    for t in range(int(terms.max(initial=0))):
        s = t + odd / 2.0
        log_gamma = np.where(odd == 1, math.lgamma(t + 1.5), math.lgamma(t + 1.0))
        out += np.where(t < terms, np.exp(s * log_h - h - log_gamma), 0.0)
    return np.where(df <= 0, 1.0, np.clip(out, 0.0, 1.0))


def tails_of_each(stats: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The tail of each statistic with one degree of freedom less than pairs; NaN where there are fewer than two pairs."""
    df = pairs.ravel().astype(np.int64) - 1
    tails = chi_square_tail(stats.ravel(), np.maximum(df, 1))
    return np.where(df > 0, tails, np.nan).reshape(stats.shape)
