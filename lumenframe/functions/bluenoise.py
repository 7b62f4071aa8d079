"""A blue-noise tile by void and cluster, made by rule and not stored."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _energy(n: int, sigma: float) -> np.ndarray:
    """Gaussian on a torus, centred on the origin."""
    d = np.minimum(np.arange(n), n - np.arange(n)) ** 2
    return np.exp(-(d[:, None] + d[None, :]) / (2 * sigma * sigma))


@lru_cache(maxsize=8)
def tile(n: int = 32, seed: int = 0, sigma: float = 1.5) -> np.ndarray:
    """n x n ranks scaled to [0, 1): each prefix of the ranks is evenly spread."""
    rng = np.random.default_rng(seed)
    kernel = _energy(n, sigma)
    at = lambda p: np.roll(kernel, divmod(int(p), n), (0, 1))
    field, on = np.zeros((n, n)), np.zeros(n * n, bool)
    for p in rng.permutation(n * n)[: n * n // 10]:
        on[p] = True
        field += at(p)
    while True:  # the tightest cluster moves to the largest void until it is the same place
        cluster = np.where(on, field.ravel(), -np.inf).argmax()
        on[cluster] = False
        field -= at(cluster)
        void = np.where(on, np.inf, field.ravel()).argmin()
        on[void] = True
        field += at(void)
        if void == cluster:
            break
    rank = np.zeros(n * n, int)
    first, rest = on.copy(), field.copy()
    for r in range(int(on.sum()) - 1, -1, -1):
        p = np.where(first, rest.ravel(), -np.inf).argmax()
        first[p], rank[p] = False, r
        rest -= at(p)
    for r in range(int(on.sum()), n * n):
        p = np.where(on, np.inf, field.ravel()).argmin()
        on[p], rank[p] = True, r
        field += at(p)
    return (rank.reshape(n, n) + 0.5) / (n * n)
