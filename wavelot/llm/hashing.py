"""64-bit hashing in numpy."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE, _HELD = 0xD1342543DE82EF95, 1 << 20
_known: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse; a worker keeps up to 2^20 of them."""
    if len(_known[0]) >= n:
        return _known[0][:n], _known[1][:n]
    size = max(n, min(_HELD, 2 * n))
    made = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, x, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= _HELD:
        _known[:] = made
    return made[0][:n], made[1][:n]
