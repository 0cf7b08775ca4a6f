"""Vectorised rolling hashes and sliding minima over batches of texts."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    """Code points of a text as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_B, _B_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hash of any window of a code point array in constant time."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        up, self._down = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sum[1:])

    def all(self, size: int) -> np.ndarray:
        """Hashes of every window of ``size``; empty if the array is shorter."""
        n = len(self._sum) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sum[size:] - self._sum[:n]) * self._down[:n])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` that begin at ``starts``."""
        return mix((self._sum[starts + size] - self._sum[starts]) * self._down[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by block-wise prefix and suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
