"""Singular values and right singular vectors by way of a bidiagonal matrix.

Householder reflections take a triangle to an upper bidiagonal matrix B, dqds finds
its singular values to high relative accuracy, and twisted factorisations of
transpose(B) B - value give each vector from the two ends inwards.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
_TINY = float(np.finfo(float).tiny)
# Values closer than this share of the larger get their vectors orthogonalised.
_CLUSTER = 1e-3
_MOST_SWEEPS = 60


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v') x along the first axis."""
    v = x.astype(float).copy()
    length = float(np.linalg.norm(v))
    if length == 0.0 or not np.any(v[1:]):
        return v, 0.0
    v[0] += np.copysign(length, v[0])
    scale = np.abs(v).max()
    v /= scale
    return v, 2.0 / float(v @ v)


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and superdiagonal of B, and the reflections from the right."""
    a = np.array(matrix, dtype=float)
    size, right = a.shape[0], []
    for k in range(size):
        v, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k < size - 2:
            v, beta = _reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
            right.append((v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def unreflected(vectors: np.ndarray, right: list) -> np.ndarray:
    """Columns in the basis of B back in that of the matrix."""
    out = vectors.copy()
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        if beta:
            out[k + 1 :] -= np.outer(beta * v, v @ out[k + 1 :])
    return out


def _dqds_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool]:
    """One differential quotient-difference transform; not sound if a pivot is negative."""
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(len(q) - 1):
        if d < 0.0:
            return q, e, False
        pivot = d + e[i]
        if pivot == 0.0:
            pivot = _TINY
        ratio = q[i + 1] / pivot
        new_q.append(pivot)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    new_q.append(d)
    return new_q, new_e, d >= 0.0


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix by dqds, falling.

    Each transform takes a shift off that keeps all pivots positive, tried from the
    last two-by-two corner and made smaller where it was too large. The smallest
    value settles at the end and is split off.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, moved, limit = [], 0.0, (10.0 * _EPS) ** 2
    sweeps = _MOST_SWEEPS * max(1, len(q))
    while len(q) > 1:
        if e[-1] <= limit * (moved + q[-1]) or e[-1] < _TINY:
            found.append(moved + q.pop())
            e.pop()
            continue
        if q[0] < q[-1]:
            # Small values settle soonest at the end; the matrix read backwards has the same ones.
            q, e = q[::-1], e[::-1]
        half = (q[-2] + e[-1] + q[-1]) / 2.0
        corner = half + max(half * half - q[-2] * q[-1], 0.0) ** 0.5
        corner = q[-2] * q[-1] / corner if corner else 0.0
        for shift in (corner * (1.0 - 1e-3), corner * 0.25, 0.0):
            new_q, new_e, sound = _dqds_sweep(q, e, shift)
            if sound:
                break
        else:
            raise RuntimeError("dqds met a negative value without a shift")
        q, e, moved = new_q, new_e, moved + shift
        sweeps -= 1
        if not sweeps:
            raise RuntimeError("dqds did not settle")
    return np.array(sorted([*found, *(moved + x for x in q)], reverse=True))


class _Twisted:
    """Factorisations of transpose(B) B - value from both ends, joined at one row."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float, floor: float):
        size, q, e, off = len(a), a * a, b * b, a[:-1] * b
        self.down, self.up = np.empty(size), np.empty(size)
        self.low, self.high = np.empty(max(size - 1, 0)), np.empty(max(size - 1, 0))
        s, p = np.empty(size), np.empty(size)
        s[0] = -value
        for i in range(size):
            pivot = s[i] + q[i]
            self.down[i] = pivot if abs(pivot) > floor else floor
            if i < size - 1:
                self.low[i] = off[i] / self.down[i]
                s[i + 1] = s[i] * e[i] / self.down[i] - value
        p[-1] = q[-1] - value
        for i in range(size - 2, -1, -1):
            pivot = e[i] + p[i + 1]
            self.up[i + 1] = pivot if abs(pivot) > floor else floor
            self.high[i] = off[i] / self.up[i + 1]
            p[i] = p[i + 1] * q[i] / self.up[i + 1] - value
        self.gamma = s + p + value
        self.twist = int(np.argmin(np.abs(self.gamma)))
        self.floor = floor

    def null_vector(self) -> np.ndarray:
        z, k = np.zeros(len(self.gamma)), self.twist
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] = -self.high[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, right: np.ndarray) -> np.ndarray:
        """x of (transpose(B) B - value) x = right, up to its length."""
        y, k = right.copy(), self.twist
        for i in range(k):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(len(y) - 1, k, -1):
            y[i - 1] -= self.high[i - 1] * y[i]
        middle = self.gamma[k] if abs(self.gamma[k]) > self.floor else self.floor
        x = np.empty_like(y)
        x[k] = y[k] / middle
        x[:k], x[k + 1 :] = y[:k] / self.down[:k], y[k + 1 :] / self.up[k + 1 :]
        for i in range(k - 1, -1, -1):
            x[i] -= self.low[i] * x[i + 1]
        for i in range(k, len(x) - 1):
            x[i + 1] -= self.high[i] * x[i]
        return x / np.abs(x).max()


def _apart(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z without its parts along the others, as a unit, and what was left of it."""
    left = 1.0
    for _ in range(3):
        for other in others:
            z = z - (other @ z) * other
        length = float(np.linalg.norm(z))
        if not length:
            return z, 0.0
        z, left = z / length, left * length
    return z, left


def _block_vectors(a: np.ndarray, b: np.ndarray, values: list[float], floor: float) -> list[np.ndarray]:
    """Vectors of one block without a zero above its diagonal, values falling."""
    found: list[np.ndarray] = []
    for place, value in enumerate(values):
        start = place
        while start and values[start - 1] - values[start] <= _CLUSTER * values[start - 1]:
            start -= 1
        close = found[start:place]
        twisted = _Twisted(a, b, value, floor)
        z, left = _apart(twisted.null_vector(), close)
        seed = np.random.default_rng(place)
        for _ in range(8 if close else 0):
            if left < 0.1:
                z, _ = _apart(seed.standard_normal(len(a)), close)
            x = twisted.solve(z)
            z, left = _apart(x / np.linalg.norm(x), close)
        found.append(z)
    return found


def leading_directions(triangle: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values, falling, and their unit right vectors in columns.

    Values that rounding cannot tell from zero have no direction of their own and
    are left out, so there may be fewer than `most`. Equal values get an orthonormal
    basis of their space. The largest entry of each vector is positive.
    """
    size = triangle.shape[0]
    scale = float(np.abs(triangle).max(initial=0.0))
    if not scale:
        return np.empty(0), np.empty((size, 0))
    a, b, right = bidiagonalise(triangle / scale)
    largest = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= _EPS * largest) + 1).tolist(), size]
    pairs: list[tuple[float, int, int]] = []
    for start, end in zip(cuts, cuts[1:], strict=False):
        pairs += [(v, start, end) for v in squared_values(a[start:end], b[start : end - 1])]
    pairs.sort(key=lambda p: (-p[0], p[1]))
    least = pairs[0][0] * (size * _EPS) ** 2
    chosen = [p for p in pairs[:most] if p[0] > least]
    columns = np.zeros((size, len(chosen)))
    for start, end in sorted({p[1:] for p in chosen}):
        places = [i for i, p in enumerate(chosen) if p[1:] == (start, end)]
        floor = _EPS * _EPS * pairs[0][0]
        for i, z in zip(places, _block_vectors(a[start:end], b[start : end - 1], [chosen[i][0] for i in places], floor), strict=True):
            columns[start:end, i] = z
    vectors = unreflected(columns, right)
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([p[0] for p in chosen]) * scale * scale, vectors * signs
