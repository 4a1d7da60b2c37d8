"""Bicubic smoothing splines over scattered values of one image's tiles, and their evaluation.

The criterion is the published one for smoothing with an adaptive knot choice (Dierckx 1981): start from a bicubic
polynomial; while the sum of squared residuals is over ``s``, put a knot into the interval of either axis with the largest sum of
squares, at the place that the squares weigh out; then, among the surfaces on these knots whose sum is ``s``, take the smoothest
one, in the jumps of the third derivatives. Arguments outside the bounds take the value at the bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE = 3


def knots_of(inner: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return np.concatenate([[lo] * (DEGREE + 1), np.sort(inner), [hi] * (DEGREE + 1)])


def basis(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Cubic B-splines on the knots ``k``, one column per function."""
    x = np.clip(np.asarray(x, float), k[0], k[-1])
    inside = np.clip(np.searchsorted(k, x, "right") - 1, DEGREE, len(k) - DEGREE - 2)
    b = (np.arange(len(k) - 1) == inside[:, None]).astype(float)
    for d in range(1, DEGREE + 1):
        n = b.shape[1] - 1
        left, right = k[d : d + n] - k[:n], k[d + 1 : d + 1 + n] - k[1 : n + 1]
        up = np.divide(x[:, None] - k[:n], left, out=np.zeros((len(x), n)), where=left > 0)
        down = np.divide(k[d + 1 : d + 1 + n] - x[:, None], right, out=np.zeros((len(x), n)), where=right > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def jumps(k: np.ndarray) -> np.ndarray:
    """Jumps of the third derivative at the inner knots, a row each, scaled by the mean interval; from divided differences."""
    inner = k[DEGREE + 1 : -DEGREE - 1]
    n = len(k) - DEGREE - 1
    c, t = np.eye(n), k
    for d in range(DEGREE, 0, -1):  # coefficients of the derivatives, one degree lower each time
        gap = (t[d + 1 : d + len(c)] - t[1 : len(c)]) / d
        c, t = np.divide(c[1:] - c[:-1], gap[:, None], out=np.zeros((len(c) - 1, n)), where=gap[:, None] > 0), t[1:-1]
    scale = ((k[-1] - k[0]) / (len(inner) + 1)) ** DEGREE
    return (c[1:] - c[:-1]) * scale if len(inner) else np.zeros((0, n))


@dataclass
class Surface:
    kx: np.ndarray
    ky: np.ndarray
    coef: np.ndarray  # one row for each function of y

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.einsum("ni,ij,nj->n", basis(y, self.ky), self.coef, basis(x, self.kx))


def _solved(x, y, z, kx, ky, weight: float = 0.0) -> Surface:
    """Least squares with ``weight`` on the jumps."""
    bx, by = basis(x, kx), basis(y, ky)
    a = (by[:, :, None] * bx[:, None, :]).reshape(len(z), -1)
    right = z
    if weight:
        rough = np.vstack([np.kron(np.eye(by.shape[1]), jumps(kx)), np.kron(jumps(ky), np.eye(bx.shape[1]))])
        a, right = np.vstack([a, np.sqrt(weight) * rough]), np.concatenate([z, np.zeros(len(rough))])
    return Surface(kx, ky, np.linalg.lstsq(a, right, rcond=None)[0].reshape(by.shape[1], bx.shape[1]))


def fitted(x: np.ndarray, y: np.ndarray, z: np.ndarray, s: float | None = None, bounds: tuple[float, float, float, float] | None = None, knots: int | None = None, tol: float = 1e-3) -> Surface | None:
    """The surface through (x, y, z) whose sum of squared residuals is at most ``s`` (default: the number of points), within ``tol``.

    None with fewer points than a bicubic polynomial has coefficients. ``bounds`` are x0, x1, y0, y1 (default: of the points); ``knots``
    asks for that many equal intervals and no smoothing instead.
    """
    if len(z) < (DEGREE + (knots or 1)) ** 2:
        return None
    x0, x1, y0, y1 = bounds or (x.min(), x.max(), y.min(), y.max())
    if x1 <= x0 or y1 <= y0:
        return None
    if knots:
        return _solved(x, y, z, *(knots_of(np.linspace(lo, hi, knots + 1)[1:-1], lo, hi) for lo, hi in ((x0, x1), (y0, y1))))
    s = float(len(z)) if s is None else s
    most = max(int(DEGREE + np.sqrt(3 * len(z))), 2 * DEGREE + 3) - 2 * (DEGREE + 1)  # the usual bound on knots of an axis
    inner: list[list[float]] = [[], []]
    limits = ((x0, x1), (y0, y1))
    made = lambda weight=0.0: _solved(x, y, z, *(knots_of(np.array(i), *at) for i, at in zip(inner, limits)), weight)
    off = lambda surface: z - surface.at(x, y)
    surface = made()
    while (r := off(surface) ** 2).sum() > s * (1 + tol):
        places = []
        for axis, (v, (lo, hi)) in enumerate(zip((x, y), limits)):
            cuts = np.array([lo, *sorted(inner[axis]), hi])
            part = np.clip(np.searchsorted(cuts, v, "right") - 1, 0, len(cuts) - 2)
            for i in range(len(cuts) - 1):
                mine = part == i
                if len(inner[axis]) < most and mine.any() and r[mine].sum() > 0:
                    at = (v[mine] * r[mine]).sum() / r[mine].sum()
                    if cuts[i] < at < cuts[i + 1]:
                        places.append((r[mine].sum(), axis, at))
        if not places:
            return surface
        _, axis, at = max(places)
        inner[axis].append(float(at))
        surface = made()
    if not any(inner):
        return surface
    # the smoothest surface on these knots: the sum of squares grows with the weight of the jumps
    low, high = 1e-12, 1.0
    while (off(made(high)) ** 2).sum() < s and high < 1e12:
        low, high = high, high * 16
    for _ in range(60):
        mid = float(np.sqrt(low * high))
        best = made(mid)
        now = (off(best) ** 2).sum()
        if abs(now - s) <= tol * s:
            return best
        low, high = (mid, high) if now < s else (low, mid)
    return made(low)
