"""Reconstruction filters: weight functions of a distance, with their default widths."""

from __future__ import annotations

import math
from collections.abc import Callable


def box(x: float, w: float) -> float:
    return 1.0 if abs(x) <= w * 0.5 else 0.0


def triangle(x: float, w: float) -> float:
    return max(0.0, 1 - abs(x) / (w * 0.5))


def gaussian(x: float, w: float) -> float:
    x = abs(x) * 2 / w
    return math.exp(-2 * x * x) if x < 1 else 0.0


def sharp_gaussian(x: float, w: float) -> float:
    x = abs(x) * 2 / w
    return math.exp(-4 * x * x) if x < 1 else 0.0


def catmull_rom(x: float, w: float) -> float:
    x = abs(x) * 4 / w
    if x < 1:
        return 0.5 * (2 + x * x * (3 * x - 5))
    return 0.5 * (4 + x * (-8 + x * (5 - x))) if x < 2 else 0.0


def blackman_harris(x: float, w: float) -> float:
    """Four-term window of minimal side lobes."""
    x = x / w + 0.5
    if not 0 <= x <= 1:
        return 0.0
    t = 2 * math.pi * x
    return 0.35875 - 0.48829 * math.cos(t) + 0.14128 * math.cos(2 * t) - 0.01168 * math.cos(3 * t)


def _sinc(x: float) -> float:
    return 1.0 if abs(x) < 1e-4 else math.sin(math.pi * x) / (math.pi * x)


def sinc(x: float, w: float) -> float:
    return _sinc(x) if abs(x) <= w * 0.5 else 0.0


def lanczos3(x: float, w: float) -> float:
    x = abs(x) * 6 / w
    return _sinc(x) * _sinc(x / 3) if x < 3 else 0.0


def cubic(x: float, w: float, a: float = 0.0) -> float:
    x = abs(x) * 4 / w
    if x < 1:
        return 1 + x * x * ((a + 2) * x - (a + 3))
    return a * (x * (x * (x - 5) + 8) - 4) if x < 2 else 0.0


def mitchell(x: float, w: float) -> float:
    x = abs(x) * 4 / w
    b = c = 1 / 3
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x * x + (6 - 2 * b)) / 6
    return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x * x + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6 if x < 2 else 0.0


def bspline(x: float, w: float) -> float:
    x = abs(x) * 4 / w
    if x <= 1:
        return 2 / 3 - x * x * (1 - x / 2)
    return (2 - x) ** 3 / 6 if x < 2 else 0.0


Weight = Callable[[float, float], float]
#: name: weight function, default width.
FILTERS: dict[str, tuple[Weight, float]] = {
    "box": (box, 1.0),
    "triangle": (triangle, 2.0),
    "gaussian": (gaussian, 3.0),
    "sharp-gaussian": (sharp_gaussian, 2.0),
    "catmull-rom": (catmull_rom, 4.0),
    "blackman-harris": (blackman_harris, 3.0),
    "sinc": (sinc, 4.0),
    "lanczos3": (lanczos3, 6.0),
    "mitchell": (mitchell, 4.0),
    "b-spline": (bspline, 4.0),
    "cubic": (lambda x, w: cubic(x, w, 0.0), 4.0),
    "keys": (lambda x, w: cubic(x, w, -0.5), 4.0),
    "simon": (lambda x, w: cubic(x, w, -0.75), 4.0),
    "rifman": (lambda x, w: cubic(x, w, -1.0), 4.0),
}
#: Filters of the distance from the centre, not of each axis apart.
RADIAL: dict[str, tuple[Weight, float]] = {"disk": (box, 1.0), "radial-lanczos3": (lanczos3, 6.0)}


def kernel(name: str, width: float, height: float, normalize: bool = True) -> dict[tuple[int, int], float]:
    """(dx, dy): weight on an odd-sized lattice around the centre."""
    if name == "laplacian":
        return {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
    rx, ry = max(1, math.ceil(width)) // 2, max(1, math.ceil(height)) // 2
    if name == "binomial":
        row = lambda r: [math.comb(2 * r, k) for k in range(2 * r + 1)]
        out = {(i - rx, j - ry): float(a * b) for i, a in enumerate(row(rx)) for j, b in enumerate(row(ry))}
    elif name in RADIAL:
        f = RADIAL[name][0]
        out = {(i, j): f(math.hypot(i, j), width) for i in range(-rx, rx + 1) for j in range(-ry, ry + 1)}
    else:
        f = FILTERS[name][0]
        out = {(i, j): f(i, width) * f(j, height) for i in range(-rx, rx + 1) for j in range(-ry, ry + 1)}
    s = sum(out.values())
    return {k: v / s for k, v in out.items()} if normalize and s else out
