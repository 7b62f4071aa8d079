"""Channels and geometry: projections that rewrite channels or coordinates; no shuffle unless a grid must be filled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, Spec, default_names, grid, joined, per_channel, small_table, some
from lumenframe.operators.arithmetic import _made



def _lit(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def fill(spark: SparkSession, roi: Roi, *corners, names: list[str] | None = None) -> Image:
    """One colour, a vertical ramp of two, or a bilinear ramp of four (top left, top right, bottom left, bottom right)."""
    u = (F.col("x") - roi.x0) / F.lit(float(max(1, roi.width - 1)))
    v = (F.col("y") - roi.y0) / F.lit(float(max(1, roi.height - 1)))
    return grid(spark, roi, _ramp(corners, u, v), names)


def _ramp(corners, u: Column, v: Column) -> list[Column]:
    c = [[float(x) for x in k] for k in corners]
    if len(c) == 1:
        return _lit(c[0])
    if len(c) == 2:
        return [(1 - v) * p + v * q for p, q in zip(*c, strict=True)]
    return [(1 - v) * ((1 - u) * a + u * b) + v * ((1 - u) * p + u * q) for a, b, p, q in zip(*c, strict=True)]


def fill_region(a: Image, roi: Roi, *corners) -> Image:
    u = (F.col("x") - roi.x0) / F.lit(float(max(1, roi.width - 1)))
    v = (F.col("y") - roi.y0) / F.lit(float(max(1, roi.height - 1)))
    return a.dense().within(roi, _ramp(corners, u, v)) if corners else a


def zero(spark: SparkSession, roi: Roi, n: int = 3) -> Image:
    return grid(spark, roi, _lit([0] * n))


def checker(spark: SparkSession, roi: Roi, width: int, height: int, depth: int, color1, color2, offset=(0, 0, 0)) -> Image:
    """The parity of the tile's index sum picks the colour; tiles below an offset count from one on."""
    tiles = [F.expr(f"({k} - ({o})) div {s} + cast({k} < {o} as int)") for k, o, s in zip("xyz", offset, (width, height, max(depth, 1)), strict=True)]
    odd = (tiles[0] + tiles[1] + tiles[2]).bitwiseAND(1) == 1
    return grid(spark, roi, [F.when(odd, q).otherwise(p) for p, q in zip(_lit(color1), _lit(color2), strict=True)])


M32 = 0xFFFFFFFF


def _rotated(v: Column, k: int) -> Column:
    return (F.shiftleft(v, k).bitwiseOR(F.shiftrightunsigned(v, 32 - k))).bitwiseAND(M32)


def _final(a: Column, b: Column, c: Column) -> Column:
    """Seven rounds of xor and subtraction of rotated 32-bit values."""
    for target, source, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        v = {"a": a, "b": b, "c": c}
        new = (v[target].bitwiseXOR(v[source]) - _rotated(v[source], k)).bitwiseAND(M32)
        a, b, c = (new if target == n else v[n] for n in "abc")
    return c


def hash_noise(x: Column, y: Column, z: Column, c: int, seed: int) -> Column:
    """Uniform in [0, 1), a function of the arguments alone."""
    as32 = lambda v: v.cast("long").bitwiseAND(M32)
    # An array variable keeps the inner hash from being written out once for each use of it.
    inner = F.element_at(F.transform(F.array(_final(as32(x), as32(y), as32(z))), lambda h: _final(h, F.lit(c).cast("long"), F.lit(seed).cast("long"))), 1)
    return inner.bitwiseAND(0xFFFFF) / F.lit(float(1 << 20))


def noise(a: Image, kind: str = "white", low: float = 0.0, high: float = 0.1, mono: bool = False, seed: int = 0, roi: Roi | None = None) -> Image:
    """white or uniform: low to high is added; gaussian: mean low, deviation high is added; salt: a share high becomes low."""
    a = a.dense()
    xyz = [F.col("x"), F.col("y"), F.col("z")]
    out = []
    for i, c in enumerate(a.c):
        k = 0 if mono else i
        u = hash_noise(*xyz, k, seed)
        if kind in ("white", "uniform"):
            out.append(c + low + u * (high - low))
        elif kind == "salt":
            out.append(F.when(u < high, F.lit(float(low))).otherwise(c))
        elif kind == "gaussian":
            # Box-Muller instead of a rejection loop: the same distribution, in generated code.
            w = hash_noise(*xyz, k, seed + 139)
            out.append(c + low + high * F.sqrt(-2 * F.log(1 - u)) * F.cos(w * 6.283185307179586))
        else:
            raise ValueError(f"unknown noise {kind!r}")
    return a.within(roi, out)


def _composited(a: Image, here: Column, color) -> Image:
    a = a.dense()
    color = per_channel(color, a.spec.n)
    alpha = color[a.spec.alpha] if a.spec.alpha >= 0 else 1.0
    return a.with_channels([F.when(here, F.lit(v) + c * (1 - alpha)).otherwise(c) for v, c in zip(color, a.c, strict=True)])


def render_point(a: Image, x: int, y: int, color=1.0) -> Image:
    return _composited(a, (F.col("x") == x) & (F.col("y") == y), color)


def line_points(x1: int, y1: int, x2: int, y2: int, skip_first: bool = False) -> list[tuple[int, int]]:
    """Bresenham's line."""
    dx, dy, sx, sy = abs(x2 - x1), -abs(y2 - y1), (1 if x1 < x2 else -1), (1 if y1 < y2 else -1)
    out, e = [], dx + dy
    while True:
        out.append((x1, y1))
        if (x1, y1) == (x2, y2):
            return out[1:] if skip_first else out
        twice = 2 * e
        if twice >= dy:
            e, x1 = e + dy, x1 + sx
        if twice <= dx:
            e, y1 = e + dx, y1 + sy


def render_line(a: Image, x1: int, y1: int, x2: int, y2: int, color=1.0, skip_first: bool = False) -> Image:
    points = small_table(a.df.sparkSession, [(*p, True) for p in line_points(x1, y1, x2, y2, skip_first)], "x int, y int, hit boolean")
    return _composited(Image(a.dense().df.join(points, ["x", "y"], "left"), a.spec, True), F.coalesce("hit", F.lit(False)), color)


def render_box(a: Image, x1: int, y1: int, x2: int, y2: int, color=1.0, filled: bool = False) -> Image:
    x, y = F.col("x"), F.col("y")
    here = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    if not filled:
        here &= some([x == x1, x == x2, y == y1, y == y2])
    return _composited(a, here, color)


def channels(a: Image, order: list, values: list[float] | None = None, names: list[str] | None = None) -> Image:
    """order has indices or names of channels; a negative index is the constant of values."""
    out, own = [], []
    constant = [float((values or [])[k]) if values and k < len(values) else 0.0 for k in range(len(order))]
    a = a.shown(not any(v for v, c in zip(constant, order, strict=True) if not isinstance(c, str) and c < 0))
    for k, c in enumerate(order):
        i = a.spec.names.index(c) if isinstance(c, str) else c
        out.append(a.c[i] if i >= 0 else F.lit(constant[k]))
        own.append(a.spec.names[i] if i >= 0 else f"channel{k}")
    return a.with_channels(out, names or own)


def channel_append(a: Image, b: Image) -> Image:
    df, x, y, spec = joined(a, b)
    names = [*a.spec.names, *(n if n not in a.spec.names else f"channel{a.spec.n + i}" for i, n in enumerate(b.spec.names))]
    return _made(df, x + y, replace(spec, names=tuple(names)))


def copy(a: Image) -> Image:
    return a


def crop(a: Image, roi: Roi) -> Image:
    """The data window becomes roi; pixels that the image lacks have no row and so are zero."""
    return Image(a.df.filter(roi.has()), replace(a.spec, data=roi))


def cut(a: Image, roi: Roi) -> Image:
    data = Roi(0, roi.width, 0, roi.height)
    return crop(a, roi).moved(F.col("x") - roi.x0, F.col("y") - roi.y0, data, data)


def paste(dst: Image, x: int, y: int, src: Image, channel: int = 0) -> Image:
    """src, moved by (x, y), over dst; its first channel goes to `channel`."""
    data = src.spec.data.shifted(x, y)
    moved = src.dense().moved(F.col("x") + x, F.col("y") + y, data)
    right = moved.df.select(*KEYS, *[c.alias(f"b{i}") for i, c in enumerate(moved.c)], F.lit(True).alias("has"))
    df = dst.df.join(right, KEYS, "full_outer")
    out = []
    for i, c in enumerate(dst.c):
        own = F.coalesce(c, F.lit(0.0))
        out.append(F.when(F.col("has"), F.col(f"b{i - channel}")).otherwise(own) if 0 <= i - channel < src.spec.n else own)
    return _made(df, out, replace(dst.spec, data=dst.spec.data.union(data)))


def flip(a: Image) -> Image:
    f, d = a.spec.full, a.spec.data
    s = f.y0 + f.y1
    return a.moved(F.col("x"), s - 1 - F.col("y"), replace(d, y0=s - d.y1, y1=s - d.y0))


def flop(a: Image) -> Image:
    f, d = a.spec.full, a.spec.data
    s = f.x0 + f.x1
    return a.moved(s - 1 - F.col("x"), F.col("y"), replace(d, x0=s - d.x1, x1=s - d.x0))


def rotate180(a: Image) -> Image:
    return flip(flop(a))


def _swapped(r: Roi) -> Roi:
    return replace(r, x0=r.y0, x1=r.y1, y0=r.x0, y1=r.x1)


def transpose(a: Image) -> Image:
    return a.moved(F.col("y"), F.col("x"), _swapped(a.spec.data), _swapped(a.spec.full))


def rotate90(a: Image) -> Image:
    """Clockwise: the image's row y becomes column y1 - 1 - y of the display window."""
    f, d = a.spec.full, a.spec.data
    data = Roi(f.y1 - d.y1, f.y1 - d.y0, d.x0, d.x1, d.z0, d.z1)
    return a.moved(f.y1 - 1 - F.col("y"), F.col("x"), data, replace(f, x0=0, x1=f.height, y0=f.x0, y1=f.x1))


def rotate270(a: Image) -> Image:
    f, d = a.spec.full, a.spec.data
    data = Roi(d.y0, d.y1, f.x1 - d.x1, f.x1 - d.x0, d.z0, d.z1)
    return a.moved(F.col("y"), f.x1 - 1 - F.col("x"), data, replace(f, x0=f.y0, x1=f.y1, y0=0, y1=f.width))


#: By the value of Orientation; each leaves it 1.
ORIENTATIONS: dict[int, Callable[[Image], Image]] = {
    1: copy, 2: flop, 3: rotate180, 4: flip, 5: lambda a: flop(rotate90(a)), 6: rotate90, 7: lambda a: rotate90(flop(a)), 8: rotate270,
}


def reorient(a: Image) -> Image:
    out = ORIENTATIONS[int(a.spec.attribs.get("Orientation", 1))](a)
    return Image(out.df, replace(out.spec, attribs=out.spec.attribs | {"Orientation": 1}))


def circular_shift(a: Image, dx: int, dy: int, dz: int = 0) -> Image:
    d = a.spec.data
    wrap = lambda c, o, n, k: F.pmod(F.col(c) - o + k, F.lit(n)) + o
    return a.moved(wrap("x", d.x0, d.width, dx), wrap("y", d.y0, d.height, dy), d, z=wrap("z", d.z0, d.depth, dz))


def mosaic(images: list[Image], columns: int, pad: int = 0) -> Image:
    """Contact sheet, row by row, in cells of the largest image."""
    w, h = max(i.spec.data.width for i in images), max(i.spec.data.height for i in images)
    rows = -(-len(images) // columns)
    data = Roi(0, columns * w + (columns - 1) * pad, 0, rows * h + (rows - 1) * pad)
    out = None
    for k, i in enumerate(images):
        dx, dy = (k % columns) * (w + pad) - i.spec.data.x0, (k // columns) * (h + pad) - i.spec.data.y0
        df = i.moved(F.col("x") + dx, F.col("y") + dy, data).df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    n = max(i.spec.n for i in images)
    return Image(out.fillna(0.0), Spec(data, data, tuple(default_names(n))))
