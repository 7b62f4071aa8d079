"""Pixel arithmetic: projections, and natural joins on the pixel for two images."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, joined, per_channel, total

Operand = Image | float | int | list | tuple


def _binary(a: Operand, b: Operand, f: Callable[[Column, Column], Column], zero: Callable[[float, bool], float], roi: Roi | None = None, extra: str = "copy") -> Image:
    """f for each channel; of two images with different channel counts the rest is copied from the wider one, or left out.

    zero(v, first) is what f makes of 0 and the constant v, which is its first or its second operand.
    """
    if not isinstance(a, Image):
        values = per_channel(a, b.spec.n)
        b = b.shown(all(zero(v, True) == 0 for v in values))
        return b.within(roi, [f(F.lit(v), c) for v, c in zip(values, b.c, strict=True)])
    if not isinstance(b, Image):
        values = per_channel(b, a.spec.n)
        a = a.shown(all(zero(v, False) == 0 for v in values))
        return a.within(roi, [f(c, F.lit(v)) for c, v in zip(a.c, values, strict=True)])
    df, x, y, spec = joined(a, b)
    out = [f(p, q) for p, q in zip(x, y, strict=False)]
    names = a.spec.names[: len(out)]
    if extra == "copy":
        wide = a if a.spec.n > b.spec.n else b
        out += (x if wide is a else y)[len(out) :]
        names = wide.spec.names
    if roi is not None:
        out = [F.when(roi.has(), v).otherwise(F.lit(0.0)) for v in out]
    return _made(df, out, replace(spec, names=tuple(names)))


def _made(df, values: list[Column], spec) -> Image:
    return Image(df.select(*KEYS, *[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)]), spec)


def add(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: p + q, lambda v, first: v, roi)


def sub(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: p - q, lambda v, first: v, roi)


def absdiff(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: F.abs(p - q), lambda v, first: v, roi)


def mul(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: p * q, lambda v, first: 0.0, roi, "drop")


def div(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    """A division by zero gives zero."""
    return _binary(a, b, lambda p, q: F.when(q == 0, 0.0).otherwise(p / F.when(q != 0, q)), lambda v, first: 0.0, roi, "drop")


def maximum(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: F.when(p > q, p).otherwise(q), lambda v, first: max(v, 0.0), roi, "drop")


def minimum(a: Operand, b: Operand, roi: Roi | None = None) -> Image:
    return _binary(a, b, lambda p, q: F.when(p < q, p).otherwise(q), lambda v, first: min(v, 0.0), roi, "drop")


def mad(a: Operand, b: Operand, c: Operand, roi: Roi | None = None) -> Image:
    return add(mul(a, b, roi), c, roi)


def scale(a: Image, b: Image) -> Image:
    """All channels of one times the single channel of the other."""
    if b.spec.n != 1:
        a, b = b, a
    df, x, y, spec = joined(a, b)
    return _made(df, [v * y[0] for v in x], spec)


def absolute(a: Image) -> Image:
    return a.with_channels([F.abs(c) for c in a.c])


def invert(a: Image, roi: Roi | None = None) -> Image:
    a = a.dense()
    return a.within(roi, [1 - c for c in a.c])


def power(a: Image, b, roi: Roi | None = None) -> Image:
    values = per_channel(b, a.spec.n)
    a = a.shown(min(values) > 0)
    return a.within(roi, [F.pow(c, F.lit(v)) for c, v in zip(a.c, values, strict=True)])


def normalize(a: Image, in_center: float = 0.0, out_center: float = 0.0, scale: float = 1.0) -> Image:
    """Unit length of the first three channels; a zero vector becomes out_center, a fourth channel stays."""
    a = a.shown(in_center == 0 and out_center == 0)
    v = [c - in_center for c in a.c[:3]]
    length = F.sqrt(total([x * x for x in v]))
    return a.with_channels([F.when(length > 0, x / F.when(length > 0, length) * scale + out_center).otherwise(out_center) for x in v] + a.c[3:])


def channel_sum(a: Image, weights=1.0) -> Image:
    return a.with_channels([total([c * w for c, w in zip(a.c, per_channel(weights, a.spec.n), strict=True)])], ["Y"])


def clamp(a: Image, low=float("-inf"), high=float("inf"), clamp_alpha: bool = False, roi: Roi | None = None) -> Image:
    """NaN becomes low."""
    n = a.spec.n
    a = a.shown(all(lo <= 0 <= hi for lo, hi in zip(per_channel(low, n), per_channel(high, n), strict=True)))
    out = []
    for i, (c, lo, hi) in enumerate(zip(a.c, per_channel(low, n), per_channel(high, n), strict=True)):
        v = F.when(F.isnan(c), lo).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
        out.append(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if clamp_alpha and i == a.spec.alpha else v)
    return a.within(roi, out)


def maxchan(a: Image) -> Image:
    return a.with_channels([F.greatest(*a.c) if a.spec.n > 1 else a.c[0]], ["Y"])


def minchan(a: Image) -> Image:
    return a.with_channels([F.least(*a.c) if a.spec.n > 1 else a.c[0]], ["Y"])


def contrast_remap(a: Image, black=0.0, white=1.0, low=0.0, high=1.0, scontrast=1.0, sthresh=0.5) -> Image:
    """Linear stretch, then a sigmoid if any scontrast is not 1, then low to high; equal black and white are a threshold."""
    n = a.spec.n
    args = [per_channel(v, n) for v in (black, white, low, high, scontrast, sthresh)]
    #: Zero stays zero only where black maps it to the low end, and that is zero.
    a = a.shown(all((b == 0 != w or b == w > 0) and lo == 0 for b, w, lo in zip(*args[:3], strict=True)))
    out = []
    for c, b, w, lo, hi, s, t in zip(a.c, *args, strict=True):
        r = F.when(c < b, 0.0).otherwise(1.0) if b == w else (c - b) / (w - b)
        if any(x != 1 for x in args[4]):
            sig = lambda x, s=s, t=t: 1 / (1 + F.exp(s * (t - x)))
            y = sig(F.lit(0.0))
            r = (sig(r) - y) / (sig(F.lit(1.0)) - y)
        out.append(r * (hi - lo) + lo)
    return a.with_channels(out)


# Luma weights of saturation, and those of range compression.
LUMA = (0.2126, 0.7152, 0.0722)
RANGE_LUMA = (0.21264, 0.71517, 0.07219)
# Fixed values of the logarithmic range compression: f(x) = a + b * ln(|c * x + 1|) beyond x1.
RANGE_X1, RANGE_A, RANGE_B, RANGE_C = 0.18, -0.54576885700225830078, 0.18351669609546661377, 284.3577880859375


def saturate(a: Image, scale: float, first: int = 0) -> Image:
    rgb = a.c[first : first + 3]
    luma = total([c * w for c, w in zip(rgb, LUMA, strict=True)])
    return a.with_channels([*a.c[:first], *[luma * (1 - scale) + c * scale for c in rgb], *a.c[first + 3 :]])


def _compress(v: Column) -> Column:
    x = F.abs(v)
    return F.when(x <= RANGE_X1, v).otherwise(F.signum(v) * (RANGE_A + RANGE_B * F.log(F.abs(RANGE_C * x + 1))))


def _expand(v: Column) -> Column:
    y = F.abs(v)
    e = F.exp((y - RANGE_A) / RANGE_B)
    return F.when(y <= RANGE_X1, v).otherwise(F.signum(v) * ((e - 1) / RANGE_C))


def _range(a: Image, f: Callable[[Column], Column], use_luma: bool) -> Image:
    skip = {a.spec.alpha, a.spec.zchannel}
    if use_luma and a.spec.n >= 3:
        luma = total([c * w for c, w in zip(a.c[:3], RANGE_LUMA, strict=True)])
        factor = F.when(luma > 0, f(luma) / F.when(luma > 0, luma)).otherwise(0.0)
        return a.with_channels([c * factor if i < 3 else c for i, c in enumerate(a.c)])
    return a.with_channels([c if i in skip else f(c) for i, c in enumerate(a.c)])


def rangecompress(a: Image, use_luma: bool = False) -> Image:
    return _range(a, _compress, use_luma)


def rangeexpand(a: Image, use_luma: bool = False) -> Image:
    return _range(a, _expand, use_luma)


def _by_alpha(a: Image, f: Callable[[Column, Column], Column]) -> Image:
    if a.spec.alpha < 0:
        return a
    alpha = a.c[a.spec.alpha]
    return a.with_channels([c if i in (a.spec.alpha, a.spec.zchannel) else f(c, alpha) for i, c in enumerate(a.c)])


def unpremult(a: Image) -> Image:
    return _by_alpha(a, lambda c, al: F.when((al == 0) | (al == 1), c).otherwise(c / F.when(al != 0, al)))


def premult(a: Image) -> Image:
    return _by_alpha(a, lambda c, al: F.when(al == 1, c).otherwise(c * al))


def repremult(a: Image) -> Image:
    return _by_alpha(a, lambda c, al: F.when((al == 0) | (al == 1), c).otherwise(c * al))


def over(a: Image, b: Image) -> Image:
    """Porter-Duff: a + (1 - alpha of a) * b; depth is a's unless its alpha is zero."""
    df, x, y, spec = joined(a, b)
    alpha = F.least(F.greatest(x[a.spec.alpha], F.lit(0.0)), F.lit(1.0))
    z = a.spec.zchannel
    return _made(df, [F.when(alpha != 0, p).otherwise(q) if i == z else p + (1 - alpha) * q for i, (p, q) in enumerate(zip(x, y, strict=True))], spec)


def zover(a: Image, b: Image, zero_is_inf: bool = False) -> Image:
    """The nearer pixel is composited over the other."""
    df, x, y, spec = joined(a, b)
    k, z = a.spec.alpha, a.spec.zchannel
    az, bz = x[z], y[z]
    if zero_is_inf:
        far = F.lit(float("inf"))
        az, bz = F.when(az == 0, far).otherwise(az), F.when(bz == 0, far).otherwise(bz)
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    pick = lambda p, q, al, i: F.when(al != 0, p).otherwise(q) if i == z else p + (1 - al) * q
    return _made(df, [F.when(az <= bz, pick(p, q, clip(x[k]), i)).otherwise(pick(q, p, clip(y[k]), i)) for i, (p, q) in enumerate(zip(x, y, strict=True))], spec)


def complex_to_polar(a: Image) -> Image:
    re, im = a.c
    phase = F.atan2(im, re)
    return a.with_channels([F.hypot(re, im), F.when(phase < 0, phase + 6.283185307179586).otherwise(phase)])


def polar_to_complex(a: Image) -> Image:
    amp, phase = a.c
    return a.with_channels([amp * F.cos(phase), amp * F.sin(phase)])


def color_map(a: Image, knots: list[list[float]], channel: int = 0) -> Image:
    """Piecewise linear map of one channel (luma if negative) by evenly spaced colours."""
    a = a.shown(not any(knots[0]))
    v = a.c[channel] if channel >= 0 else total([c * w for c, w in zip(a.c, LUMA, strict=False)])
    last = len(knots) - 1
    t = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(t), F.lit(last - 1)).cast("int")
    table = [F.array(*[F.lit(float(k[j])) for k in knots]) for j in range(len(knots[0]))]
    out = [F.get(k, i) * (1 - (t - i)) + F.get(k, i + 1) * (t - i) for k in table]
    return a.with_channels(out, ["R", "G", "B"][: len(out)])


# Knots of the named colour maps that are simple polylines.
COLOR_MAPS = {
    "blue-red": [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]],
    "bluered": [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]],
    "spectrum": [[0.0, 0.0, 0.05], [0.0, 0.0, 0.75], [0.0, 0.5, 0.0], [0.75, 0.0, 0.0], [1.0, 0.5, 0.0]],
    "heat": [[0.0, 0.0, 0.0], [0.05, 0.0, 0.0], [0.25, 0.0, 0.0], [0.75, 0.75, 0.0], [1.0, 1.0, 1.0]],
}


def color_matrix(a: Image, m: list[float], unpremultiply: bool = False) -> Image:
    """A 4x4 matrix (rows of 4, row vectors) on the first four channels."""
    src = unpremult(a) if unpremultiply else a
    n = min(4, src.spec.n)
    src = src.shown(n == 4 or not any(m[12:]))
    v = src.c[:n] + [F.lit(1.0)] * (4 - n)
    out = src.with_channels([total([v[i] * m[4 * i + j] for i in range(4)]) for j in range(n)] + src.c[n:], list(src.spec.names))
    return premult(out) if unpremultiply else out
