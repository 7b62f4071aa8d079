"""Perceptual differences of two images: an error map of flipping between them, and visible differences by contrast.

Both images' channels are columns of one row for each pixel, so each filter pass
deals rows by pixel once for all its responses.  Exposures are rows as well: an
HDR comparison is one plan whatever their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, Spec, joined, total
from lumenframe.operators import filters
from lumenframe.operators.neighborhood import _spread, _weight

# Fixed values of the error map: knee of the remapped colour difference (position, value), width of the feature filter, exponents of colour and feature differences.
KNEE_AT, KNEE, FEATURE_WIDTH, COLOR_EXPONENT, FEATURE_EXPONENT = 0.4, 0.95, 0.082, 0.7, 0.5
# Contrast sensitivity of the three opponent channels as Gaussians (a, b); the last has two.
SENSITIVITY = {"y": [(1.0, 0.0047)], "cx": [(1.0, 0.0053)], "cz": [(34.1, 0.04), (13.5, 0.025)]}
# White of D65, linear Rec.709 to XYZ and back.
WHITE = (0.950428545, 1.0, 1.088900371)
TO_XYZ = (
    (10135552 / 24577794, 8788810 / 24577794, 4435075 / 24577794),
    (2613072 / 12288897, 8788810 / 12288897, 887015 / 12288897),
    (1425312 / 73733382, 8788810 / 73733382, 70074185 / 73733382),
)
FROM_XYZ = ((3.241003275, -1.537398934, -0.498615861), (-0.969224334, 1.875930071, 0.041554224), (0.055639423, -0.204011202, 1.057148933))
# Pixels a degree of a 0.7 m wide screen of 3840 pixels at 0.7 m.
PIXELS_PER_DEGREE = 67.02
# Fixed values: (c*c*t0 + c*t1 + t2) / (c*c*t3 + c*t4 + t5) of the tone curves.
TONES = {
    "aces": (0.36 * 2.51, 0.6 * 0.03, 0.0, 0.36 * 2.43, 0.6 * 0.59, 0.14),
    "hable": (0.231683, 0.013791, 0.0, 0.18, 0.3, 0.018),
    "reinhard": (0.0, 1.0, 0.0, 0.0, 1.0, 1.0),
}
LUMINANCE = (0.2126, 0.7152, 0.0722)

Taps = dict[int, float]
Triple = list[Column]


def _mixed(m, c: Triple) -> Triple:
    return [total([F.lit(float(k)) * v for k, v in zip(row, c, strict=True)]) for row in m]


def _opponent(rgb: Triple) -> Triple:
    x, y, z = (v / w for v, w in zip(_mixed(TO_XYZ, rgb), WHITE, strict=True))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def _from_opponent(c: Triple) -> Triple:
    y = (c[0] + 16) / 116
    xyz = [v * w for v, w in zip((y + c[1] / 500, y, y - c[2] / 200), WHITE, strict=True)]
    return [_unit(v) for v in _mixed(FROM_XYZ, xyz)]


def _unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _hunt_lab(rgb: Triple) -> Triple:
    """L, and a and b in proportion to L."""
    d = 6 / 29
    curve = lambda t: F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4 / 29)
    x, y, z = (curve(v / w) for v, w in zip(_mixed(TO_XYZ, rgb), WHITE, strict=True))
    lum = 116 * y - 16
    return [lum, 0.01 * lum * 500 * (x - y), 0.01 * lum * 200 * (y - z)]


def _farthest() -> float:
    """The colour difference of green and blue, as a plan-time value."""
    d = 6 / 29

    def lab(rgb):
        x, y, z = (sum(k * v for k, v in zip(row, rgb, strict=True)) / w for row, w in zip(TO_XYZ, WHITE, strict=True))
        x, y, z = (t ** (1 / 3) if t > d**3 else t / (3 * d * d) + 4 / 29 for t in (x, y, z))
        lum = 116 * y - 16
        return lum, 5 * lum * (x - y), 2 * lum * (y - z)

    (l0, a0, b0), (l1, a1, b1) = lab((0, 1, 0)), lab((0, 0, 1))
    return (abs(l0 - l1) + math.hypot(a0 - a1, b0 - b1)) ** COLOR_EXPONENT


def sensitivity_taps(ppd: float) -> dict[str, Taps]:
    """Weights of the contrast filters, whose reach follows the pixels a degree: y, cx, and the two parts of cz."""
    reach = math.ceil(3 * math.sqrt(max(b for parts in SENSITIVITY.values() for _, b in parts) / (2 * math.pi**2)) * ppd)
    out: dict[str, Taps] = {}
    for name, parts in SENSITIVITY.items():
        rows = []
        for a, b in parts:
            height = a * math.sqrt(math.pi / b)
            height = math.sqrt(height) if len(parts) > 1 else height
            rows.append({k: height * math.exp(-(math.pi**2) * (k / ppd) ** 2 / b) for k in range(-reach, reach + 1)})
        norm = math.sqrt(sum(sum(r.values()) ** 2 for r in rows))
        for i, r in enumerate(rows):
            out[f"{name}{i}" if len(rows) > 1 else name] = {k: v / norm for k, v in r.items()}
    return out


def feature_taps(ppd: float) -> dict[str, Taps]:
    """A Gaussian and its first two derivatives, of which positive and negative weights add up to one each."""
    sd = 0.5 * FEATURE_WIDTH * ppd
    reach = range(-math.ceil(3 * sd), math.ceil(3 * sd) + 1)
    g = {k: math.exp(-k * k / (2 * sd * sd)) for k in reach}
    out = {"g": {k: v / sum(g.values()) for k, v in g.items()}}
    for name, curve in (("d", lambda k: -k), ("dd", lambda k: k * k / (sd * sd) - 1)):
        raw = {k: curve(k) * v for k, v in g.items()}
        up, down = sum(v for v in raw.values() if v > 0), -sum(v for v in raw.values() if v < 0)
        out[name] = {k: v / (up if v >= 0 else down) for k, v in raw.items()}
    return out


def _pass(df: DataFrame, axis: str, lo: int, hi: int, keys: list[str], responses: dict[str, tuple[Taps, str]], kept: tuple[str, ...] = ()) -> DataFrame:
    """One exchange for all responses (taps, column) along an axis; kept columns stay with their pixel."""
    reach = max(max(map(abs, taps)) for taps, _ in responses.values())
    rows = _spread(df, axis, lo, hi, range(-reach, reach + 1), True)
    values = []
    for name, (taps, column) in responses.items():
        values.append(F.sum(_weight(axis, {o: taps.get(o, 0.0) for o in range(-reach, reach + 1)}) * F.col(column)).alias(name))
    return rows.groupBy(*keys).agg(*values, *[F.max(F.when(F.col(f"d{axis}") == 0, F.col(c))).alias(c) for c in kept])


def _both(a: Image, b: Image) -> tuple[DataFrame, Roi]:
    """r0, r1, r2 and t0, t1, t2 of all pixels of the two windows' union."""
    df, va, vb, spec = joined(a, b)
    every = Image(df.select(*KEYS, *[v.alias(f"c{i}") for i, v in enumerate([*va[:3], *vb[:3]])]), Spec(spec.data, spec.full, tuple("rgbstu"))).dense()
    return every.df.select(*KEYS, *[c.alias(f"{'rt'[i // 3]}{i % 3}") for i, c in enumerate(every.c)]), spec.data


def _ldr(df: DataFrame, d: Roi, keys: list[str], ppd: float) -> DataFrame:
    """keys and flip, for linear Rec.709 values in r0, ... and t0, ..., which are cut to 0 to 1."""
    spatial, feature = sensitivity_taps(ppd), feature_taps(ppd)
    opponent = {s: _opponent([_unit(F.col(f"{s}{i}")) for i in range(3)]) for s in "rt"}
    seen = df.select(*keys, *[v.alias(f"{s}_{n}") for s, c in opponent.items() for n, v in zip(("y", "cx", "cz"), c, strict=True)], *[((c[0] + 16) / 116).alias(f"{s}_l") for s, c in opponent.items()])
    source = {"y": "y", "cx": "cx", "cz0": "cz", "cz1": "cz"}
    across = {f"{s}_{n}": (spatial[n], f"{s}_{source[n]}") for s in "rt" for n in source} | {f"{s}_f{n}": (feature[n], f"{s}_l") for s in "rt" for n in feature}
    down = {f"{s}_{n}": (spatial[n], f"{s}_{n}") for s in "rt" for n in source}
    for s in "rt":
        down |= {f"{s}_{out}": (feature[taps], f"{s}_f{of}") for out, taps, of in (("dx", "g", "d"), ("ddx", "g", "dd"), ("dy", "d", "g"), ("ddy", "dd", "g"))}
    rows = _pass(_pass(seen, "x", d.x0, d.x1, keys, across), "y", d.y0, d.y1, keys, down)
    lab = {s: _hunt_lab(_from_opponent([F.col(f"{s}_y"), F.col(f"{s}_cx"), F.col(f"{s}_cz0") + F.col(f"{s}_cz1")])) for s in "rt"}
    rows = rows.select(*keys, *[v.alias(f"{s}_lab{i}") for s, c in lab.items() for i, v in enumerate(c)], *[F.hypot(f"{s}_{p}x", f"{s}_{p}y").alias(f"{s}_{n}") for s in "rt" for n, p in (("edge", "d"), ("point", "dd"))])
    gap = [F.col(f"r_lab{i}") - F.col(f"t_lab{i}") for i in range(3)]
    most = _farthest()
    color = F.pow(F.abs(gap[0]) + F.hypot(gap[1], gap[2]), F.lit(COLOR_EXPONENT))
    knee = KNEE_AT * most
    color = F.when(color < knee, color * (KNEE / knee)).otherwise(KNEE + (color - knee) / (most - knee) * (1 - KNEE))
    features = F.greatest(*[F.abs(F.col(f"r_{n}") - F.col(f"t_{n}")) for n in ("edge", "point")]) / math.sqrt(2)
    return rows.select(*keys, F.pow(color, 1 - F.pow(features, F.lit(FEATURE_EXPONENT))).alias("flip"))


def exposure_range(tone: str, most: Column | float, median: Column | float) -> tuple[Column, Column]:
    """First and last stop: those that bring the largest and the median luminance to 0.85 of the tone curve."""
    t = TONES[tone]
    a, b, c = (t[i] - 0.85 * t[i + 3] for i in range(3))
    x = -c / b if a == 0 else -0.5 * b / a + math.sqrt((0.5 * b / a) ** 2 - c / a)
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.log2(x / lit(most)), F.log2(x / lit(median))


def _toned(c: Triple, tone: str) -> Triple:
    if tone == "reinhard":
        lum = total([k * v for k, v in zip(LUMINANCE, c, strict=True)])
        return [_unit(v / (1 + lum)) for v in c]
    t = TONES[tone]
    curve = lambda v: (v * v * t[3] + v * t[4] + t[5], v * v * t[0] + v * t[1] + t[2])
    return [_unit(F.when(curve(v)[0] > 0, curve(v)[1] / curve(v)[0]).otherwise(0.0)) for v in c]


@dataclass(frozen=True)
class Exposures:
    """How an HDR comparison chooses its stops: start and stop as given, else from the luminances.

    A most of 0 or less takes the largest and the median luminance of each
    reference image; the median holds an image's distinct luminances in one task.
    """

    tone: str = "aces"
    most: float = 2.0
    median: float = 0.18
    start: float | None = None
    stop: float | None = None
    count: int = 0


def flip_diff(reference: Image, test: Image, ppd: float = PIXELS_PER_DEGREE, hdr: Exposures | None = Exposures()) -> Image:
    """The error map, of channels flip and exposure; hdr None compares values from 0 to 1 as they are.

    The first three channels are linear Rec.709.  With exposures the error is the
    largest of all stops, and exposure the first stop that has it, from 0 to 1.
    Pixels of the union of both windows count, those without a row as zero.
    """
    df, d = _both(reference, test)
    out = Spec(d, d, ("flip", "exposure"))
    if hdr is None:
        return Image(_ldr(df, d, KEYS, ppd).select(*KEYS, F.col("flip").alias("c0"), F.lit(0.0).alias("c1")), out, True)
    if hdr.most > 0 or hdr.start is not None and hdr.stop is not None:
        first, last = exposure_range(hdr.tone, max(hdr.most, 1e-30), hdr.median)
        df = df.withColumns({"first": first, "last": last})
    else:
        lum = total([k * F.col(f"r{i}") for i, k in enumerate(LUMINANCE)])
        of = df.withColumn("lum", lum).groupBy("image_id").agg(F.max("lum").alias("most"), F.expr("percentile_disc(0.5) within group (order by lum desc)").alias("middle"))
        first, last = exposure_range(hdr.tone, F.col("most"), F.greatest("middle", F.lit(2.0**-23)))
        df = df.join(of.select("image_id", first.alias("first"), last.alias("last")), "image_id")
    for name, given in (("first", hdr.start), ("last", hdr.stop)):
        if given is not None:
            df = df.withColumn(name, F.lit(float(given)))
    count = F.lit(hdr.count) if hdr.count > 0 else F.greatest(F.lit(2), F.ceil(F.col("last") - F.col("first"))).cast("int")
    checked = F.when(F.col("first") <= F.col("last"), count).otherwise(F.raise_error(F.lit("the first exposure lies after the last")).cast("int"))
    rows = df.withColumn("n", checked).withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    share = F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0)
    gain = F.pow(F.lit(2.0), F.col("first") + share * (F.col("last") - F.col("first")))
    toned = {s: _toned([F.col(f"{s}{i}") * F.col("gain") for i in range(3)], hdr.tone) for s in "rt"}
    rows = rows.withColumns({"gain": gain, "share": share}).select(*KEYS, "share", *[v.alias(f"{s}{i}") for s, c in toned.items() for i, v in enumerate(c)])
    flips = _ldr(rows, d, [*KEYS, "share"], ppd)
    best = flips.groupBy(*KEYS).agg(F.max(F.struct("flip", (-F.col("share")).alias("back"))).alias("m"))
    return Image(best.select(*KEYS, F.col("m.flip").alias("c0"), F.when(F.col("m.flip") > 0, -F.col("m.back")).otherwise(0.0).alias("c1")), out, True)


def flip_results(flip: Image) -> DataFrame:
    """Of each image mean_error, max_error, and max_x, max_y of the first pixel that has it; errors below 1e-6 are 0."""
    first = F.struct(-F.col("c0"), "y", "x")
    rows = flip.df.groupBy("image_id").agg(F.avg("c0").alias("mean"), F.max("c0").alias("most"), F.min(first).alias("at"))
    small = lambda c: F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.col(c))
    return rows.select("image_id", small("mean").alias("mean_error"), small("most").alias("max_error"), F.col("at.x").alias("max_x"), F.col("at.y").alias("max_y"))


# Fixed values of the contrast comparison: Adobe RGB to XYZ; levels of the pyramid.
ADOBE = ((0.5767, 0.185556, 0.188212), (0.297361, 0.627355, 0.0752847), (0.0270328, 0.0706879, 0.991248))
LEVELS = 8


def _contrast_sensitivity(cpd: float, luminance: Column) -> Column:
    a = 440 * F.pow(1 + 0.7 / luminance, F.lit(-0.2))
    b = 0.3 * F.pow(1 + 100 / luminance, F.lit(0.15))
    return a * cpd * F.exp(-b * cpd) * F.sqrt(1 + 0.06 * F.exp(b * cpd))


def _threshold(adaptation: Column) -> Column:
    """Threshold of visible luminance steps against intensity."""
    v = F.log10(adaptation)
    r = (
        F.when(v < -3.94, -2.86)
        .when(v < -1.44, F.pow(0.405 * v + 1.6, F.lit(2.18)) - 2.86)
        .when(v < -0.0184, v - 0.395)
        .when(v < 1.9, F.pow(0.249 * v + 0.65, F.lit(2.7)) - 0.72)
        .otherwise(v - 1.255)
    )
    return F.pow(F.lit(10.0), r)


def visible_differences(a: Image, b: Image, luminance: float = 100.0, fov: float = 45.0) -> Image:
    """factor (how far above threshold a difference must be) and fails (0 or 1) of each pixel of both windows' union.

    Blurred luminances of all levels are columns of the pixel's row, two exchanges
    a level, so no level is computed twice and none is joined.
    """
    df, d = _both(a, b)
    xyz = {s: _mixed(ADOBE, [F.col(f"{s}{i}") for i in range(3)]) for s in "rt"}
    white = [sum(row) for row in ADOBE]
    eps, kappa = 216 / 24389, 24389 / 27
    curve = lambda v: F.when(v > eps, F.cbrt(v)).otherwise((kappa * v + 16) / 116)
    f = {s: [curve(v / w) for v, w in zip(c, white, strict=True)] for s, c in xyz.items()}
    hue = [(500 * (f["r"][0] - f["r"][1])) - (500 * (f["t"][0] - f["t"][1])), (200 * (f["r"][1] - f["r"][2])) - (200 * (f["t"][1] - f["t"][2]))]
    rows = df.select(*KEYS, *[(luminance * xyz[s][1]).alias(f"{s}_0") for s in "rt"], (hue[0] * hue[0] + hue[1] * hue[1]).alias("hue"))
    taps = {k[0]: v for k, v in filters.kernel("gaussian", 5, 1).items() if k[1] == 0}
    norm = sum(taps.values())
    taps = {k: v / norm for k, v in taps.items()}
    for level in range(1, LEVELS):
        kept = ("hue", *(f"{s}_{i}" for s in "rt" for i in range(level)))
        rows = _pass(rows, "x", d.x0, d.x1, KEYS, {f"{s}_{level}": (taps, f"{s}_{level - 1}") for s in "rt"}, kept)
        rows = _pass(rows, "y", d.y0, d.y1, KEYS, {f"{s}_{level}": (taps, f"{s}_{level}") for s in "rt"}, kept)
    degrees = 2 * math.tan(math.radians(fov * 0.5)) * 180 / math.pi
    at_level = max((i for i in range(LEVELS) if 2**i <= degrees), default=0)
    cpd = [0.5 * d.width / degrees / 2**i for i in range(LEVELS)]
    value = lambda s, i: F.col(f"{s}_{i}")
    contrast = []
    for i in range(LEVELS - 2):
        step = F.greatest(*[F.abs(value(s, i) - value(s, i + 1)) for s in "rt"])
        contrast.append(step / F.greatest(*[F.abs(value(s, i + 2)) for s in "rt"], F.lit(1e-5)))
    adapt = F.greatest((value("r", at_level) + value("t", at_level)) / 2, F.lit(1e-5))
    rows = rows.select(*KEYS, "hue", F.abs(value("r", 0) - value("t", 0)).alias("step"), adapt.alias("adapt"), *[c.alias(f"k{i}") for i, c in enumerate(contrast)])
    best = _contrast_sensitivity(3.248, F.lit(100.0))
    parts = []
    for i in range(LEVELS - 2):
        base = F.pow(0.0153 * F.pow(392.498 * F.col(f"k{i}") * _contrast_sensitivity(cpd[i], F.col("adapt")), F.lit(0.7)), F.lit(4.0))
        parts.append(F.col(f"k{i}") * (best / _contrast_sensitivity(cpd[i], F.lit(100.0))) * F.pow(1 + base, F.lit(0.25)))
    sums = F.greatest(total([F.col(f"k{i}") for i in range(LEVELS - 2)]), F.lit(1e-5))
    rows = rows.withColumn("factor", F.least(F.greatest(total(parts) / sums, F.lit(1.0)), F.lit(10.0)))
    scale = F.when(F.col("adapt") < 10, 0.01).otherwise(1.0)  # (1 - (10 - 1) / 10) squared
    fails = (F.col("step") / _threshold(F.col("adapt")) > F.col("factor")) | (F.col("hue") * scale > F.col("factor"))
    return Image(rows.select(*KEYS, F.col("factor").alias("c0"), fails.cast("double").alias("c1")), Spec(d, d, ("factor", "fails")), True)


def compare_yee(a: Image, b: Image, luminance: float = 100.0, fov: float = 45.0) -> DataFrame:
    """Of each image n_fail, max_error (the largest factor among failing pixels, else 0), and its first place from the window's corner."""
    shown = visible_differences(a, b, luminance, fov)
    d, bad = shown.spec.data, F.col("c1") > 0
    first = F.min(F.when(bad, F.struct(-F.col("c0"), "z", "y", "x"))).alias("at")
    rows = shown.df.groupBy("image_id").agg(F.count_if(bad).alias("n_fail"), F.max(F.when(bad, F.col("c0"))).alias("most"), first)
    return rows.select("image_id", "n_fail", F.coalesce("most", F.lit(0.0)).alias("max_error"), F.coalesce(F.col("at.x") - d.x0, F.lit(0)).alias("max_x"), F.coalesce(F.col("at.y") - d.y0 + (F.col("at.z") - d.z0) * d.height, F.lit(0)).alias("max_y"))
