"""Colour spaces as curves and 3x3 matrices: projections in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.core import Image, total
from lumenframe.operators.arithmetic import premult, unpremult

# Chromaticities of the primaries and white (x, y), of which the matrices follow.
D65 = (0.3127, 0.3290)
PRIMARIES = {
    "rec709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), D65),
    "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), D65),
    "p3d65": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), D65),
    "adobergb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), D65),
    "acescg": ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044), (0.32168, 0.33767)),
    "aces2065": ((0.7347, 0.2653), (0.0, 1.0), (0.0001, -0.0770), (0.32168, 0.33767)),
}


def _srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def _rec709_to_linear(v: Column) -> Column:
    return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))


def _linear_to_rec709(v: Column) -> Column:
    return F.when(v < 0.018, v * 4.5).otherwise(1.099 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(0.45)) - 0.099)


def _gamma(g: float):
    return lambda v: F.pow(F.greatest(v, F.lit(0.0)), F.lit(g))


def _same(v: Column) -> Column:
    return v


#: name: to linear, from linear, primaries.
SPACES = {
    "lin_rec709": (_same, _same, "rec709"),
    "srgb": (_srgb_to_linear, _linear_to_srgb, "rec709"),
    "rec709": (_rec709_to_linear, _linear_to_rec709, "rec709"),
    "g18_rec709": (_gamma(1.8), _gamma(1 / 1.8), "rec709"),
    "g22_rec709": (_gamma(2.2), _gamma(1 / 2.2), "rec709"),
    "g24_rec709": (_gamma(2.4), _gamma(1 / 2.4), "rec709"),
    "lin_rec2020": (_same, _same, "rec2020"),
    "lin_p3d65": (_same, _same, "p3d65"),
    "srgb_p3d65": (_srgb_to_linear, _linear_to_srgb, "p3d65"),
    "lin_adobergb": (_same, _same, "adobergb"),
    "adobergb": (_gamma(2.19921875), _gamma(1 / 2.19921875), "adobergb"),
    "acescg": (_same, _same, "acescg"),
    "aces2065_1": (_same, _same, "aces2065"),
}
ALIASES = {"linear": "lin_rec709", "scene_linear": "lin_rec709", "lin_srgb": "lin_rec709", "default": "srgb", "sRGB": "srgb", "srgb_rec709_scene": "srgb", "ACEScg": "acescg", "lin_ap1": "acescg", "lin_ap0": "aces2065_1"}


def resolve(name: str) -> str:
    name = ALIASES.get(name, ALIASES.get(name.lower(), name))
    if name.lower() in SPACES:
        return name.lower()
    raise ValueError(f"unknown colour space {name!r}")


def to_xyz(primaries: str) -> np.ndarray:
    """Columns are X, Y, Z of red, green and blue, scaled so that equal parts make white."""
    *rgb, white = PRIMARIES[primaries]
    xyz = lambda p: np.array([p[0] / p[1], 1.0, (1 - p[0] - p[1]) / p[1]])
    m = np.stack([np.array([p[0], p[1], 1 - p[0] - p[1]]) for p in rgb], 1)
    return m * np.linalg.solve(m, xyz(white))


def convert(a: Image, source: str, target: str, unpremultiply: bool = False) -> Image:
    src, dst = SPACES[resolve(source)], SPACES[resolve(target)]
    image = unpremult(a) if unpremultiply else a
    rgb = [src[0](c) for c in image.c[:3]]
    if src[2] != dst[2] and len(rgb) == 3:
        m = np.linalg.inv(to_xyz(dst[2])) @ to_xyz(src[2])
        rgb = [total([c * float(w) for c, w in zip(rgb, row, strict=True)]) for row in m]
    skip = image.spec.alpha
    out = [c if i == skip else dst[1](v) for i, (c, v) in enumerate(zip(image.c, rgb, strict=False))] + image.c[3:]
    result = image.with_channels(out, list(image.spec.names))
    return premult(result) if unpremultiply else result
