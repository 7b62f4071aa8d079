"""Single pixels and regions, metadata between images, and samples of deep pixels."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi
from lumenframe.operators.deep import FIELDS

#: Orientations whose stored rows are the columns of the picture.
TURNED = (5, 6, 7, 8)


def _wrapped(v: int, lo: int, hi: int, wrap: str) -> int | None:
    """A coordinate beyond the window by the wrap mode; None is black."""
    n = hi - lo
    if lo <= v < hi:
        return v
    if n <= 0 or wrap == "black":
        return None
    if wrap == "clamp":
        return min(max(v, lo), hi - 1)
    if wrap == "periodic":
        return (v - lo) % n + lo
    if wrap == "mirror":
        m = (v - lo) % (2 * n)
        return lo + (m if m < n else 2 * n - 1 - m)
    raise ValueError(f"unknown wrap mode {wrap!r}")


def getpixel(a: Image, x: int, y: int, z: int = 0, wrap: str = "black") -> DataFrame:
    """image_id and all channels of one pixel of each image; zero where there is none."""
    d = a.spec.data
    at = [_wrapped(v, lo, hi, wrap) for v, lo, hi in ((x, d.x0, d.x1), (y, d.y0, d.y1), (z, d.z0, d.z1))]
    ids = a.df.select("image_id").distinct()
    here = F.lit(False) if None in at else (F.col("x") == at[0]) & (F.col("y") == at[1]) & (F.col("z") == at[2])
    return ids.join(a.df.filter(here).select("image_id", *a.c), "image_id", "left").select("image_id", *[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(a.c)])


def getchannel(a: Image, x: int, y: int, z: int, channel: int, wrap: str = "black") -> DataFrame:
    return getpixel(a, x, y, z, wrap).select("image_id", F.col(f"c{channel}").alias("v"))


def setpixel(a: Image, x: int, y: int, values: list[float], z: int = 0) -> Image:
    """With these values in the first channels of one pixel; no change beyond the data window."""
    return set_pixels(a, Roi(x, x + 1, y, y + 1, z, z + 1), values)


def set_pixels(a: Image, roi: Roi, values: list) -> Image:
    """With these values (numbers, or columns of z, y and x) in the first channels of a region."""
    roi = roi.intersection(a.spec.data)
    own = [v if isinstance(v, Column) else F.lit(float(v)) for v in values[: a.spec.n]]
    whole = a.dense()
    return whole.within(roi, own + whole.c[len(own) :])


def _targets(v: Column, lo: int, hi: int, r0: int, r1: int, mode: str) -> Column:
    """The coordinates from r0 to r1 that show the source coordinate v of lo to hi: arithmetic, no table of the region."""
    none = F.expr("cast(array() as array<int>)")
    steps = lambda first, step: F.when(first < r1, F.sequence(first, F.lit(r1 - 1), F.lit(step))).otherwise(none)
    if mode == "black":
        return F.when((v >= r0) & (v < r1), F.array(v)).otherwise(none)
    if mode == "clamp":
        span = lambda x, y: F.sequence(F.lit(x), F.lit(y - 1)) if x < y else none
        own = F.when((v >= r0) & (v < r1), F.array(v)).otherwise(none)
        before = F.when(v == lo, span(r0, min(lo, r1))).otherwise(none)
        return F.concat(own, before, F.when(v == hi - 1, span(max(hi, r0), r1)).otherwise(none))
    n = hi - lo
    if mode == "periodic":
        return steps(F.lit(r0) + F.pmod(v - r0, F.lit(n)), n)
    there = F.lit(r0) + F.pmod(v - r0, F.lit(2 * n))
    back = F.lit(r0) + F.pmod(2 * hi - 1 - v - r0, F.lit(2 * n))
    return F.concat(steps(there, 2 * n), steps(back, 2 * n))


def get_pixels(a: Image, roi: Roi, wrap: str = "black") -> Image:
    """A region of each image, also beyond the data window, with a row for each pixel."""
    d = a.spec.data
    rows = a.df
    for axis, lo, hi, r0, r1 in (("x", d.x0, d.x1, roi.x0, roi.x1), ("y", d.y0, d.y1, roi.y0, roi.y1), ("z", d.z0, d.z1, roi.z0, roi.z1)):
        rows = rows.withColumn("to_", F.explode(_targets(F.col(axis), lo, hi, r0, r1, wrap))).drop(axis).withColumnRenamed("to_", axis)
    return Image(rows.select(*KEYS, *a.c), replace(a.spec, data=roi)).dense(a.df)


def contains_roi(a: Image, roi: Roi, chbegin: int = 0, chend: int | None = None) -> bool:
    """Whether the data window and the channels hold all of a region."""
    return roi.intersection(a.spec.data) == roi and 0 <= chbegin and (chend is None or chend <= a.spec.n)


def copy_metadata(a: Image, b: Image) -> Image:
    """a's pixels with b's attributes and display window."""
    return Image(a.df, replace(a.spec, attribs=dict(b.spec.attribs), full=b.spec.full), a.whole)


def merge_metadata(a: Image, b: Image, override: bool = False, pattern: str = "") -> Image:
    """a with those attributes of b whose name matches; its own stay, unless override."""
    more = {k: v for k, v in b.spec.attribs.items() if re.search(pattern, k, re.I) and (override or k not in a.spec.attribs)}
    return Image(a.df, replace(a.spec, attribs=a.spec.attribs | more), a.whole)


def oriented(a: Image) -> dict[str, int]:
    """The windows as the picture is to be seen: width and height change places in turned orientations."""
    turned = int(a.spec.attribs.get("Orientation", 1)) in TURNED
    d, f = a.spec.data, a.spec.full
    pair = lambda p, q: (q, p) if turned else (p, q)
    w, h = pair(d.width, d.height)
    fw, fh = pair(f.width, f.height)
    x, y = pair(d.x0, d.y0)
    fx, fy = pair(f.x0, f.y0)
    return {"width": w, "height": h, "x": x, "y": y, "full_width": fw, "full_height": fh, "full_x": fx, "full_y": fy}


def deep_value(deep: DataFrame, field: str, sample: int) -> DataFrame:
    """image_id, z, y, x and v: one field of a sample, 0 where a pixel has fewer."""
    return deep.select(*KEYS, F.coalesce(F.get("samples", F.lit(sample))[field], F.lit(0.0)).alias("v"))


def set_deep_value(deep: DataFrame, field: str, sample: int, value: Column | float) -> DataFrame:
    """With a value in one field of the samples of this number, where there are such."""
    v = value if isinstance(value, Column) else F.lit(float(value))
    changed = lambda s: F.struct(*[(v.cast("double") if k == field else s[k]).alias(k) for k in FIELDS])
    return deep.withColumn("samples", F.transform("samples", lambda s, i: F.when(i == sample, changed(s)).otherwise(s)))


def copy_deep_sample(deep: DataFrame, sample: int, source: DataFrame, from_sample: int) -> DataFrame:
    """With a sample of source's pixel in place of one of its own, or after the last; where source has that sample."""
    other = source.select(*KEYS, F.get("samples", F.lit(from_sample)).alias("new"))
    here = F.when(F.size("samples") > sample, F.transform("samples", lambda s, i: F.when(i == sample, F.col("new")).otherwise(s))).otherwise(F.concat("samples", F.array("new")))
    return deep.join(other, KEYS, "left").withColumn("samples", F.when(F.col("new").isNotNull(), here).otherwise(F.col("samples"))).drop("new")


def copy_deep_pixel(deep: DataFrame, source: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """With all samples of source's pixel dx, dy away, where it has one."""
    other = source.select("image_id", "z", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("samples").alias("new"))
    return deep.join(other, KEYS, "left").withColumn("samples", F.coalesce("new", "samples")).drop("new")
