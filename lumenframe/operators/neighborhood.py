"""Stencils and resampling by pixels that send themselves to their targets.

Which target coordinates a source coordinate adds to, and how, is arithmetic, so
each pixel makes its own targets, an axis at a time; the targets are aggregated
with map-side partial sums: no theta join, no table of the window's size, no
window over a whole image in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, Spec, every, finite, small_table
from lumenframe.operators import filters
from lumenframe.operators.arithmetic import _made, add, over, sub
from lumenframe.session import shared_dir

Taps = list[tuple[int, int, int, float]]


def _spread(df: DataFrame, axis: str, lo: int, hi: int, offsets: range, clamp: bool) -> DataFrame:
    """A row for each target of a pixel: axis becomes the target, d<axis> the offset of the source.

    The target of a source is arithmetic, so each pixel makes its own.  With clamp, the
    border pixels stand for all beyond: they also reach the targets whose source is cut to them.
    """
    at, d = F.col(axis), F.col("d")
    inside = F.expr(f"transform(sequence({offsets.start}, {offsets.stop - 1}), o -> struct({axis} - o as t, o as d))")
    if clamp:
        # Of target t and offset o, t + o lies before lo or after hi - 1.
        before = F.expr(f"flatten(transform(sequence({lo}, {min(hi - 1, lo - offsets.start - 1)}), t -> transform(sequence({offsets.start}, {lo} - 1 - t), o -> struct(t as t, o as d))))") if offsets.start < 0 else None
        after = F.expr(f"flatten(transform(sequence({max(lo, hi - offsets.stop + 1)}, {hi - 1}), t -> transform(sequence({hi} - t, {offsets.stop - 1}), o -> struct(t as t, o as d))))") if offsets.stop > 1 else None
        none = F.expr("cast(array() as array<struct<t:int,d:int>>)")
        inside = F.concat(inside, *[F.when(at == end, more).otherwise(none) for end, more in ((lo, before), (hi - 1, after)) if more is not None])
    rows = df.withColumn("k", F.explode(inside)).drop(axis)
    out = rows.select("*", F.col("k.t").cast("int").alias(axis), F.col("k.d").cast("int").alias(f"d{axis}")).drop("k")
    return out.filter(F.col(axis).between(lo, hi - 1))


def _weight(axis: str, taps: dict[int, float]) -> Column:
    """The weight of each offset, as an expression."""
    lo, hi = min(taps), max(taps)
    return F.get(F.array(*[F.lit(float(taps.get(o, 0.0))) for o in range(lo, hi + 1)]), F.col(f"d{axis}") - lo)


def _window(a: Image, axis: str) -> tuple[int, int]:
    d = a.spec.data
    return (d.x0, d.x1) if axis == "x" else (d.y0, d.y1)


def _tapped(df: DataFrame, axis: str, taps: Taps) -> DataFrame:
    """A row for each tap of a table: axis becomes the target, w<axis> the weight."""
    table = small_table(df.sparkSession, taps, f"src int, dst int, d{axis} int, w{axis} double")
    return df.join(table, df[axis] == table["src"]).drop(axis, "src").withColumnRenamed("dst", axis)


def _stencil(a: Image, offsets_x: range, offsets_y: range, clamp: bool) -> DataFrame:
    return _spread(_spread(a.df, "x", *_window(a, "x"), offsets_x, clamp), "y", *_window(a, "y"), offsets_y, clamp)


def convolve(a: Image, kernel: dict[tuple[int, int], float], normalize: bool = True) -> Image:
    """Correlation with the kernel; beyond the data window its border pixels go on."""
    rx, ry = max(abs(k[0]) for k in kernel), max(abs(k[1]) for k in kernel)
    norm = sum(kernel.values()) if normalize else 1.0
    table = small_table(a.df.sparkSession, [(dx, dy, w / (norm or 1.0)) for (dx, dy), w in kernel.items() if w], "dx int, dy int, w double")
    rows = _stencil(a, range(-rx, rx + 1), range(-ry, ry + 1), True).join(table, ["dx", "dy"])
    return Image(rows.groupBy(*KEYS).agg(*[F.sum(F.col("w") * c).alias(f"c{i}") for i, c in enumerate(a.c)]), a.spec)


def separable(a: Image, row: dict[int, float], column: dict[int, float]) -> Image:
    """Two one-dimensional passes, which make 2 n rows of a pixel and not n * n."""
    out = a
    for axis, taps in (("x", row), ("y", column)):
        r = max(map(abs, taps))
        rows = _spread(out.df, axis, *_window(out, axis), range(-r, r + 1), True)
        out = Image(rows.groupBy(*KEYS).agg(*[F.sum(_weight(axis, taps) * c).alias(f"c{i}") for i, c in enumerate(out.c)]), a.spec)
    return out


def blur(a: Image, name: str = "gaussian", width: float = 3.0, height: float = 3.0) -> Image:
    if name in filters.RADIAL:
        return convolve(a, filters.kernel(name, width, height))
    axis = lambda w: {k[0]: v for k, v in filters.kernel(name, w, 1.0 if name != "binomial" else 1).items() if k[1] == 0}
    rows = [axis(w) for w in (width, height)]
    rows = [{k: v / sum(r.values()) for k, v in r.items()} for r in rows]
    return separable(a, *rows)


def laplacian(a: Image) -> Image:
    return convolve(a, filters.kernel("laplacian", 3, 3), False)


def _extreme(a: Image, width: int, height: int, f) -> Image:
    out = a
    for axis, size in (("x", width), ("y", height)):
        rows = _spread(out.df, axis, *_window(out, axis), range(-(size // 2), size - size // 2), False)
        out = Image(rows.groupBy(*KEYS).agg(*[f(c).alias(f"c{i}") for i, c in enumerate(out.c)]), a.spec)
    return out


def dilate(a: Image, width: int = 3, height: int = 3) -> Image:
    """Maximum over the neighbours inside the image, an axis at a time."""
    return _extreme(a.dense(), width, height, F.max)


def erode(a: Image, width: int = 3, height: int = 3) -> Image:
    return _extreme(a.dense(), width, height, F.min)


def median_filter(a: Image, width: int = 3, height: int = 3) -> Image:
    """Upper median of the neighbours inside the image; a target holds its width * height neighbours at once."""
    span = lambda n: range(-(n // 2), n - n // 2)
    rows = _stencil(a.dense(), span(width), span(height), False)
    middle = lambda c: F.expr(f"get(sort_array(collect_list({c})), cast(count({c}) div 2 as int))")
    return Image(rows.groupBy(*KEYS).agg(*[middle(f"c{i}").alias(f"c{i}") for i in range(a.spec.n)]), a.spec)


def unsharp_mask(a: Image, kernel: str = "gaussian", width: float = 3.0, contrast: float = 1.0, threshold: float = 0.0) -> Image:
    soft = median_filter(a, int(width), int(width)) if kernel == "median" else blur(a, kernel, width, width)
    diff = sub(a.dense(), soft)
    sharp = diff.with_channels([F.when(F.abs(c) > threshold, c * contrast).otherwise(0.0) for c in diff.c])
    return add(a.dense(), sharp)


def fix_non_finite(a: Image, mode: str = "box3") -> Image:
    """NaN and infinite values become 0, or the mean of the finite original values around; black and box3."""
    if mode == "none":
        return a
    if mode == "error":
        bad = [F.when(finite(c), c).otherwise(F.raise_error(F.lit("non-finite pixel")).cast("double")) for c in a.c]
        return a.with_channels(bad)
    if mode == "black":
        return a.with_channels([F.when(finite(c), c).otherwise(0.0) for c in a.c])
    broken = a.df.filter(~every([finite(c) for c in a.c]))
    rows = _stencil(a, range(-1, 2), range(-1, 2), False)
    # Only pixels with something to mend are looked up among the neighbours.
    means = rows.join(broken.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(*[F.avg(F.when(finite(c), c)).alias(f"m{i}") for i, c in enumerate(a.c)])
    df = a.df.join(means, KEYS, "left")
    return _made(df, [F.when(finite(c), c).otherwise(F.coalesce(f"m{i}", F.lit(0.0))) for i, c in enumerate(a.c)], a.spec)


def resize_taps(src0: int, srcn: int, full_src: tuple[int, int], dst0: int, dstn: int, full_dst: tuple[int, int], name: str, width: float | None = None) -> Taps:
    """(src, dst, 0, weight); the weights of a target add up to one, and coordinates beyond the window are its border."""
    f, default = filters.FILTERS[name]
    ratio = (full_dst[1] - full_dst[0]) / (full_src[1] - full_src[0])
    width = width or default
    scale = min(ratio, 1.0)
    radius = math.ceil(width / 2 / scale)
    taps: dict[tuple[int, int], float] = {}
    for dst in range(dst0, dst0 + dstn):
        s = full_src[0] + (dst - full_dst[0] + 0.5) / ratio
        i = math.floor(s)
        frac = s - i
        own = [(i + k, f(scale * (k - (frac - 0.5)), width)) for k in range(-radius, radius + 1)]
        norm = sum(w for _, w in own)
        for src, w in own:
            if w and norm:
                key = (min(max(src, src0), src0 + srcn - 1), dst)
                taps[key] = taps.get(key, 0.0) + w / norm
    return [(s, d, 0, w) for (s, d), w in taps.items()]


def _curve(name: str, x: Column, width: float) -> Column:
    """The filter's weight at x, by linear interpolation between TABLE points of one half: filters are even."""
    f, reach = filters.FILTERS[name][0], width / 2
    table = F.array(*[F.lit(float(f(k * reach / TABLE, width))) for k in range(TABLE + 1)])
    at = F.abs(x) * (TABLE / reach)
    k = F.least(F.floor(at).cast("int"), F.lit(TABLE - 1))
    return F.when(at <= TABLE, F.get(table, k) * (1 - (at - k)) + F.get(table, k + 1) * (at - k)).otherwise(0.0)


#: Targets of an axis up to which exact weights come from a plan-time table; beyond, rows would grow with the window.
TABLE_TARGETS, TABLE = 4096, 4096


def _resampled(a: Image, axis: str, lo: int, n: int, src: tuple[int, int], dst: int, name: str, width: float) -> DataFrame:
    """A row for each source and target of an axis, with w<axis>; a plan-time table if it is small, else from each pixel's own coordinate."""
    if dst <= TABLE_TARGETS and n <= TABLE_TARGETS:
        return _tapped(a, axis, resize_taps(lo, n, src, 0, dst, (0, dst), name, width))
    ratio = dst / (src[1] - src[0])
    scale = min(ratio, 1.0)
    radius = math.ceil(width / 2 / scale)
    at = F.col(axis)
    # Targets whose footprint has this pixel; border pixels stand for all beyond.
    first = F.when(at == lo, F.lit(0)).otherwise(F.greatest(F.floor((at - radius - 1 - src[0]) * ratio).cast("int") - 1, F.lit(0)))
    last = F.when(at == lo + n - 1, F.lit(dst - 1)).otherwise(F.least(F.ceil((at + radius + 2 - src[0]) * ratio).cast("int") + 1, F.lit(dst - 1)))
    rows = a.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))))
    s = src[0] + (F.col("t") + 0.5) / ratio
    i, frac = F.floor(s), s - F.floor(s)
    taps = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.struct(F.least(F.greatest(i + k, F.lit(lo)), F.lit(lo + n - 1)).alias("p"), _curve(name, scale * (k - (frac - 0.5)), width).alias("w")))
    rows = rows.withColumn("taps", taps)
    add = lambda c, what: F.aggregate("taps", F.lit(0.0), lambda acc, t: acc + what(t, c))
    norm, own = add(None, lambda t, _: t["w"]), add(at, lambda t, c: F.when(t["p"] == c, t["w"]).otherwise(0.0))
    rows = rows.withColumn(f"w{axis}", F.when(norm != 0, own / norm).otherwise(0.0)).filter(F.col(f"w{axis}") != 0)
    return rows.drop(axis, "taps").withColumnRenamed("t", axis)


def resize(a: Image, width: int, height: int, name: str = "", filter_width: float | None = None) -> Image:
    """Filtered resize between the display windows: a pass for each axis."""
    f, d = a.spec.full, a.spec.data
    if not name:
        name = "blackman-harris" if width > f.width or height > f.height else "lanczos3"
    full = Roi(0, width, 0, height)
    out, wide = a.df, filter_width or filters.FILTERS[name][1]
    for axis, lo, n, src, dst in (("x", d.x0, d.width, (f.x0, f.x1), width), ("y", d.y0, d.height, (f.y0, f.y1), height)):
        rows = _resampled(out, axis, lo, n, src, dst, name, wide)
        out = rows.groupBy(*KEYS).agg(*[F.sum(F.col(f"w{axis}") * c).alias(f"c{i}") for i, c in enumerate(a.c)])
    return Image(out, replace(a.spec, data=full, full=full))


def resample(a: Image, width: int, height: int, interpolate: bool = True) -> Image:
    """The nearest pixel, or two pixels of each axis in proportion: each source pixel finds the targets that take it."""
    f, d = a.spec.full, a.spec.data
    full = Roi(0, width, 0, height)
    out = a.df
    for axis, lo, hi, f0, fn, n in (("x", d.x0, d.x1, f.x0, f.width, width), ("y", d.y0, d.y1, f.y0, f.height, height)):
        at, t = F.col(axis), F.col("t")
        # Targets between those that the neighbours on either side belong to; border pixels stand for all beyond.
        first = F.when(at == lo, F.lit(0)).otherwise(F.greatest(F.floor((at - 1.5 - f0) * n / fn - 0.5).cast("int"), F.lit(0)))
        last = F.when(at == hi - 1, F.lit(n - 1)).otherwise(F.least(F.ceil((at + 1.5 - f0) * n / fn + 0.5).cast("int"), F.lit(n - 1)))
        rows = out.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))))
        s = f0 + (t + 0.5) * fn / n
        cut = lambda v, lo=lo, hi=hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi - 1))
        if interpolate:
            i = F.floor(s - 0.5)
            frac = s - 0.5 - i
            w = F.when(cut(i) == at, 1 - frac).otherwise(0.0) + F.when(cut(i + 1) == at, frac).otherwise(0.0)
        else:
            w = F.when(cut(F.floor(s)) == at, 1.0).otherwise(0.0)
        rows = rows.withColumn("w", w).filter("w > 0").drop(axis).withColumnRenamed("t", axis)
        out = rows.groupBy(*KEYS).agg(*[F.sum(F.col("w") * c).alias(f"c{i}") for i, c in enumerate(a.c)])
    return Image(out, replace(a.spec, data=full, full=full))


def fit(a: Image, width: int, height: int, name: str = "", fillmode: str = "letterbox") -> Image:
    """Resize that keeps the aspect, centred in width x height."""
    f = a.spec.full
    aspect = f.width / f.height
    by_width = fillmode == "width" or fillmode == "letterbox" and width / height <= aspect
    w, h = (width, max(1, round(width / aspect))) if by_width else (max(1, round(height * aspect)), height)
    dx, dy = (width - w) // 2, (height - h) // 2
    out = resize(a, w, h, name)
    return out.moved(F.col("x") + dx, F.col("y") + dy, Roi(dx, dx + w, dy, dy + h), Roi(0, width, 0, height))


Matrix = list[float]


def _inverse(m: Matrix) -> np.ndarray:
    return np.linalg.inv(np.array(m, float).reshape(3, 3))


def warp(a: Image, m: Matrix, name: str = "lanczos3", filter_width: float | None = None, roi: Roi | None = None) -> Image:
    """Projective warp by a row-vector 3x3 matrix: each target pixel's centre is mapped back and its source footprint filtered."""
    roi = roi or a.spec.data
    inv, (weight, default) = _inverse(m), filters.FILTERS[name]
    fw, spark, wide = filter_width or default, a.df.sparkSession, np.vectorize(weight, otypes=[float])
    # The footprints of the targets are a table of the output's size, made on the executors a scan line at a time.
    schema = "tx int, ty int, x int, y int, w double"

    def line(ty: int) -> pd.DataFrame:
        tx = np.arange(roi.x0, roi.x1)
        p = np.stack([tx + 0.5, np.full(len(tx), ty + 0.5), np.ones(len(tx))], 1)
        at = [(p + step) @ inv for step in ([0, 0, 0], [1, 0, 0], [0, 1, 0])]
        (s, t), (sx, tx_), (sy, ty_) = [(q[:, 0] / q[:, 2], q[:, 1] / q[:, 2]) for q in at]
        ds, dt = np.maximum(1, np.maximum(abs(sx - s), abs(sy - s))), np.maximum(1, np.maximum(abs(tx_ - t), abs(ty_ - t)))
        x0, x1 = np.floor(s - 0.5 * ds * fw).astype(int), np.ceil(s + 0.5 * ds * fw).astype(int)
        y0, y1 = np.floor(t - 0.5 * dt * fw).astype(int), np.ceil(t + 0.5 * dt * fw).astype(int)
        size = (x1 - x0) * (y1 - y0)
        own = np.repeat(np.arange(len(tx)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        y, x = y0[own] + k // (x1 - x0)[own], x0[own] + k % (x1 - x0)[own]
        w = wide((x + 0.5 - s[own]) / ds[own], fw) * wide((y + 0.5 - t[own]) / dt[own], fw) if len(own) else np.zeros(0)
        fine = w != 0
        return pd.DataFrame({"tx": tx[own[fine]], "ty": ty, "x": x[fine], "y": y[fine], "w": w[fine]})

    def taps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ty in batch["y"]:
                yield line(ty)

    table = spark.range(roi.y0, roi.y1).select(F.col("id").cast("int").alias("y")).mapInPandas(taps, schema)
    norm = table.groupBy("tx", "ty").agg(F.sum("w").alias("norm"))
    summed = a.df.join(table, ["x", "y"]).groupBy("image_id", "z", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(*[F.sum(F.col("w") * c).alias(f"c{i}") for i, c in enumerate(a.c)])
    out = summed.join(norm.select(F.col("tx").alias("x"), F.col("ty").alias("y"), "norm"), ["x", "y"])
    values = [F.when(F.col("norm") > 0, c / F.col("norm")).otherwise(0.0) for c in a.c]
    return _made(out, values, replace(a.spec, data=roi))


def rotate(a: Image, angle: float, center: tuple[float, float] | None = None, name: str = "lanczos3") -> Image:
    """By radians about a point, by default the display window's centre."""
    f = a.spec.full
    cx, cy = center or ((f.x0 + f.x1) / 2, (f.y0 + f.y1) / 2)
    c, s = math.cos(angle), math.sin(angle)
    return warp(a, [c, s, 0, -s, c, 0, cx - c * cx + s * cy, cy - s * cx - c * cy, 1], name)


def st_warp(a: Image, st: Image, chan_s: int = 0, chan_t: int = 1, flip_s: bool = False, flip_t: bool = False) -> Image:
    """Bilinear sample of the source at each target pixel's (s, t) of the display window."""
    f = a.spec.full
    s, t = st.c[chan_s], st.c[chan_t]
    px = (1 - s if flip_s else s) * f.width + f.x0 - 0.5
    py = (1 - t if flip_t else t) * f.height + f.y0 - 0.5
    at = st.df.select("image_id", "z", F.col("x").alias("tx"), F.col("y").alias("ty"), px.alias("px"), py.alias("py"))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corners = F.array(*[F.struct((F.floor("px") + i).cast("int").alias("x"), (F.floor("py") + j).cast("int").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    taps = at.withColumn("k", F.explode(corners)).select("image_id", "z", "tx", "ty", "k.*").filter("w > 0")
    rows = taps.join(a.df, KEYS).groupBy("image_id", "z", F.col("ty").alias("y"), F.col("tx").alias("x"))
    return Image(rows.agg(*[F.sum(F.col("w") * c).alias(f"c{i}") for i, c in enumerate(a.c)]), replace(st.spec, names=a.spec.names, full=st.spec.data))


def pyramid(a: Image, name: str = "box") -> list[Image]:
    """Levels of half size each, down to one pixel; each, the first too, is written before the next is made of it, so that none is computed twice."""
    shared_dir(a.df.sparkSession)
    out = [replace(a, df=a.df.checkpoint())]
    while max(out[-1].spec.full.width, out[-1].spec.full.height) > 1:
        f = out[-1].spec.full
        level = resize(out[-1], max(1, f.width // 2), max(1, f.height // 2), name)
        out.append(replace(level, df=level.df.checkpoint()))
    return out


def fillholes_pushpull(a: Image) -> Image:
    """Transparent pixels get the colour of ever coarser levels beneath them."""
    def solid(i: Image) -> Image:
        al = i.c[i.spec.alpha]
        return i.with_channels([F.when(al > 0, c / F.when(al > 0, al)).otherwise(0.0) for c in i.c])

    levels = [a]
    while max(levels[-1].spec.full.width, levels[-1].spec.full.height) > 1:
        f = levels[-1].spec.full
        levels.append(solid(resize(levels[-1], max(1, f.width // 2), max(1, f.height // 2), "triangle")))
    out = levels[-1]
    for level in reversed(levels[:-1]):
        out = over(level, resize(out, level.spec.full.width, level.spec.full.height, "triangle"))
    return out


def _by_image(a: Image, f, n: int, names: list[str], spec: Spec | None = None) -> Image:
    """f(array of y, x, channel) for each image: for kernels that need all of an image at once."""
    d, m = a.spec.data, a.spec.n

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((d.height, d.width, m))
        full[rows["y"] - d.y0, rows["x"] - d.x0] = rows[[f"c{i}" for i in range(m)]].to_numpy()
        got = f(full)
        y, x = np.mgrid[0 : got.shape[0], 0 : got.shape[1]]
        out = pd.DataFrame({"image_id": key[0], "z": key[1], "y": y.ravel() + d.y0, "x": x.ravel() + d.x0})
        for i in range(n):
            out[f"c{i}"] = got[:, :, i].ravel()
        return out

    schema = "image_id string, z int, y int, x int, " + ", ".join(f"c{i} double" for i in range(n))
    return Image(a.df.groupBy("image_id", "z").applyInPandas(run, schema), replace(spec or a.spec, names=tuple(names)))


def fft(a: Image) -> Image:
    """Unitary transform of the first channel, to real and imaginary parts."""
    def run(v: np.ndarray) -> np.ndarray:
        g = np.fft.fft2(v[:, :, 0], norm="ortho")
        return np.stack([g.real, g.imag], 2)

    return _by_image(a, run, 2, ["real", "imag"])


def ifft(a: Image) -> Image:
    return _by_image(a, lambda v: np.fft.ifft2(v[:, :, 0] + 1j * v[:, :, 1], norm="ortho").real[:, :, None], 1, ["R"])


def mosaic_bayer(a: Image, layout: str = "RGGB") -> Image:
    """The one channel that a sensor has at each pixel."""
    d = a.spec.data
    at = F.pmod(F.col("y") - d.y0, F.lit(2)) * 2 + F.pmod(F.col("x") - d.x0, F.lit(2))
    v = a.c[2]
    for k, name in enumerate(layout):
        if name != "B":
            v = F.when(at == k, a.c["RGB".index(name)]).otherwise(v)
    return a.with_channels([v], ["Y"])


def demosaic(a: Image, layout: str = "RGGB", white_balance: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Image:
    """Bilinear: the mean of the nearest pixels that have the colour."""
    d = a.spec.data
    rows = _stencil(a.dense(), range(-1, 2), range(-1, 2), False)
    color = lambda x, y: F.pmod(y - d.y0, F.lit(2)) * 2 + F.pmod(x - d.x0, F.lit(2))
    here = color(F.col("x"), F.col("y"))
    there = color(F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    near = F.abs("dx") + F.abs("dy")
    out = []
    for k, name in enumerate("RGB"):
        places = [i for i, c in enumerate(layout) if c == name]
        mine = F.when(here.isin(places), own).otherwise(there.isin(places) & ((near == 1) if name == "G" else (near > 0)))
        out.append((F.avg(F.when(mine, F.col("c0"))) * white_balance[k]).alias(f"c{k}"))
    return Image(rows.groupBy(*KEYS).agg(*out), replace(a.spec, names=("R", "G", "B")))


def make_kernel(spark: SparkSession, name: str, width: float, height: float, normalize: bool = True) -> Image:
    k = filters.kernel(name, width, height, normalize)
    rx, ry = max(abs(p[0]) for p in k), max(abs(p[1]) for p in k)
    roi = Roi(-rx, rx + 1, -ry, ry + 1)
    df = spark.createDataFrame([("0", 0, y, x, float(w)) for (x, y), w in k.items()], "image_id string, z int, y int, x int, c0 double")
    return Image(df, Spec(roi, roi, ("Y",)))


def interp_bilinear(a: Image, points: DataFrame) -> DataFrame:
    """Samples at points (image_id, px, py in pixel coordinates), each for itself; beyond the data window is black."""
    at = points.select("image_id", F.lit(0).alias("z"), F.monotonically_increasing_id().alias("p"), (F.col("px") - 0.5).alias("sx"), (F.col("py") - 0.5).alias("sy"))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    corners = F.array(*[F.struct((F.floor("sx") + i).cast("int").alias("x"), (F.floor("sy") + j).cast("int").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    taps = at.withColumn("k", F.explode(corners)).select("p", "image_id", "z", "sx", "sy", "k.*")
    rows = taps.join(a.df, KEYS, "left").groupBy("p", "image_id", "sx", "sy")
    values = [F.coalesce(F.sum(F.col("w") * c), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(a.c)]
    return rows.agg(*values).select("image_id", (F.col("sx") + 0.5).alias("px"), (F.col("sy") + 0.5).alias("py"), *a.c)
