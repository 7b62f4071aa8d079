"""Textures: a table of pyramid levels, and filtered lookups as joins with it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import BROADCAST_ROWS, Image, Spec
from lumenframe.operators import neighborhood

KEYS = ["image_id", "mip", "y", "x"]


def make_texture(a: Image, name: str = "box", tile: int = 64) -> DataFrame:
    """image_id, mip, ty, tx, y, x and channels of all levels, each half the size of the one before."""
    out = None
    for mip, level in enumerate(neighborhood.pyramid(a, name)):
        df = level.df.select("image_id", F.lit(mip).alias("mip"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), "y", "x", *level.c)
        out = df if out is None else out.unionByName(df)
    return out


def wrapped(at: Column, n: Column, mode: str) -> Column:
    """The texel for a coordinate beyond the edge; null where the mode is black."""
    if mode == "clamp":
        return F.least(F.greatest(at, F.lit(0)), n - 1)
    if mode == "periodic":
        return F.pmod(at, n)
    if mode == "mirror":
        m = F.pmod(at, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    return F.when((at >= 0) & (at < n), at)


def dealt(queries: DataFrame) -> DataFrame:
    """queries by id, in as many parts as a shuffle has: each makes many rows, which stay in its task until they are added up."""
    return queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def met(taps: DataFrame, texels: DataFrame) -> DataFrame:
    """taps, and beside each its texel or nulls.

    A coarse level has few texels, which most queries need, so a shuffle by texel would
    send nearly all taps to a few tasks.  The levels from the first one on that, with all
    coarser ones, has at most BROADCAST_ROWS texels are sent to the taps; only taps of finer levels go to the texels.
    """
    rows = {r["mip"]: r["count"] for r in texels.groupBy("mip").count().collect()}
    cut, total = max(rows, default=0) + 1, 0
    while cut > min(rows, default=cut) and total + rows.get(cut - 1, 0) <= BROADCAST_ROWS:
        cut -= 1
        total += rows.get(cut, 0)
    small = F.broadcast(texels.filter(F.col("mip") >= cut))
    if cut <= min(rows, default=cut):
        return taps.join(small, KEYS, "left")
    out = taps.filter(F.col("mip") < cut).join(texels.filter(F.col("mip") < cut), KEYS, "left")
    return out.unionByName(taps.filter(F.col("mip") >= cut).join(small, KEYS, "left"))


def texture(tiles: DataFrame, queries: DataFrame, width: int, height: int, channels: int, wrap: str = "clamp") -> DataFrame:
    """queries (id, image_id, s, t, footprint in texels of level 0) with c0, ...: bilinear on the two nearest levels, blended; ids are unique."""
    levels = int(math.log2(max(width, height))) if max(width, height) > 1 else 0
    level = F.least(F.greatest(F.log2(F.greatest("footprint", F.lit(1.0))), F.lit(0.0)), F.lit(float(levels)))
    low = F.floor(level).cast("int")
    at = dealt(queries).withColumn("m", F.explode(F.array(F.struct(low.alias("mip"), (1 - (level - low)).alias("wm")), F.struct(F.least(low + 1, F.lit(levels)).alias("mip"), (level - low).alias("wm"))))).select("id", "image_id", "s", "t", "m.mip", "m.wm").filter("wm > 0")
    w, h = (F.greatest(F.floor(F.lit(n) / F.expr("shiftleft(1, mip)")), F.lit(1)).cast("int") for n in (width, height))
    at = at.withColumns({"w": w, "h": h}).withColumns({"px": F.col("s") * F.col("w") - 0.5, "py": F.col("t") * F.col("h") - 0.5})
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corners = F.array(
        *[
            F.struct(wrapped((F.floor("px") + i).cast("int"), F.col("w"), wrap).alias("x"), wrapped((F.floor("py") + j).cast("int"), F.col("h"), wrap).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("k"))
            for i in (0, 1) for j in (0, 1)
        ]
    )
    taps = at.withColumn("c", F.explode(corners)).select("id", "image_id", "mip", "wm", "c.*")
    rows = met(taps, tiles.select(*KEYS, *[f"c{i}" for i in range(channels)])).groupBy("id")
    return rows.agg(*[F.sum(F.coalesce(F.col("wm") * F.col("k") * F.col(f"c{i}"), F.lit(0.0))).alias(f"c{i}") for i in range(channels)])


def latlong(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Texture coordinates of a direction, y up; NaN becomes 0."""
    s = F.atan2(-x, z) / (2 * math.pi) + 0.5
    t = 0.5 - F.atan2(y, F.hypot(z, x)) / math.pi
    return tuple(F.when(F.isnan(v), 0.0).otherwise(v) for v in (s, t))


def udim_tile(s: Column, t: Column) -> tuple[Column, Column, Column]:
    """Number of the tile of a grid of files, and the coordinates in it."""
    u, v = F.floor(s), F.floor(t)
    return (1001 + u + 10 * v).cast("int"), s - u, t - v


def bspline(f: Column) -> list[Column]:
    """Weights of four texels in a row for the fraction f between the middle ones."""
    cubed = lambda v: v * v * v
    return [cubed(1 - f) / 6, 2 / 3 - f * f * (2 - f) / 2, 2 / 3 - (1 - f) * (1 - f) * (1 + f) / 2, cubed(f) / 6]


def bicubic(a: Image, points: DataFrame) -> DataFrame:
    """Samples at points (id, image_id, px, py in pixels) by 16 B-spline taps; beyond the data window is its border; ids are unique."""
    d = a.spec.data
    at = points.select("id", "image_id", (F.col("px") - 0.5).alias("sx"), (F.col("py") - 0.5).alias("sy"))
    wx, wy = bspline(F.col("sx") - F.floor("sx")), bspline(F.col("sy") - F.floor("sy"))
    clamp = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi - 1)).cast("int")
    taps = F.array(*[F.struct(clamp(F.floor("sx") + i - 1, d.x0, d.x1).alias("x"), clamp(F.floor("sy") + j - 1, d.y0, d.y1).alias("y"), (wx[i] * wy[j]).alias("k")) for i in range(4) for j in range(4)])
    rows = at.withColumn("c", F.explode(taps)).select("id", "image_id", "c.*").join(a.df.drop("z"), ["image_id", "x", "y"], "left")
    return rows.groupBy("id").agg(*[F.sum(F.col("k") * F.coalesce(c, F.lit(0.0))).alias(f"c{i}") for i, c in enumerate(a.c)])


def texture3d(a: Image, points: DataFrame) -> DataFrame:
    """Trilinear samples of a volume at points (id, image_id, px, py, pz in voxels), eight taps each; beyond the window is black; ids are unique."""
    at = points.select("id", "image_id", *[(F.col(p) - 0.5).alias(s) for p, s in (("px", "sx"), ("py", "sy"), ("pz", "sz"))])
    part = {s: F.col(s) - F.floor(s) for s in ("sx", "sy", "sz")}
    side = lambda s, i: part[s] if i else 1 - part[s]
    cell = lambda s, i: (F.floor(s) + i).cast("int")
    taps = F.array(
        *[
            F.struct(cell("sx", i).alias("x"), cell("sy", j).alias("y"), cell("sz", k).alias("z"), (side("sx", i) * side("sy", j) * side("sz", k)).alias("k"))
            for i in (0, 1) for j in (0, 1) for k in (0, 1)
        ]
    )
    rows = at.withColumn("c", F.explode(taps)).select("id", "image_id", "c.*").join(a.df, ["image_id", "z", "y", "x"], "left")
    return rows.groupBy("id").agg(*[F.sum(F.col("k") * F.coalesce(c, F.lit(0.0))).alias(f"c{i}") for i, c in enumerate(a.c)])


# 3x3 weights of the slopes along s and their sum of one sign's weights times two; those along t are the transpose.
SLOPES = {"sobel": ((-1, 0, 1, -2, 0, 2, -1, 0, 1), 8.0), "centraldiff": ((0, 0, 0, -1, 0, 1, 0, 0, 0), 2.0)}
BUMP = ("b0_h", "b1_dhds", "b2_dhdt", "b3_dhds2", "b4_dhdt2", "b5_dh2dsdt")


def bump_slopes(a: Image, source: str = "height", kernel: str = "sobel", centered: bool = True, uv_scale: float = 0.0, scale: tuple[float, float] = (1.0, 1.0)) -> Image:
    """Height, its slopes along s and t, and their second moments: channels that a pyramid may average.

    From heights by a 3x3 kernel, beyond the border the border; from normals by
    their components, which lie about 0 (centered) or about 0.5; a normal without a
    third component has no slope.  With uv_scale the slopes of heights are of the
    whole image's width and height, divided by it, not of a pixel; scale multiplies
    the slopes along s and t.
    """
    d = a.spec.data
    if source == "normal":
        if a.spec.n < 3:
            raise ValueError("a normal map has three channels")
        whole = a.dense()
        n = [c - (0.0 if centered else 0.5) for c in whole.c[:3]]
        h, slopes, base = F.lit(-1.0), [F.coalesce(-F.try_divide(n[i], n[2]), F.lit(0.0)) for i in (0, 1)], whole.df
    elif source == "height":
        along, norm = SLOPES[kernel]
        at = (F.col("dy") + 1) * 3 + F.col("dx") + 1
        weight = lambda w: F.get(F.array(*[F.lit(v / norm) for v in w]), at)
        turned = [along[3 * x + y] for y in range(3) for x in range(3)]
        rows = neighborhood._stencil(a.dense(), range(-1, 2), range(-1, 2), True)
        middle = (F.col("dx") == 0) & (F.col("dy") == 0)
        sums = [F.sum(F.when(middle, F.col("c0"))).alias("h"), *[F.sum(weight(w) * F.col("c0")).alias(n) for w, n in ((along, "s"), (turned, "t"))]]
        base = rows.groupBy("image_id", "z", "y", "x").agg(*sums)
        h, slopes = F.col("h"), [F.col("s"), F.col("t")]
    else:
        raise ValueError(f"{source!r} is neither height nor normal")
    by = (d.width / uv_scale, d.height / uv_scale) if uv_scale and source == "height" else (1.0, 1.0)
    s, t = (v * (k * r) for v, k, r in zip(slopes, scale, by, strict=True))
    values = [h, s, t, s * s, t * t, s * t]
    df = base.select("image_id", "z", "y", "x", *[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)])
    return Image(df, Spec(d, a.spec.full, BUMP), True)
