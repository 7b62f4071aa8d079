"""Filtered texture lookups by differentials, and environment lookups by direction.

Each query makes its own probes along the long axis of its footprint (as many as
the footprint asks for) on two pyramid levels, and each probe its texels.  Queries
are dealt by id once; coarse levels are sent to them, so their texels are added up
where they are made, and only texels of levels too large for that are shuffled.
The results' derivatives are sums over the same texels with other weights.

Arrays are never empty here; they are exploded with explode_outer, as the optimizer
would else derive a filter on an array's size and copy the array's whole
expression below all steps that made it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import BROADCAST_ROWS
from lumenframe.operators.texture import KEYS, bspline, dealt, latlong, met, wrapped

#: Footprints and derivatives are no smaller and no larger than this.
LEAST, MOST = 1e-8, 1000.0


@dataclass(frozen=True)
class Lookup:
    """Wrap modes black, clamp, periodic, mirror, periodicpow2 and periodicsharedborder; mip aniso, trilinear, onelevel or none; interp closest, bilinear or bicubic.

    channels beyond those of the texture are fill, as far as a lookup lies inside.
    missing is the result where there is no such texture; without it that is fill.
    """

    wrap_s: str = "black"
    wrap_t: str = "black"
    mip: str = "aniso"
    interp: str = "bilinear"
    anisotropic: int = 32
    conservative: bool = True
    width_s: float = 1.0
    width_t: float = 1.0
    blur_s: float = 0.0
    blur_t: float = 0.0
    fill: float = 0.0
    missing: tuple[float, ...] | None = None


def level_sizes(width: int, height: int) -> list[tuple[int, int]]:
    """Width and height of each pyramid level, down to one texel."""
    out = [(width, height)]
    while max(out[-1]) > 1:
        out.append((max(1, out[-1][0] // 2), max(1, out[-1][1] // 2)))
    return out


def _size(sizes: list[tuple[int, int]], axis: int, level: str = "mip") -> Column:
    return F.get(F.array(*[F.lit(s[axis]) for s in sizes]), F.col(level))


def _at(coordinate: Column, n: Column, mode: str) -> Column:
    if mode == "periodicsharedborder":  # the first and the last column are the same place
        return F.pmod(coordinate, F.greatest(n, F.lit(2)) - 1)
    return wrapped(coordinate, n, "periodic" if mode == "periodicpow2" else mode)


def _scaled(df: DataFrame, o: Lookup) -> DataFrame:
    """Derivatives times the widths; where both lengths of a direction vanish, a tiny one stands for it, square to the other."""
    df = df.withColumns({"dsdx": F.col("dsdx") * o.width_s, "dtdx": F.col("dtdx") * o.width_t, "dsdy": F.col("dsdy") * o.width_s, "dtdy": F.col("dtdy") * o.width_t})
    lx, ly = F.hypot("dsdx", "dtdx"), F.hypot("dsdy", "dtdy")
    no_x, no_y = lx < LEAST, ly < LEAST
    tiny = lambda mine, other, both, value, old: F.when(mine & other, both).when(mine, value).otherwise(old)
    return df.select(
        *[c for c in df.columns if c not in ("dsdx", "dtdx", "dsdy", "dtdy")],
        tiny(no_x, no_y, LEAST, F.col("dtdy") * LEAST / ly, F.col("dsdx")).alias("dsdx"),
        tiny(no_x, no_y, 0.0, -F.col("dsdy") * LEAST / ly, F.col("dtdx")).alias("dtdx"),
        tiny(no_y, no_x, 0.0, -F.col("dtdx") * LEAST / lx, F.col("dsdy")).alias("dsdy"),
        tiny(no_y, no_x, LEAST, F.col("dsdx") * LEAST / lx, F.col("dtdy")).alias("dtdy"),
    )


def _ellipse(df: DataFrame, o: Lookup) -> DataFrame:
    """major, minor and theta of the ellipse that the derivatives span, widened by the blur."""
    a = F.col("dtdx") * F.col("dtdx") + F.col("dtdy") * F.col("dtdy")
    b = -2 * (F.col("dsdx") * F.col("dtdx") + F.col("dsdy") * F.col("dtdy"))
    c = F.col("dsdx") * F.col("dsdx") + F.col("dsdy") * F.col("dsdy")
    root = F.hypot(a - c, b)
    area = F.abs(F.col("dsdx") * F.col("dtdy") - F.col("dsdy") * F.col("dtdx"))
    df = df.withColumns({"long": F.sqrt((a + c + root) / 2), "area": area, "theta": F.atan2(b, a - c) / 2 + math.pi / 2})
    # The product of the axes is the area: a difference of squares would lose a short axis beside a long one.
    df = df.withColumns({"major": F.least("long", F.lit(MOST)), "minor": F.least(F.col("area") / F.col("long"), F.lit(MOST))})
    if o.blur_s + o.blur_t:
        s2, c2 = F.pow(F.sin("theta"), F.lit(2.0)), F.pow(F.cos("theta"), F.lit(2.0))
        df = df.withColumns({"major": F.col("major") + F.sqrt(o.blur_s**2 * c2 + o.blur_t**2 * s2), "minor": F.col("minor") + F.sqrt(o.blur_s**2 * s2 + o.blur_t**2 * c2)})
        turned = F.col("minor") > F.col("major")
        df = df.withColumns({"major": F.greatest("major", "minor"), "minor": F.least("major", "minor"), "theta": F.when(turned, F.col("theta") + math.pi / 2).otherwise(F.col("theta"))})
    return df


def _aspect(df: DataFrame, o: Lookup) -> DataFrame:
    """aspect of the axes up to the limit; beyond it the axes move towards each other, or the long one is cut."""
    raw = F.least(F.greatest(F.try_divide("major", "minor"), F.lit(1.0)), F.lit(1e6))
    over = F.col("aspect") > o.anisotropic
    df = df.withColumn("aspect", F.when(F.col("minor") > 0, raw).otherwise(1e6))  # greatest() passes over a null
    if o.conservative:
        major = (F.col("major") + F.col("minor") * o.anisotropic) / 2
        df = df.withColumns({"major": F.when(over, major).otherwise(F.col("major")), "minor": F.when(over, major / o.anisotropic).otherwise(F.col("minor"))})
    else:
        df = df.withColumn("major", F.when(over, F.col("minor") * o.anisotropic).otherwise(F.col("major")))
    return df.withColumn("aspect", F.least("aspect", F.lit(float(o.anisotropic))))


def _levels(width_in_texels: list[Column], o: Lookup) -> Column:
    """low, high and blend: the first level whose texel is as wide as the footprint, and the one before."""
    n = len(width_in_texels)
    pair = lambda low, high, blend: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), blend.alias("blend"))
    none = F.lit(0.0)
    if o.mip == "none":
        return pair(0, 0, none)
    out = None
    for m, w in enumerate(width_in_texels):
        blend = F.least(F.greatest(2 * w - 1, F.lit(0.0)), F.lit(1.0))
        choice = pair(0, 0, none) if m == 0 else pair(m, m, none) if o.mip == "onelevel" else pair(m - 1, m, blend)
        out = F.when(w <= 1, choice) if out is None else out.when(w <= 1, choice)
    return out.otherwise(pair(n - 1, n - 1, none))


def _weights(f: Column, interp: str) -> tuple[list[tuple[int, Column]], list[Column]]:
    """(offset, weight) of the texels along an axis, and the weights' derivatives."""
    if interp == "closest":
        return [(0, F.lit(1.0))], [F.lit(0.0)]
    if interp == "bilinear":
        return [(0, 1 - f), (1, f)], [F.lit(-1.0), F.lit(1.0)]
    g = 1 - f
    return list(zip(range(-1, 3), bspline(f), strict=True)), [-g * g / 2, 1.5 * f * f - 2 * f, 2 * g - 1.5 * g * g, f * f / 2]


def _taps(probes: DataFrame, sizes: list[tuple[int, int]], o: Lookup, poles: int = 0) -> DataFrame:
    """Of probes (id, image_id, mip, s, t, w) the texels y, x with k, ks and kt: weights for the value and its derivatives.

    poles: rows -1 and -2 hold the means of the first and the last row of each level
    of at most so many texels a side; beside a pole, lookups fade to it.
    """
    nearest = o.interp == "closest"
    df = probes.withColumns({"lw": _size(sizes, 0), "lh": _size(sizes, 1)})
    df = df.withColumns({"px": F.col("s") * F.col("lw") - (0.0 if nearest else 0.5), "py": F.col("t") * F.col("lh") - (0.0 if nearest else 0.5)})
    df = df.withColumns({"x0": F.floor("px").cast("int"), "y0": F.floor("py").cast("int")}).withColumns({"fx": F.col("px") - F.col("x0"), "fy": F.col("py") - F.col("y0")})
    df = df.withColumn("pole", F.lit(None).cast("int")).withColumn("fade", F.lit(0.0))
    if poles:
        small = (F.col("lw") <= poles) & (F.col("lh") <= poles)
        tt = F.col("t") * F.col("lh")
        north, south = small & (tt < 1), small & (tt >= 1) & (tt > F.col("lh") - 1)
        share = F.when(north, 1 - tt).when(south, tt - F.floor(tt)).otherwise(0.0)
        share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        df = df.withColumns({"pole": F.when(north, -1).when(south, -2), "fade": share * share})
    # Each axis has its own columns, so that no tap computes them again.
    parts, numbers = {}, {}
    for axis, side, mode in (("x", "lw", o.wrap_s), ("y", "lh", o.wrap_t)):
        weights, slopes = _weights(F.col(f"f{axis}"), o.interp)
        numbers[axis] = range(len(weights))
        for k, ((i, w), d) in enumerate(zip(weights, slopes, strict=True)):
            parts |= {f"{axis}_{k}": _at(F.col(f"{axis}0") + i, F.col(side), mode).cast("int"), f"w{axis}_{k}": w, f"d{axis}_{k}": F.col(side) * d}
    df = df.withColumns(parts).withColumn("rest", F.col("w") * (1 - F.col("fade")))
    taps = [
        F.struct(
            F.col(f"x_{i}").alias("x"),
            F.col(f"y_{j}").alias("y"),
            (F.col("rest") * F.col(f"wx_{i}") * F.col(f"wy_{j}")).alias("k"),
            (F.col("rest") * F.col(f"dx_{i}") * F.col(f"wy_{j}")).alias("ks"),
            (F.col("rest") * F.col(f"wx_{i}") * F.col(f"dy_{j}")).alias("kt"),
        )
        for i in numbers["x"]
        for j in numbers["y"]
    ]
    every = F.array(*taps)
    if poles:
        zero = F.lit(0.0)
        pole = F.struct(F.lit(0).alias("x"), F.col("pole").alias("y"), (F.col("w") * F.col("fade")).alias("k"), zero.alias("ks"), zero.alias("kt"))
        every = F.when(F.col("pole").isNotNull(), F.concat(every, F.array(pole))).otherwise(every)
    return df.withColumn("tap", F.explode_outer(every)).select("id", "image_id", "mip", "tap.*")


def _known(queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """The queries of a texture that exists, dealt by id: each makes many rows, and all of them stay in its task until they are added up."""
    images = tiles.select("image_id").distinct()
    few = images.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return dealt(queries).join(F.broadcast(images) if few else images, "image_id", "left_semi")


def _summed(queries: DataFrame, taps: DataFrame, tiles: DataFrame, channels: int, o: Lookup, derivatives: bool) -> DataFrame:
    """A row for each query: c0, ..., and ds0, ... and dt0, ... if derivatives are asked for; taps are those of _known() queries."""
    own = [c for c in tiles.columns if c.startswith("c") and c[1:].isdigit()]
    have = min(len(own), channels)
    rows = met(taps, tiles.select(*KEYS, *own))
    zero = F.lit(0.0)
    sums = [F.sum(F.col("k") * F.coalesce(F.col(f"c{i}"), zero)).alias(f"_c{i}") for i in range(have)]
    # A texel beyond a black edge has no coordinate; one inside without a row is zero.
    sums.append(F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("k")).otherwise(zero)).alias("_inside"))
    if derivatives:
        sums += [F.sum(F.col(k) * F.coalesce(F.col(f"c{i}"), zero)).alias(f"_d{k[1]}{i}") for k in ("ks", "kt") for i in range(have)]
    found = rows.groupBy("id").agg(*sums)
    out = queries.select("id").join(found, "id", "left")
    there = F.col("_inside").isNotNull()
    gone = [*(o.missing or ()), *([o.fill] * channels)][:channels] if o.missing else [o.fill] * channels
    values = [F.when(there, F.col(f"_c{i}") if i < have else F.col("_inside") * o.fill).otherwise(float(gone[i])).alias(f"c{i}") for i in range(channels)]
    if derivatives:
        values += [(F.coalesce(F.col(f"_d{k}{i}"), zero) if i < have else zero).alias(f"d{k}{i}") for k in "st" for i in range(channels)]
    return out.select("id", *values)


def texture(tiles: DataFrame, queries: DataFrame, width: int, height: int, channels: int, options: Lookup = Lookup(), derivatives: bool = False) -> DataFrame:
    """queries (id, image_id, s, t, dsdx, dtdx, dsdy, dtdy) with c0, ... and on demand ds0, dt0, ...; ids are unique.

    tiles is the table of make_texture(), of textures of one size.  The ellipse of
    the derivatives gives the level by its short axis, and the number and the
    Gaussian weights of the probes along its long axis.
    """
    sizes = level_sizes(width, height)
    q = _scaled(_known(queries, tiles).select("id", "image_id", *[F.col(c).cast("double").alias(c) for c in ("s", "t", "dsdx", "dtdx", "dsdy", "dtdy")]), o := options)
    if o.mip in ("aniso", "onelevel"):
        q = _aspect(_ellipse(q, o), o)
        q = q.withColumn("level", _levels([F.col("minor") * min(s) for s in sizes], o))
        finest = (F.col("level.high") == 0) & (F.col("minor") * max(sizes[0]) < 0.5)
        q = q.withColumn("aspect", F.when(finest, F.least(F.greatest(F.col("major") * max(sizes[0]) * 2, F.lit(1.0)), F.lit(float(o.anisotropic)))).otherwise(F.col("aspect")))
        n = F.greatest(F.lit(1), F.floor(2 * F.col("aspect") - 1).cast("int"))
        length = 2 * (F.col("major") - F.col("minor"))
        q = q.withColumns({"n": n, "length": length, "reach": F.when(length > 0, F.col("major") / length).otherwise(0.0)})
        place = F.expr("transform(sequence(0, n - 1), i -> 2 * (i + 0.5D) / n - 1)")
        q = q.withColumn("places", F.when(F.col("n") == 1, F.array(F.lit(0.0))).otherwise(place))
        q = q.withColumn("raw", F.expr("transform(places, p -> if(n <= 2, 1D, exp(-2 * p * p * reach * reach)))"))
        q = q.withColumn("probes", F.expr("transform(places, (p, i) -> struct(p * length / 2 as p, raw[i] / aggregate(raw, 0D, (a, v) -> a + v) as pw))"))
        direction = (F.cos("theta"), F.sin("theta"))
    else:
        sf, tf = F.greatest(F.abs("dsdx"), F.abs("dsdy")), F.greatest(F.abs("dtdx"), F.abs("dtdy"))
        wide = (F.greatest(sf, tf) if o.conservative else F.least(sf, tf)) + max(o.blur_s, o.blur_t)
        q = q.withColumn("level", _levels([wide * min(s) for s in sizes], o))
        q = q.withColumn("probes", F.array(F.struct(F.lit(0.0).alias("p"), F.lit(1.0).alias("pw"))))
        direction = (F.lit(1.0), F.lit(0.0))
    q = q.withColumns({"cos": direction[0], "sin": direction[1]}).withColumn("probe", F.explode_outer("probes"))
    probes = _on_levels(q, F.col("s") + F.col("probe.p") * F.col("cos"), F.col("t") + F.col("probe.p") * F.col("sin"), F.col("probe.pw"))
    return _summed(queries, _taps(probes, sizes, o), tiles, channels, o, derivatives)


def _on_levels(q: DataFrame, s: Column, t: Column, w: Column) -> DataFrame:
    levels = F.array(F.struct(F.col("level.low").alias("mip"), (1 - F.col("level.blend")).alias("lw")), F.struct(F.col("level.high").alias("mip"), F.col("level.blend").alias("lw")))
    q = q.select("id", "image_id", s.alias("s"), t.alias("t"), w.alias("pw"), F.explode_outer(levels).alias("l"))
    return q.select("id", "image_id", "s", "t", F.col("l.mip").alias("mip"), (F.col("pw") * F.col("l.lw")).alias("w")).filter("w > 0")


def _unit(v: list[Column]) -> list[Column]:
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [F.when(length > 0, c / length).otherwise(0.0) for c in v]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_poles(tiles: DataFrame, sizes: list[tuple[int, int]], tile: int) -> DataFrame:
    """tiles and, for each level that fits one tile, rows -1 and -2: the means of its first and its last row."""
    own = [c for c in tiles.columns if c.startswith("c") and c[1:].isdigit()]
    h = _size(sizes, 1)
    small = [m for m, (w, hh) in enumerate(sizes) if w <= tile and hh <= tile]
    ends = tiles.filter(F.col("mip").isin(small)).select("image_id", "mip", "x", *own, F.explode(F.when(h == 1, F.array(F.lit(-1), F.lit(-2))).when(F.col("y") == 0, F.array(F.lit(-1))).when(F.col("y") == h - 1, F.array(F.lit(-2)))).alias("y"))
    width = _size(sizes, 0)
    means = ends.groupBy("image_id", "mip", "y").agg(*[(F.sum(c) / F.max(width)).alias(c) for c in own])
    return tiles.select("image_id", "mip", "y", "x", *own).unionByName(means.select("image_id", "mip", "y", F.lit(0).alias("x"), *own))


def environment(tiles: DataFrame, queries: DataFrame, width: int, height: int, channels: int, options: Lookup = Lookup(), derivatives: bool = False, tile: int = 64) -> DataFrame:
    """queries (id, image_id, rx, ry, rz and the differentials xx, xy, xz, yx, yy, yz of the direction) in a latitude-longitude map, y up.

    Across the seam the map goes on at its other side.  Beside a pole, lookups of
    the levels that fit one tile fade to the mean of the pole's row.
    """
    o = Lookup(**{**options.__dict__, "wrap_s": "periodic", "wrap_t": "clamp"})
    sizes = level_sizes(width, height)
    raw = [[F.col(c).cast("double") for c in names] for names in (("rx", "ry", "rz"), ("xx", "xy", "xz"), ("yx", "yy", "yz"))]
    r = _unit(raw[0])
    beside = [_unit([a + b for a, b in zip(raw[0], d, strict=True)]) for d in raw[1:]]
    angle = lambda d: F.greatest(F.acos(F.least(F.greatest(_dot(r, d), F.lit(-1.0)), F.lit(1.0))), F.lit(LEAST))
    q = _known(queries, tiles).select("id", "image_id", *[v.alias(f"r{i}") for i, v in enumerate(r)], *[v.alias(f"{n}{i}") for n, d in zip("ab", beside, strict=True) for i, v in enumerate(d)], (angle(beside[0]) * o.width_s + o.blur_s).alias("fx"), (angle(beside[1]) * o.width_t + o.blur_t).alias("fy"))
    first = F.col("fx") >= F.col("fy")
    q = q.withColumns({f"m{i}": F.when(first, F.col(f"a{i}")).otherwise(F.col(f"b{i}")) for i in range(3)} | {"major": F.greatest("fx", "fy"), "minor": F.least("fx", "fy")})
    if o.mip == "aniso":
        q = _aspect(q, o)
        q = q.withColumns({"n": F.greatest(F.lit(1), F.ceil(F.col("aspect") - 0.25).cast("int")), "wide": F.col("minor")})
    else:
        q = q.withColumns({"n": F.lit(1), "wide": F.col("major" if o.conservative else "minor")})
    q = q.withColumn("level", _levels([F.col("wide") * (h / math.pi) for _, h in sizes], o)).withColumn("i", F.explode_outer(F.expr("sequence(0, n - 1)")))
    q = q.withColumn("p", -0.5 + (F.col("i") + 0.5) / F.col("n"))
    s, t = latlong(*[F.col(f"r{i}") + F.col("p") * F.col(f"m{i}") for i in range(3)])
    probes = _on_levels(q, s, t, 1.0 / F.col("n"))
    return _summed(queries, _taps(probes, sizes, o, tile), with_poles(tiles, sizes, tile), channels, o, derivatives)


def texture_info(tiles: DataFrame) -> DataFrame:
    """Of each texture its resolution, number of levels and channels, and the mean colour, all from its rows."""
    own = [c for c in tiles.columns if c.startswith("c") and c[1:].isdigit()]
    finest = F.col("mip") == 0
    side = lambda c: F.max(F.when(finest, F.col(c)) + 1)
    rows = tiles.groupBy("image_id").agg(side("x").alias("width"), side("y").alias("height"), (F.max("mip") + 1).alias("levels"), *[F.sum(F.when(finest, F.col(c))).alias(c) for c in own])
    return rows.select("image_id", "width", "height", "levels", F.lit(len(own)).alias("channels"), *[(F.col(c) / (F.col("width") * F.col("height"))).alias(f"mean{c[1:]}") for c in own])


def texels(tiles: DataFrame, mip: int, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The texels of a window of one level; filters on level and tile reach the scan."""
    return tiles.filter((F.col("mip") == mip) & F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
