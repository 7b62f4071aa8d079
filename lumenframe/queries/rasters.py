"""Queries of the raster operators over the driver's tables, each with SQL for the same result."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, grid, image
from lumenframe.functions import types as Y
from lumenframe.operators import access as X_
from lumenframe.operators import arithmetic as A
from lumenframe.operators import color as C
from lumenframe.operators import deep as D
from lumenframe.operators import filters
from lumenframe.operators import geometry as G
from lumenframe.operators import neighborhood as N
from lumenframe.operators import statistics as S
from lumenframe.operators import texture as X
from lumenframe.operators import userdefined as U
from lumenframe.session import ship
from lumenframe.sources import files as W
from lumenframe.streaming import windows as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> Image:
    """Each label is a sparse image of its vectors' first four components."""
    df = _table(spark, sf, "embeddings").select(
        F.col("label").alias("image_id"), F.expr("vec_id div 25").alias("y"), (F.col("vec_id") % 25).alias("x"), *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(4)]
    )
    rows = df.agg(F.max("y")).first()[0]
    return image(df, Roi(0, 25, 0, int(rows or 0) + 1), list("RGBA"))


_EMB = "as (select cast(label as varchar) as image_id, cast(vec_id // 25 as int) as y, cast(vec_id % 25 as int) as x, embedding[1]::double as c0, embedding[2]::double as c1, embedding[3]::double as c2, embedding[4]::double as c3 from embeddings)"
EMB = f"with a {_EMB}"
#: All pixels of the data window of each image.
DENSE = (
    f"with e {_EMB}, ids as (select distinct image_id from e), r as (select max(y) + 1 as n from e), lattice as (select image_id, cast(yy as int) as y, cast(xx as int) as x from ids, r, "
    "lateral (select unnest(range(0, r.n)) as yy), (select unnest(range(0, 25)) as xx)), a as (select image_id, y, x, " + ", ".join(f"coalesce(c{i}, 0) as c{i}" for i in range(4)) + " from lattice left join e using (image_id, y, x))"
)


def _li(spark: SparkSession, sf: str, flag: str) -> Image:
    """The returned lines are one image, all others the other."""
    mine = F.col("l_returnflag") == "R" if flag == "R" else F.col("l_returnflag") != "R"
    df = _table(spark, sf, "lineitem").filter(mine).groupBy(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")).agg(
        (F.sum("l_quantity") / 100).alias("c0"), (F.max("l_extendedprice") / 10000).alias("c1"), F.max("l_discount").alias("c2"), F.max("l_tax").alias("c3"), (F.sum("l_quantity") / (F.count("*") * 50)).alias("c4")
    )
    rows = _table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return image(df.withColumn("image_id", F.lit("0")), Roi(1, 8, 0, int(rows) + 1), ["R", "G", "B", "Z", "A"])


def _li_sql(name: str, flag: str) -> str:
    return (
        f"{name} as (select cast(l_orderkey as int) as y, cast(l_linenumber as int) as x, sum(l_quantity) / 100 as c0, max(l_extendedprice) / 10000 as c1, max(l_discount)::double as c2, max(l_tax)::double as c3, "
        f"sum(l_quantity) / (count(*) * 50) as c4 from lineitem where l_returnflag {'=' if flag == 'R' else '<>'} 'R' group by l_orderkey, l_linenumber)"
    )


LI = f"with {_li_sql('p', 'A')}, {_li_sql('q', 'R')}, a as (select '0' as image_id, coalesce(p.y, q.y) as y, coalesce(p.x, q.x) as x, " + ", ".join(f"coalesce(p.c{i}, 0) as a{i}, coalesce(q.c{i}, 0) as b{i}" for i in range(5)) + " from p full join q on p.y = q.y and p.x = q.x)"


def ev(spark: SparkSession, sf: str) -> Image:
    """Each event type is an image of days by hours: the sum of values, and the count."""
    df = _table(spark, sf, "events").groupBy(F.col("event_type").alias("image_id"), F.dayofyear("ts").alias("y"), F.hour("ts").alias("x")).agg(F.sum("value").alias("c0"), F.count("*").alias("c1"))
    r = df.agg(F.min("y"), F.max("y")).first()
    return image(df, Roi(0, 24, int(r[0]), int(r[1]) + 1), ["S", "N"])


EV = "with a as (select event_type as image_id, cast(dayofyear(ts) as int) as y, cast(hour(ts) as int) as x, sum(value) as c0, count(*)::double as c1 from events group by all), w as (select min(y) as y0, max(y) + 1 as y1 from a)"


LATTICE = (
    "ids as (select distinct image_id from a), lattice as (select image_id, cast(yy as int) as y, cast(xx as int) as x from ids, w, lateral (select unnest(range(w.y0, w.y1)) as yy), (select unnest(range(0, 24)) as xx)), "
    "d as (select image_id, y, x, coalesce(c0, 0) as c0, coalesce(c1, 0) as c1 from lattice left join a using (image_id, y, x))"
)


def shown(a: Image) -> DataFrame:
    """Rounded channels of the pixels that have a row."""
    return a.df.select("image_id", "y", "x", *[(F.round(c, 6) + 0.0).alias(f"c{i}") for i, c in enumerate(a.c)])


def _show_sql(values: list[str]) -> str:
    return "image_id, y, x, " + ", ".join(f"round({v}, 6) + 0.0 as c{i}" for i, v in enumerate(values))


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def unary(name: str, f: Callable[[Image], Image], values: Callable[[int], str] | list[str], dense: bool = False) -> None:
    """dense: the operator changes zero, so the result has all pixels of the window."""
    v = values if isinstance(values, list) else [values(i) for i in range(4)]
    register(name, lambda s, d: shown(f(emb(s, d))), f"{DENSE if dense else EMB} select {_show_sql(v)} from a")


def binary(name: str, f: Callable[[Image, Image], Image], values: Callable[[int], str]) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        out = f(_li(s, d, "A"), _li(s, d, "R"))
        return shown(out.with_channels([c + 1e-9 for c in out.c]))  # no tie is left to the engines' rounding

    register(name, query, f"{LI} select {_show_sql([f'{values(i)} + 1e-9' for i in range(5)])} from a")


K = [0.1, 0.2, 0.3, 0.4]
c = lambda i: f"c{i}"
color_only = lambda g: lambda i: g(i) if i < 3 else "c3"
clip = lambda v, lo, hi: f"least(greatest({v}, {lo}), {hi})"

# --- pixel arithmetic with constants
unary("addc", lambda a: A.add(a, K), lambda i: f"c{i} + {K[i]}", dense=True)
unary("subc", lambda a: A.sub(a, K), lambda i: f"c{i} - {K[i]}", dense=True)
unary("mulc", lambda a: A.mul(a, [2, 3]), lambda i: f"c{i} * {2 if i == 0 else 3}")
unary("divc", lambda a: A.div(a, [2.0, 0.0, 4.0]), lambda i: ["c0 / 2", "0.0", "c2 / 4", "c3 / 4"][i])
unary("absdiffc", lambda a: A.absdiff(a, K), lambda i: f"abs(c{i} - {K[i]})", dense=True)
unary("abs", A.absolute, lambda i: f"abs(c{i})")
unary("invert", A.invert, lambda i: f"1 - c{i}", dense=True)
unary("madc", lambda a: A.mad(a, K, [1.0, 0.5]), lambda i: f"c{i} * {K[i]} + {1.0 if i == 0 else 0.5}", dense=True)
unary("powc", lambda a: A.power(A.absolute(a), [2.0, 0.5]), lambda i: f"pow(abs(c{i}), {2.0 if i == 0 else 0.5})")
unary("maxc", lambda a: A.maximum(a, 0.05), lambda i: f"greatest(c{i}, 0.05)", dense=True)
unary("minc", lambda a: A.minimum(a, 0.05), lambda i: f"least(c{i}, 0.05)")
unary("clamp", lambda a: A.clamp(a, [-0.1, 0.0], [0.1, 0.2], True), lambda i: [clip("c0", -0.1, 0.1), clip("c1", "0.0", 0.2), clip("c2", "0.0", 0.2), clip(clip("c3", "0.0", 0.2), "0.0", "1.0")][i])
unary("chsum", lambda a: A.channel_sum(a, [0.5, 0.25, 0.125]), ["c0 * 0.5 + c1 * 0.25 + c2 * 0.125 + c3 * 0.125"])
unary("maxchan", A.maxchan, ["greatest(c0, c1, c2, c3)"])
unary("minchan", A.minchan, ["least(c0, c1, c2, c3)"])
LENGTH = "sqrt(c0 * c0 + c1 * c1 + c2 * c2)"
unary("normalize", lambda a: A.normalize(a, 0.0, 0.5, 0.5), color_only(lambda i: f"case when {LENGTH} = 0 then 0.5 else c{i} / {LENGTH} * 0.5 + 0.5 end"), dense=True)
unary("contrast", lambda a: A.contrast_remap(a, 0.1, 0.9, 0.0, 2.0), lambda i: f"(c{i} - 0.1) / 0.8 * 2.0", dense=True)
unary("contrast_threshold", lambda a: A.contrast_remap(a, 0.1, 0.1), lambda i: f"case when c{i} < 0.1 then 0.0 else 1.0 end")
SIG = lambda x: f"(1 / (1 + exp(5.0 * (0.5 - ({x})))))"
unary("contrast_sigmoid", lambda a: A.contrast_remap(a, 0.0, 1.0, 0.0, 1.0, 5.0, 0.5), lambda i: f"({SIG(f'c{i}')} - {SIG('0.0')}) / ({SIG('1.0')} - {SIG('0.0')})")
LUMA = "(c0 * 0.2126 + c1 * 0.7152 + c2 * 0.0722)"
unary("saturate", lambda a: A.saturate(a, 0.4), color_only(lambda i: f"{LUMA} * 0.6 + c{i} * 0.4"))
COMP = lambda v: f"case when abs({v}) <= 0.18 then {v} else sign({v}) * ({A.RANGE_A} + {A.RANGE_B} * ln(abs({A.RANGE_C} * abs({v}) + 1))) end"
EXPD = lambda v: f"case when abs({v}) <= 0.18 then {v} else sign({v}) * ((exp((abs({v}) - ({A.RANGE_A})) / {A.RANGE_B}) - 1) / {A.RANGE_C}) end"
unary("rangecompress", A.rangecompress, color_only(lambda i: COMP(f"c{i}")))
unary("rangeexpand", A.rangeexpand, color_only(lambda i: EXPD(f"c{i}")))
unary("premult", A.premult, color_only(lambda i: f"case when c3 = 1 then c{i} else c{i} * c3 end"))
unary("unpremult", A.unpremult, color_only(lambda i: f"case when c3 in (0, 1) then c{i} else c{i} / c3 end"))
unary("repremult", A.repremult, color_only(lambda i: f"case when c3 in (0, 1) then c{i} else c{i} * c3 end"))
unary("polar", lambda a: A.complex_to_polar(G.channels(a, [0, 1])), ["sqrt(c0 * c0 + c1 * c1)", "case when atan2(c1, c0) < 0 then atan2(c1, c0) + 6.283185307179586 else atan2(c1, c0) end"])
unary("unpolar", lambda a: A.polar_to_complex(G.channels(a, [0, 1])), ["c0 * cos(c1)", "c0 * sin(c1)"])
unary("colormap", lambda a: A.color_map(a, A.COLOR_MAPS["blue-red"], 0), [clip("c0", "0.0", "1.0"), "0.0", f"1 - {clip('c0', '0.0', '1.0')}"], dense=True)
M = [0.5, 0.1, 0.0, 0.0, 0.2, 0.5, 0.1, 0.0, 0.0, 0.2, 0.6, 0.0, 0.01, 0.02, 0.03, 1.0]
unary("ccmatrix", lambda a: A.color_matrix(a, M), lambda j: " + ".join(f"c{i} * {M[4 * i + j]}" for i in range(4)))
TO_LIN = lambda v: f"case when {v} <= 0.04045 then {v} / 12.92 else pow(({v} + 0.055) / 1.055, 2.4) end"
TO_SRGB = lambda v: f"case when {v} <= 0.0031308 then {v} * 12.92 else 1.055 * pow(greatest({v}, 0.0), 1 / 2.4) - 0.055 end"
unary("colorconvert_srgb_linear", lambda a: C.convert(a, "sRGB", "linear"), color_only(lambda i: TO_LIN(f"c{i}")))
unary("colorconvert_linear_srgb", lambda a: C.convert(a, "linear", "sRGB"), color_only(lambda i: TO_SRGB(f"c{i}")))

# --- two images
binary("add", A.add, lambda i: f"a{i} + b{i}")
binary("sub", A.sub, lambda i: f"a{i} - b{i}")
binary("mul", A.mul, lambda i: f"a{i} * b{i}")
binary("div", A.div, lambda i: f"(case when b{i} = 0 then 0.0 else a{i} / b{i} end)")
binary("absdiff", A.absdiff, lambda i: f"abs(a{i} - b{i})")
binary("max", A.maximum, lambda i: f"greatest(a{i}, b{i})")
binary("min", A.minimum, lambda i: f"least(a{i}, b{i})")
binary("mad", lambda a, b: A.mad(a, b, a), lambda i: f"a{i} * b{i} + a{i}")
binary("scale", lambda a, b: A.scale(a, G.channels(b, [0])), lambda i: f"a{i} * b0")
AL = clip("a4", "0.0", "1.0")
BL = clip("b4", "0.0", "1.0")
OVER = lambda i: f"(case when {AL} <> 0 then a3 else b3 end)" if i == 3 else f"a{i} + (1 - {AL}) * b{i}"
UNDER = lambda i: f"(case when {BL} <> 0 then b3 else a3 end)" if i == 3 else f"b{i} + (1 - {BL}) * a{i}"
binary("over", A.over, OVER)
binary("zover", A.zover, lambda i: f"(case when a3 <= b3 then {OVER(i)} else {UNDER(i)} end)")
register("chappend", lambda s, d: shown(G.channel_append(_li(s, d, "A"), G.channels(_li(s, d, "R"), [0, 1]))), f"{LI} select {_show_sql([f'a{i}' for i in range(5)] + ['b0', 'b1'])} from a")


# --- geometry
def geometry(name: str, f: Callable[[Image], Image], x: str, y: str, values: list[str] | None = None, where: str = "true", dense: bool = False) -> None:
    sql = f"{EV}, {LATTICE} select image_id, cast({y} as int) as y, cast({x} as int) as x, " + ", ".join(f"round({v}, 6) + 0.0 as c{i}" for i, v in enumerate(values or ["c0", "c1"])) + f" from {'d' if dense else 'a'}, w where {where}"
    register(name, lambda s, d: shown(f(ev(s, d))), sql)


geometry("flip", G.flip, "x", "y0 + y1 - 1 - y")
geometry("flop", G.flop, "23 - x", "y")
geometry("rotate180", G.rotate180, "23 - x", "y0 + y1 - 1 - y")
geometry("rotate90", G.rotate90, "y1 - 1 - y", "x")
geometry("rotate270", G.rotate270, "y", "23 - x")
geometry("transpose", G.transpose, "y", "x")
geometry("cshift", lambda a: G.circular_shift(a, 5, 3), "(x + 5) % 24", "(y - y0 + 3) % (y1 - y0) + y0")
geometry("crop", lambda a: G.crop(a, Roi(3, 9, 2, 20)), "x", "y", where="x between 3 and 8 and y between 2 and 19")
geometry("cut", lambda a: G.cut(a, Roi(3, 9, 2, 20)), "x - 3", "y - 2", where="x between 3 and 8 and y between 2 and 19")
geometry("ch", lambda a: G.channels(a, [1, -1, 0], [0, 0.5, 0], ["A", "B", "C"]), "x", "y", ["c1", "0.5", "c0"], dense=True)
geometry("reorient", lambda a: G.ORIENTATIONS[8](a), "y", "23 - x")
geometry("box", lambda a: G.render_box(a, 4, 3, 8, 9, [7.0, 8.0], True), "x", "y", [f"case when x between 4 and 8 and y between 3 and 9 then {v} else c{i} end" for i, v in enumerate((7.0, 8.0))], dense=True)
geometry("point", lambda a: G.render_point(a, 5, 6, [1.0, 2.0]), "x", "y", [f"case when x = 5 and y = 6 then {v} else c{i} end" for i, v in enumerate((1.0, 2.0))], dense=True)
geometry("line", lambda a: G.render_line(a, 2, 2, 12, 12, [1.0, 2.0]), "x", "y", [f"case when x = y and x between 2 and 12 then {v} else c{i} end" for i, v in enumerate((1.0, 2.0))], dense=True)
geometry("origin", lambda a: a.moved(F.col("x") + 10, F.col("y") - 4, a.spec.data.shifted(10, -4)), "x + 10", "y - 4")
register("getpixel", lambda s, d: X_.getpixel(ev(s, d), 29, 6, wrap="periodic").select("image_id", *[(F.round(f"c{i}", 6) + 0.0).alias(f"c{i}") for i in range(2)]), f"{EV}, {LATTICE} select image_id, round(c0, 6) + 0.0 as c0, round(c1, 6) + 0.0 as c1 from d where x = 5 and y = 6")
register("set_pixels", lambda s, d: shown(X_.set_pixels(ev(s, d), Roi(3, 7, 2, 9), [F.col("x") * 2.0])), f"{EV}, {LATTICE} select image_id, y, x, round(case when x between 3 and 6 and y between 2 and 8 then x * 2.0 else c0 end, 6) + 0.0 as c0, round(c1, 6) + 0.0 as c1 from d")
register("get_pixels", lambda s, d: shown(X_.get_pixels(ev(s, d), Roi(-5, 30, 4, 9), "mirror")), f"{EV}, {LATTICE}, o as (select unnest(range(-5, 30)) as x) select image_id, d.y, cast(o.x as int) as x, round(c0, 6) + 0.0 as c0, round(c1, 6) + 0.0 as c1 from o join d on d.x = (case when o.x < 0 then -1 - o.x when o.x > 23 then 47 - o.x else o.x end) where d.y between 4 and 8")
GRID = "select '0' as image_id, cast(y as int) as y, cast(x as int) as x, {v} from range({y0}, {y1}) s(y), range({x0}, {x1}) t(x)"


def pattern(name: str, f: Callable[[SparkSession], Image], roi: Roi, values: list[str]) -> None:
    v = ", ".join(f"round({e}, 6) + 0.0 as c{i}" for i, e in enumerate(values))
    register(name, lambda s, d: shown(f(s)), GRID.format(v=v, y0=roi.y0, y1=roi.y1, x0=roi.x0, x1=roi.x1))


R64, R32 = Roi(0, 64, 0, 64), Roi(-16, 48, 8, 40)
pattern("zero", lambda s: G.zero(s, R64), R64, ["0.0"] * 3)
pattern("fill_constant", lambda s: G.fill(s, R64, K), R64, list(map(str, K)))
pattern("fill_vertical", lambda s: G.fill(s, R64, [0, 0.5], [1, 0.25]), R64, ["y / 63.0", "(1 - y / 63.0) * 0.5 + y / 63.0 * 0.25"])
pattern("fill_corners", lambda s: G.fill(s, R64, [0], [1], [2], [4]), R64, ["(1 - y / 63.0) * (x / 63.0) + y / 63.0 * ((1 - x / 63.0) * 2 + x / 63.0 * 4)"])
pattern("checker", lambda s: G.checker(s, R32, 8, 4, 1, [0, 1], [1, 0], (3, 2, 0)), R32, [f"case when (cast(trunc((x - 3) / 8.0) as int) + cast(x < 3 as int) + cast(trunc((y - 2) / 4.0) as int) + cast(y < 2 as int)) & 1 = 1 then {p} else {q} end" for p, q in ((1.0, 0.0), (0.0, 1.0))])
register("noise_uniform", lambda s, d: shown(G.noise(G.zero(s, R64), "uniform", 0.25, 0.75)))
register("noise_gaussian", lambda s, d: shown(G.noise(G.zero(s, R64), "gaussian", 0.5, 0.1)))
register("noise_salt", lambda s, d: shown(G.noise(G.zero(s, R64), "salt", 1.0, 0.01, True)))
register("make_kernel_gaussian", lambda s, d: shown(N.make_kernel(s, "gaussian", 5, 5)))
LAP = "select '0' as image_id, y, x, c0 from (values (0, -1, 1.0), (0, 1, 1.0), (-1, 0, 1.0), (1, 0, 1.0), (0, 0, -4.0)) v(y, x, c0)"
register("make_kernel_laplacian", lambda s, d: shown(N.make_kernel(s, "laplacian", 3, 3)), LAP)
PASTED = Roi(0, 4, 5, 9)
register("paste", lambda s, d: shown(G.paste(G.fill(s, R64, [0.0, 1.0]), 2, 0, G.fill(s, PASTED, [9.0, 8.0]))), GRID.format(v=", ".join(f"case when x between 2 and 5 and y between 5 and 8 then {p} else {q} end as c{i}" for i, (p, q) in enumerate(((9.0, 0.0), (8.0, 1.0)))), y0=0, y1=64, x0=0, x1=64))
register("mosaic", lambda s, d: shown(G.mosaic([G.fill(s, R64, [k]) for k in (0.25, 0.5, 0.75)], 2)), "select '0' as image_id, cast(y as int) as y, cast(x as int) as x, case when y < 64 and x < 64 then 0.25 when y < 64 then 0.5 else 0.75 end as c0 from range(0, 128) s(y), range(0, 128) t(x) where y < 64 or x < 64")


# --- stencils and resampling, on the days-by-hours images
def stencil(name: str, f: Callable[[Image], Image], agg: Callable[[int], str], offsets: str, clamp: bool, dense: bool) -> None:
    """agg may use v<i> (a neighbour's channel), k (the kernel's weight), dx and dy."""
    src = "d" if dense else "a"
    grid = LATTICE
    at = "least(greatest({c} + {o}, {lo}), {hi} - 1)" if clamp else "{c} + {o}"
    sx, sy = at.format(c="l.x", o="o.dx", lo="0", hi="24"), at.format(c="l.y", o="o.dy", lo="w.y0", hi="w.y1")
    sql = f"{EV}, {grid}, o as (select * from (values {offsets}) v(dx, dy, k)) select l.image_id, l.y, l.x, " + ", ".join(f"round({agg(i)}, 6) + 0.0 as c{i}" for i in range(2)) + f" from lattice l, w, o join {src} s on s.image_id = l.image_id and s.x = {sx} and s.y = {sy} group by l.image_id, l.y, l.x"
    register(name, lambda s, d: shown(f(ev(s, d))), sql)


def offsets(w: int, h: int, k: dict | None = None) -> str:
    return ", ".join(f"({x}, {y}, {(k or {}).get((x, y), 1.0)!r}::double)" for y in range(-(h // 2), h - h // 2) for x in range(-(w // 2), w - w // 2))




def _bell(n: int) -> dict:
    """The Gaussian of n pixels by its formula, normalised."""
    r = range(-(n // 2), n // 2 + 1)
    out = {(x, y): math.exp(-8 * (x * x + y * y) / n**2) for x in r for y in r}
    return {k: v / sum(out.values()) for k, v in out.items()}


GAUSS = _bell(5)
LAPK = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0, (0, 0): -4.0}
weighted = lambda i: f"sum(k * s.c{i})"
stencil("convolve", lambda a: N.convolve(a, filters.kernel("gaussian", 5, 5)), weighted, offsets(5, 5, GAUSS), True, False)
stencil("blur", lambda a: N.blur(a, "gaussian", 5, 5), weighted, offsets(5, 5, GAUSS), True, False)
stencil("laplacian", N.laplacian, weighted, ", ".join(f"({x}, {y}, {v})" for (x, y), v in LAPK.items()), True, False)
stencil("median", lambda a: N.median_filter(a, 3, 3), lambda i: f"list_sort(list(s.c{i}))[cast(count(*) // 2 as int) + 1]", offsets(3, 3), False, True)
stencil("dilate", lambda a: N.dilate(a, 3, 5), lambda i: f"max(s.c{i})", offsets(3, 5), False, True)
stencil("erode", lambda a: N.erode(a, 5, 3), lambda i: f"min(s.c{i})", offsets(5, 3), False, True)
stencil("unsharp", lambda a: N.unsharp_mask(a, "gaussian", 3.0, 1.0, 0.0), lambda i: f"2 * sum(s.c{i}) filter (where dx = 0 and dy = 0) - sum(k * s.c{i})", offsets(3, 3, _bell(3)), True, True)


# The filters' textbook formulas in SQL, by the distance u; each with half of its width.
_SINC = lambda u: f"(case when {u} < 1e-4 then 1.0 else sin(pi() * {u}) / (pi() * {u}) end)"
_KEYS = lambda a: f"(case when u < 1 then ({a} + 2) * u ** 3 - ({a} + 3) * u ** 2 + 1 else {a} * u ** 3 - 5 * {a} * u ** 2 + 8 * {a} * u - 4 * {a} end)"
FILTER_SQL = {
    "box": ("1.0", 0.5), "triangle": ("1 - u", 1.0), "gaussian": ("(case when u < 1.5 then exp(-2 * (u / 1.5) ** 2) else 0.0 end)", 1.5), "sharp-gaussian": ("(case when u < 1 then exp(-4 * u ** 2) else 0.0 end)", 1.0),
    "catmull-rom": ("(case when u < 1 then 1.5 * u ** 3 - 2.5 * u ** 2 + 1 else -0.5 * u ** 3 + 2.5 * u ** 2 - 4 * u + 2 end)", 2.0),
    "blackman-harris": ("0.35875 + 0.48829 * cos(2 * pi() * u / 3) + 0.14128 * cos(4 * pi() * u / 3) + 0.01168 * cos(2 * pi() * u)", 1.5),
    "sinc": (_SINC("u"), 2.0), "lanczos3": (f"{_SINC('u')} * {_SINC('(u / 3)')}", 3.0),
    "mitchell": ("(case when u < 1 then (7 * u ** 3 - 12 * u ** 2 + 16 / 3.0) / 6 else (-7 / 3.0 * u ** 3 + 12 * u ** 2 - 20 * u + 32 / 3.0) / 6 end)", 2.0),
    "b-spline": ("(case when u <= 1 then 2 / 3.0 - u ** 2 + u ** 3 / 2 else (2 - u) ** 3 / 6 end)", 2.0),
    "cubic": (_KEYS("0.0"), 2.0), "keys": (_KEYS("(-0.5)"), 2.0), "simon": (_KEYS("(-0.75)"), 2.0), "rifman": (_KEYS("(-1.0)"), 2.0),
}


def resized(name: str, f: Callable[[Image], Image], filt: str, width: int, height: int) -> None:
    """Each target's sources from its own coordinate, weighted by the filter's formula and normalised; all days take part."""
    formula, half = FILTER_SQL[filt]

    def taps(axis: str, lo: str, hi: str, n: int) -> str:
        at = f"(select t, {lo} + (t + 0.5::double) * ({hi} - {lo}) / {n} as s, least({n}::double / ({hi} - {lo}), 1.0) as scale, {lo} as lo, {hi} as hi from w, (select unnest(range(0, {n})) as t))"
        own = f"(select t, cast(least(greatest(floor(s) + k, lo), hi - 1) as int) as src, abs(scale * (k - (s - floor(s) - 0.5))) as u from {at}, (select unnest(range(-40, 41)) as k))"
        return f"{axis}u as (select t, src, case when u <= {half} then {formula} else 0.0 end as w from {own}), {axis}t as (select t as dst, src, sum(w) / any_value(total) as w from (select *, sum(w) over (partition by t) as total from {axis}u) group by t, src)"

    sql = f"{EV}, {taps('x', '0', '24', width)}, {taps('y', 'w.y0', 'w.y1', height)} select image_id, cast(yt.dst as int) as y, cast(xt.dst as int) as x, " + ", ".join(f"round(sum(xt.w * yt.w * c{i}) + 1e-9, 6) + 0.0 as c{i}" for i in range(2)) + " from a join xt on a.x = xt.src join yt on a.y = yt.src group by image_id, yt.dst, xt.dst"

    def query(s: SparkSession, d: str) -> DataFrame:
        return shown(_nudged(f(ev(s, d))))

    register(name, query, sql)


def _nudged(a: Image) -> Image:
    """No tie is left to the engines' rounding."""
    return a.with_channels([c + 1e-9 for c in a.c])


for _f in FILTER_SQL:
    resized(f"resize_{_f.replace('-', '_')}", lambda a, f=_f: N.resize(a, 12, 10, f), _f, 12, 10)


def _resampled_sql(width: int, height: int, bilinear: bool) -> str:
    """Each target pixel's sources by its own coordinates."""
    at = lambda t, o, lo, hi, n: f"{lo} + ({t} + 0.5) * ({hi} - {lo}) / {n}{o}"
    half = " - 0.5" if bilinear else ""
    sx, sy = at("tx", half, "0", "24", width), at("ty", half, "w.y0", "w.y1", height)
    t = f"t as (select image_id, tx, ty, {sx} as sx, {sy} as sy, w.y0, w.y1 from ids, w, (select unnest(range(0, {width})) as tx), (select unnest(range(0, {height})) as ty))"
    taps = "(values (0, 0), (0, 1), (1, 0), (1, 1)) o(dx, dy)" if bilinear else "(values (0, 0)) o(dx, dy)"
    weight = "(case when dx = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) * (case when dy = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end)" if bilinear else "1.0"
    src = f"s as (select image_id, cast(tx as int) as x, cast(ty as int) as y, cast(least(greatest(floor(sx) + dx, 0), 23) as int) as px, cast(least(greatest(floor(sy) + dy, y0), y1 - 1) as int) as py, {weight} as k from t, {taps})"
    values = ", ".join(f"round(sum(k * d.c{i}) + 1e-9, 6) + 0.0 as c{i}" for i in range(2))
    return f"{EV}, {LATTICE}, {t}, {src} select s.image_id, s.y, s.x, {values} from s join d on d.image_id = s.image_id and d.x = px and d.y = py group by s.image_id, s.y, s.x"


def _no_tie(a: Image) -> DataFrame:
    return shown(a.with_channels([c + 1e-9 for c in a.c]))


register("resample_nearest", lambda s, d: _no_tie(N.resample(ev(s, d).dense(), 12, 8, False)), _resampled_sql(12, 8, False))
register("resample_bilinear", lambda s, d: _no_tie(N.resample(ev(s, d).dense(), 12, 8, True)), _resampled_sql(12, 8, True))
register("fit", lambda s, d: shown(N.fit(ev(s, d), 20, 20, "triangle")))


def _warp_sql(m: list[float]) -> str:
    """Each target's centre mapped back by the inverse, and the triangle filter of two pixels about it, widened where the map shrinks."""
    inv = np.linalg.inv(np.array(m, float).reshape(3, 3))
    back = lambda x, y, k: f"(({x}) * {float(inv[0, k])!r}::double + ({y}) * {float(inv[1, k])!r}::double + {float(inv[2, k])!r}::double)"
    q = lambda x, y, k: f"{back(x, y, k)} / {back(x, y, 2)}"
    x, y = "l.x + 0.5", "l.y + 0.5"
    points = ", ".join(f"{q(px, py, k)} as {n}{k}" for n, px, py in (("o", x, y), ("r", x + " + 1", y), ("b", x, y + " + 1")) for k in (0, 1))
    t = f"t as (select l.image_id, l.x, l.y, {points} from lattice l), u as (select *, greatest(1.0, abs(r0 - o0), abs(b0 - o0)) as ds, greatest(1.0, abs(r1 - o1), abs(b1 - o1)) as dt from t)"
    near = "s.x >= floor(o0 - ds) and s.x < ceil(o0 + ds) and s.y >= floor(o1 - dt) and s.y < ceil(o1 + dt)"
    cells = "cells as (select xx as x, yy as y from (select unnest(range(-100, 200)) as xx), (select unnest(range(-100, 500)) as yy))"
    weight = "greatest(0.0, 1 - abs((s.x + 0.5 - o0) / ds)) * greatest(0.0, 1 - abs((s.y + 0.5 - o1) / dt))"
    norm = f"n as (select u.image_id, u.x, u.y, sum({weight}) as norm from u join cells s on {near} group by all)"
    got = f"g as (select u.image_id, u.x, u.y, " + ", ".join(f"sum(({weight}) * s.c{i}) as c{i}" for i in range(2)) + f" from u join a s on s.image_id = u.image_id and {near} and ({weight}) > 0 group by all)"
    return f"{EV}, {LATTICE}, {t}, {cells}, {norm}, {got} select image_id, y, x, " + ", ".join(f"round(case when norm > 0 then c{i} / norm else 0.0 end + 1e-9, 6) + 0.0 as c{i}" for i in range(2)) + " from g join n using (image_id, x, y)"


_WARP = [1.13, 0.07, 0, -0.11, 0.93, 0, 1.3, 2.1, 1]


def _turn_sql(angle: float) -> str:
    """The matrix needs the window's centre, which only the query knows: rotate about a fixed point."""
    c, s, (x, y) = np.cos(angle), np.sin(angle), CENTER
    return _warp_sql([c, s, 0, -s, c, 0, x - c * x + s * y, y - s * x - c * y, 1])


CENTER = (12.0, 15.0)
register("rotate", lambda s, d: _no_tie(N.rotate(ev(s, d), 0.3, CENTER, "triangle")), _turn_sql(0.3))
register("warp", lambda s, d: _no_tie(N.warp(ev(s, d), _WARP, "triangle")), _warp_sql(_WARP))
_PX, _PY = "(t.x + 0.25 - 0.5)", "(t.y + 0.75 - 0.5)"
register("st_warp", lambda s, d: _no_tie(N.st_warp(ev(s, d), _st(s, d))), f"{EV}, o as (select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy)), t as (select image_id, x, y from a), k as (select t.image_id, t.x, t.y, cast(floor({_PX}) + dx as int) as sx, cast(floor({_PY}) + dy as int) as sy, (case when dx = 1 then {_PX} - floor({_PX}) else 1 - ({_PX} - floor({_PX})) end) * (case when dy = 1 then {_PY} - floor({_PY}) else 1 - ({_PY} - floor({_PY})) end) as w from t, o) select k.image_id, k.y, k.x, " + ", ".join(f"round(sum(w * a.c{i}) + 1e-9, 6) + 0.0 as c{i}" for i in range(2)) + " from k join a on a.image_id = k.image_id and a.x = sx and a.y = sy where w > 0 group by k.image_id, k.y, k.x")
register("fillholes", lambda s, d: shown(N.fillholes_pushpull(_small(s))))
register("fft", lambda s, d: _no_tie(N.fft(ev(s, d).dense())), f"{EV}, {LATTICE}, h as (select y1 - y0 as n, y0 from w) select u.image_id, u.y, u.x, round(sum(d.c0 * cos(2 * pi() * (u.x * d.x / 24.0 + (u.y - h.y0) * (d.y - h.y0) / h.n::double))) / sqrt(24 * any_value(h.n)) + 1e-9, 6) + 0.0 as c0, round(-sum(d.c0 * sin(2 * pi() * (u.x * d.x / 24.0 + (u.y - h.y0) * (d.y - h.y0) / h.n::double))) / sqrt(24 * any_value(h.n)) + 1e-9, 6) + 0.0 as c1 from d u join d on d.image_id = u.image_id cross join h group by u.image_id, u.y, u.x")
register("ifft", lambda s, d: shown(N.ifft(N.fft(ev(s, d).dense()))), f"{EV}, ids as (select distinct image_id from a), lattice as (select image_id, cast(yy as int) as y, cast(xx as int) as x from ids, w, lateral (select unnest(range(w.y0, w.y1)) as yy), (select unnest(range(0, 24)) as xx)) select l.image_id, l.y, l.x, round(coalesce(c0, 0), 6) + 0.0 as c0 from lattice l left join a using (image_id, y, x)")
_KIND = "case when ({y} - w.y0) % 2 = 0 and {x} % 2 = 0 then 0 when ({y} - w.y0) % 2 = 1 and {x} % 2 = 1 then 2 else 1 end"
register(
    "demosaic", lambda s, d: _no_tie(N.demosaic(G.channels(ev(s, d), [0]))),
    f"{EV}, {LATTICE}, n as (select t.image_id, t.y, t.x, {_KIND.format(y='t.y', x='t.x')} as own, {_KIND.format(y='s.y', x='s.x')} as kind, abs(s.x - t.x) + abs(s.y - t.y) as far, s.c0 as v from d t cross join w join d s on s.image_id = t.image_id and abs(s.x - t.x) <= 1 and abs(s.y - t.y) <= 1) select image_id, y, x, "
    + ", ".join(f"round(avg(v) filter (where (own = {k} and far = 0) or (own <> {k} and kind = {k} and {'far = 1' if k == 1 else 'far > 0'})) + 1e-9, 6) + 0.0 as c{k}" for k in range(3)) + " from n group by image_id, y, x",
)
register("bayer_mosaic", lambda s, d: shown(N.mosaic_bayer(G.channels(emb(s, d), [0, 1, 2]))), f"{EMB} select {_show_sql(['case when y % 2 = 0 and x % 2 = 0 then c0 when y % 2 = 1 and x % 2 = 1 then c2 else c1 end'])} from a")
NANS = "case when c0 > 0.2 then 'nan'::double when c0 < -0.2 then 'inf'::double else c0 end"


def _holes(a: Image) -> Image:
    return a.with_channels([F.when(a.c[0] > 0.2, float("nan")).when(a.c[0] < -0.2, float("inf")).otherwise(a.c[0]), a.c[1]])


def _small(s: SparkSession) -> Image:
    a = G.fill(s, Roi(0, 16, 0, 16), [0.5, 0.25, 0.125, 1.0])
    return a.within(Roi(4, 8, 4, 8), [F.lit(0.0)] * 4)


def _st(s: SparkSession, d: str) -> Image:
    a = ev(s, d)
    f = a.spec.full
    return a.with_channels([(F.col("x") - f.x0 + 0.25) / f.width, (F.col("y") - f.y0 + 0.75) / f.height])


register("fixnan_black", lambda s, d: shown(N.fix_non_finite(_holes(emb(s, d)), "black")), f"{EMB} select {_show_sql(['case when c0 > 0.2 or c0 < -0.2 then 0.0 else c0 end', 'c1'])} from a")
register("fixnan_box3", lambda s, d: shown(N.fix_non_finite(_holes(emb(s, d)), "box3")), f"{EMB} select image_id, y, x, round(case when c0 > 0.2 or c0 < -0.2 then coalesce((select avg(b.c0) from a b where b.image_id = a.image_id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 and b.c0 between -0.2 and 0.2), 0.0) else c0 end, 6) + 0.0 as c0, round(c1, 6) + 0.0 as c1 from a")


# --- aggregates
def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(k, 6) + 0.0).alias(k) if t == "double" else F.col(k) for k, t in df.dtypes])


LONG = "select image_id, y, x, unnest([0, 1, 2, 3]) as c, unnest([c0, c1, c2, c3]) as v from a"
STATS = f"{DENSE}, l as ({LONG}) select image_id, c, round(min(v), 6) + 0.0 as min, round(max(v), 6) + 0.0 as max, round(avg(v), 6) + 0.0 as avg, round(stddev_pop(v), 6) + 0.0 as stddev, round(sum(v), 6) + 0.0 as sum, 0::bigint as nan, 0::bigint as inf, count(*) as finite from l group by image_id, c"
register("stats", lambda s, d: _rounded(S.pixel_stats(emb(s, d))), STATS)
register("stats_nonfinite", lambda s, d: _rounded(S.pixel_stats(_holes(emb(s, d))).filter("c = 0").select("image_id", "min", "max", "avg", "nan", "inf", "finite")), f"{DENSE} select image_id, round(coalesce(min(c0) filter (where c0 between -0.2 and 0.2), 0), 6) + 0.0 as min, round(coalesce(max(c0) filter (where c0 between -0.2 and 0.2), 0), 6) + 0.0 as max, round(coalesce(avg(c0) filter (where c0 between -0.2 and 0.2), 0), 6) + 0.0 as avg, count(*) filter (where c0 > 0.2) as nan, count(*) filter (where c0 < -0.2) as inf, count(*) filter (where c0 between -0.2 and 0.2) as finite from a group by image_id")


def over_stats(s: SparkSession, d: str) -> DataFrame:
    """The flagship: two sparse images, composited, and the result's statistics."""
    return _rounded(S.pixel_stats(A.over(_li(s, d, "A"), _li(s, d, "R"))))


_O = ", ".join(f"{OVER(i)} as c{i}" for i in range(5))
# A pixel that neither image has is zero.
register(
    "over_stats", over_stats,
    f"{LI}, o as (select image_id, {_O} from a), l as (select image_id, unnest([0, 1, 2, 3, 4]) as c, unnest([c0, c1, c2, c3, c4]) as v from o), w as (select 7 * (max(o_orderkey) + 1) as n from orders), "
    "t as (select image_id, c, min(v) as lo, max(v) as hi, sum(v) as s, sum(v * v) as q, count(*) as k, any_value(w.n) as n from l, w group by image_id, c) "
    "select image_id, c, round(case when k < n then least(lo, 0) else lo end, 6) + 0.0 as min, round(case when k < n then greatest(hi, 0) else hi end, 6) + 0.0 as max, round(s / n, 6) + 0.0 as avg, "
    "round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 6) + 0.0 as stddev, round(s, 6) + 0.0 as sum, 0::bigint as nan, 0::bigint as inf, n::bigint as finite from t",
)


def _compared(s: SparkSession, d: str) -> DataFrame:
    a, b = G.channels(_li(s, d, "A"), [0, 1, 2]), G.channels(_li(s, d, "R"), [0, 1, 2])
    return _rounded(S.compare(a, b, 0.3, 0.1).drop("psnr"))


_E = [f"abs(a{i} - b{i})" for i in range(3)]
_T = f"greatest({', '.join(_E)})"
register(
    "compare", _compared,
    f"{LI}, e as (select *, {_T} as top from a), n as (select 3 * 7 * (max(o_orderkey) + 1) as n from orders), best as (select y, x, case when {_E[0]} = top then 0 when {_E[1]} = top then 1 else 2 end as c from e order by top desc, y, x limit 1) "
    f"select e.image_id, round(sum({' + '.join(_E)}) / any_value(n.n), 6) + 0.0 as mean_error, round(sqrt(sum({' + '.join(f'{e} * {e}' for e in _E)}) / any_value(n.n)), 6) + 0.0 as rms_error, round(max(top), 6) + 0.0 as max_error, any_value(best.x) as x, any_value(best.y) as y, 0 as z, any_value(best.c) as c, "
    "count(*) filter (where top > 0.1) as n_warn, count(*) filter (where top > 0.3) as n_fail from e, n, best group by e.image_id",
)
register("is_constant_color", lambda s, d: S.is_constant_color(emb(s, d), 0.1), f"{DENSE}, f as (select image_id, {', '.join(f'arg_min(c{i}, y * 25 + x) as f{i}' for i in range(4))} from a group by image_id) select image_id, bool_and({' and '.join(f'abs(c{i} - f{i}) <= 0.1' for i in range(4))}) as constant from a join f using (image_id) group by image_id")
register("is_constant_channel", lambda s, d: S.is_constant_channel(emb(s, d), 1, 0.0, 0.3), f"{DENSE} select image_id, bool_and(abs(c1) <= 0.3) as constant from a group by image_id")
register("is_monochrome", lambda s, d: S.is_monochrome(emb(s, d), 0.5), f"{DENSE} select image_id, bool_and(greatest(c0, c1, c2, c3) - least(c0, c1, c2, c3) <= 0.5) as monochrome from a group by image_id")
register("color_count", lambda s, d: S.color_count(emb(s, d), [[0.0], [0.1, 0.1, 0.1, 0.1]], 0.15), f"{DENSE} select image_id, color, count(*) filter (where abs(c0 - v) <= 0.15 and abs(c1 - v) <= 0.15 and abs(c2 - v) <= 0.15 and abs(c3 - v) <= 0.15) as n from a, (values (0, 0.0), (1, 0.1)) k(color, v) group by image_id, color")
register("rangecheck", lambda s, d: S.color_range_check(emb(s, d), -0.2, 0.2), f"{DENSE} select image_id, count(*) filter (where least(c0, c1, c2, c3) < -0.2) as n_low, count(*) filter (where greatest(c0, c1, c2, c3) > 0.2) as n_high, count(*) filter (where least(c0, c1, c2, c3) >= -0.2 and greatest(c0, c1, c2, c3) <= 0.2) as n_in from a group by image_id")
register("nonzero_region", lambda s, d: S.nonzero_region(A.clamp(emb(s, d), 0.1, 9.0).with_channels([F.when(F.col("c0") > 0.15, F.col("c0")).otherwise(0.0)])).select("image_id", "x0", "x1", "y0", "y1"), f"{EMB} select image_id, min(x) as x0, max(x) + 1 as x1, min(y) as y0, max(y) + 1 as y1 from a where c0 > 0.15 group by image_id")
register("histogram", lambda s, d: S.histogram(emb(s, d), 0, 16, -0.4, 0.4), f"{DENSE}, h as (select image_id, cast(least(greatest(floor((c0 - -0.4) * (16 / (0.4 - -0.4))), 0), 15) as int) as bin, count(*) as n from a group by all) select image_id, cast(b.bin as int) as bin, coalesce(n, 0) as n from ids cross join (select unnest(range(0, 16)) as bin) b left join h on h.image_id = ids.image_id and h.bin = b.bin".replace("select image_id, cast(b.bin", "select ids.image_id, cast(b.bin"))
register("pixel_hash", lambda s, d: S.pixel_hash(emb(s, d)))
register("top_pixels", lambda s, d: shown(Image(S.top_pixels(emb(s, d), 0, 3), emb(s, d).spec)), f"{EMB} select {_show_sql(['c0', 'c1', 'c2', 'c3'])} from (select *, row_number() over (partition by image_id order by c0 desc, y, x) as r from a) where r <= 3")
register("idiff_status", lambda s, d: S.diff_status(S.compare(G.channels(_li(s, d, "A"), [0]), G.channels(_li(s, d, "R"), [0]), 0.3, 0.1), 1000).select("image_id", "n_fail", "n_warn", "status"), f"{LI} select image_id, count(*) filter (where abs(a0 - b0) > 0.3) as n_fail, count(*) filter (where abs(a0 - b0) > 0.1) as n_warn, case when count(*) filter (where abs(a0 - b0) > 0.3) > 0 then 'FAILURE' when count(*) filter (where abs(a0 - b0) > 0.1) > 0 then 'WARNING' else 'PASS' end as status from a group by image_id")


# --- deep
def _deep(s: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    li = _table(s, d, "lineitem")
    if parity is not None:
        li = li.filter(F.col("l_linenumber") % 2 == parity)
    q, a = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    sample = F.struct((a * 0.5).alias("R"), (a * 0.25).alias("G"), a.alias("B"), a.alias("A"), q.alias("Z"), (q + a * 10).alias("Zback"))
    return D.from_rows(li.select(F.lit("0").alias("image_id"), F.lit(0).alias("z"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") % 64).cast("int").alias("x"), sample.alias("sample")))


DEEP = "with s as (select '0' as image_id, cast(l_orderkey % 64 as int) as y, cast(l_suppkey % 64 as int) as x, l_discount::double * 0.5 as r, l_discount::double as a, l_quantity::double as zf, l_quantity::double + l_discount::double * 10 as zb from lineitem)"
register("deep_sample_count", lambda s, d: D.sample_count(_deep(s, d)).select("image_id", "y", "x", F.col("samples").cast("long").alias("n")), f"{DEEP} select image_id, y, x, count(*) as n from s group by all")
register("deep_flatten", lambda s, d: D.flatten(_deep(s, d)).select("image_id", "y", "x", (F.round("A", 6) + 0.0).alias("a"), (F.round("R", 6) + 0.0).alias("r")), f"{DEEP} select image_id, y, x, round(1 - product(1 - a), 6) + 0.0 as a, round(0.5 * (1 - product(1 - a)), 6) + 0.0 as r from s group by all")
_TEN = "transform(samples, t -> named_struct('R', t.R * 10, 'G', t.G * 10, 'B', t.B * 10, 'A', t.A * 10, 'Z', t.Z, 'Zback', t.Zback))"
register(
    "deep_flatten_opaque", lambda s, d: D.flatten(_deep(s, d).withColumn("samples", F.expr(_TEN))).select("image_id", "y", "x", *[(F.round(F.col(k) + 1e-9, 6) + 0.0).alias(n) for k, n in (("A", "a"), ("R", "r"), ("depth", "depth"))]),
    f"{DEEP}, t as (select *, a * 10 as k, coalesce(product(1 - a * 10) over (partition by image_id, y, x order by zf, zb, a rows between unbounded preceding and 1 preceding), 1) as open from s) "
    "select image_id, y, x, round(sum(open * k) + 1e-9, 6) + 0.0 as a, round(sum(open * r * 10) + 1e-9, 6) + 0.0 as r, round(case when sum(open * k) > 0 then sum(open * k * zf) / sum(open * k) else 1e30 end + 1e-9, 6) + 0.0 as depth from t group by all",
)
register("deep_opaque_z", lambda s, d: _deep(s, d).withColumn("samples", F.expr("transform(samples, t -> named_struct('R', t.R, 'G', t.G, 'B', t.B, 'A', t.A * 10, 'Z', t.Z, 'Zback', t.Zback))")).select("image_id", "y", "x", (F.round(F.least(D.opaque_z(), F.lit(1e30)), 6) + 0.0).alias("zt")), f"{DEEP} select image_id, y, x, round(coalesce(arg_min(zb, (zf, zb)) filter (where a * 10 >= 1), 1e30), 6) + 0.0 as zt from s group by all")
register("deep_split_count", lambda s, d: D.split(_deep(s, d), "25.2").select("image_id", "y", "x", F.size("samples").cast("long").alias("n")), f"{DEEP} select image_id, y, x, count(*) + count(*) filter (where zf < 25.2 and zb > 25.2) as n from s group by all")


def _merged_samples(s: SparkSession, d: str) -> DataFrame:
    """Every sample of the merge of two deep images."""
    out = D.deep_merge(_deep(s, d, 0), _deep(s, d, 1)).select("image_id", "y", "x", F.explode("samples").alias("s"))
    return out.select("image_id", "y", "x", *[(F.round(F.col(f"s.{k}") + 1e-9, 6) + 0.0).alias(f"s_{k.lower()}") for k in D.FIELDS])


_D, _L = "(case when i.a >= 1 then 1e30 else -ln(1 - i.a) end)", "(case when i.zb > i.zf then (e.zb - e.zf) / (i.zb - i.zf) else 1 end)"
DEEP_MERGE = (
    f"{DEEP}, cuts as (select distinct image_id, y, x, z from (select image_id, y, x, zf as z from s union all select image_id, y, x, zb from s)), "
    "gaps as (select image_id, y, x, z as zf, lead(z) over (partition by image_id, y, x order by z) as zb from cuts), "
    "e as (select * from gaps where zb is not null union all select distinct image_id, y, x, zf, zb from s where zf = zb), "
    f"p as (select e.image_id, e.y, e.x, e.zf, e.zb, sum({_D} * {_L}) as depth, sum(i.r / i.a * {_D} * {_L}) filter (where i.a > 0) as red, sum({_D} * {_L}) filter (where i.a > 0) as blue "
    "from e join s i on i.image_id = e.image_id and i.y = e.y and i.x = e.x and ((e.zf < e.zb and i.zf <= e.zf and i.zb >= e.zb) or (e.zf = e.zb and i.zf = e.zf and i.zb = e.zb)) group by all) "
    "select image_id, y, x, " + ", ".join(f"round({v} + 1e-9, 6) + 0.0 as s_{n}" for n, v in (("r", "coalesce(f * red, 0)"), ("g", "coalesce(f * red / 2, 0)"), ("b", "coalesce(f * blue, 0)"), ("a", "1 - exp(-depth)"), ("z", "zf"), ("zback", "zb")))
    + " from (select *, case when depth > 1e-12 then (1 - exp(-depth)) / depth else 1 end as f from p)"
)
register("deep_merge", _merged_samples, DEEP_MERGE)
register("deep_holdout", lambda s, d: D.deep_holdout(_deep(s, d), D.deepen(G.fill(s, R64, [0, 0, 0, 1, 25.5], names=["R", "G", "B", "A", "Z"]))).select("image_id", "y", "x", F.size("samples").cast("long").alias("n")), f"{DEEP} select image_id, y, x, count(*) filter (where zf < 25.5 or (zf = 25.5 and zb = 25.5)) as n from s group by all")
register("deep_value", lambda s, d: X_.deep_value(_deep(s, d), "A", 0).select("image_id", "y", "x", (F.round("v", 6) + 0.0).alias("v")), f"{DEEP} select image_id, y, x, round(first(a order by zf, zb, a), 6) + 0.0 as v from s group by all")
register("deep_set_value", lambda s, d: X_.deep_value(X_.set_deep_value(_deep(s, d), "Z", 1, -2.0), "Z", 1).select("image_id", "y", "x", "v"), f"{DEEP} select image_id, y, x, case when count(*) > 1 then -2.0 else 0.0 end::double as v from s group by all")
register("deep_copy_pixel", lambda s, d: D.sample_count(X_.copy_deep_pixel(_deep(s, d, 0), _deep(s, d, 1), 1, 2)).select("image_id", "y", "x", F.col("samples").cast("long").alias("n")), f"{DEEP.replace(' from lineitem', ', l_linenumber % 2 as p from lineitem')}, e as (select image_id, y, x, count(*) filter (where p = 0) as n, count(*) filter (where p = 1) as m from s group by all) select a.image_id, a.y, a.x, case when b.m > 0 then b.m else a.n end as n from e a left join e b on b.image_id = a.image_id and b.y = a.y + 2 and b.x = a.x + 1 where a.n > 0")
register("deepen", lambda s, d: D.deepen(ev(s, d).with_channels([F.col("c0") * 0 + F.when(F.col("c1") > 1, 1.0).otherwise(0.0)], ["R"])).select("image_id", "y", "x", F.size("samples").cast("long").alias("n")), f"{EV} select image_id, y, x, case when c1 > 1 then 1 else 0 end::bigint as n from a")
register("igrep", lambda s, d: S.igrep(_attribs(s, d), "^h.*LD$", True), "select cast(c_custkey as varchar) as filename, 'segment' as name, c_mktsegment as value from customer where regexp_matches(lower(c_mktsegment), '^h.*ld$')")
register("igrep_invert", lambda s, d: S.igrep(_attribs(s, d), "HOUSE", False, True).select("filename"), "select cast(c_custkey as varchar) as filename from customer where not regexp_matches(c_mktsegment, 'HOUSE') and not regexp_matches(c_name, 'HOUSE')")


def _attribs(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("filename"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("attribs"))


# --- textures, files and streams
def _pyramid(s: SparkSession, d: str) -> DataFrame:
    return X.make_texture(G.fill(s, R64, [0], [1], [2], [4])).groupBy("mip").agg(F.count("*").alias("n"), (F.round(F.avg("c0"), 6) + 0.0).alias("mean"))


def _lookups(s: SparkSession, d: str) -> DataFrame:
    q = _table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("0").alias("image_id"), ((F.col("o_orderkey") % 97) / 97).alias("s"), ((F.col("o_orderkey") % 89) / 89).alias("t"), F.lit(1.0).alias("footprint"))
    out = X.texture(X.make_texture(G.fill(s, R64, [0], [1], [2], [4])).filter("mip < 2"), q, 64, 64, 1)
    return out.select("id", (F.round(F.col("c0") + 1e-9, 6) + 0.0).alias("c0"))


def _roundtrip(fmt: str, top: int) -> Query:
    """An image encoded and decoded: its samples as whole numbers up to top."""

    def query(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        back = W.encoded(_written(s), fmt).mapInPandas(_decoded, "y int, x int, c0 double, c1 double, c2 double")
        return back.select("y", "x", *[F.floor(F.col(f"c{i}") * top + 0.5).alias(f"c{i}") for i in range(3)])

    return query


#: Corners of the image that is written: their values are whole numbers of 255 and of each other's steps.
CORNERS = ([0.0, 0.2, 1.0], [1.0, 0.4, 0.0], [0.2, 0.4, 0.6], [0.8, 0.0, 0.4])


def _written(s: SparkSession) -> Image:
    return G.fill(s, Roi(0, 16, 0, 9), *CORNERS)


def _decoded(batches):
    import numpy as np
    import pandas as pd

    from lumenframe.sources import codecs

    for b in batches:
        for content in b["content"]:
            v = codecs.decode(bytes(content), "x.tga")
            y, x = np.mgrid[0 : v.shape[0], 0 : v.shape[1]]
            yield pd.DataFrame({"y": y.ravel(), "x": x.ravel()} | {f"c{i}": v[:, :, min(i, v.shape[2] - 1)].ravel() for i in range(3)})


def _roundtrip_sql(top: int, stored: int | None, one: bool = False) -> str:
    """The samples by the corners' formula, in steps of what the format stores; one: a single channel."""
    value = lambda i: f"((1 - y / 8.0) * ((1 - x / 15.0) * {CORNERS[0][i]} + x / 15.0 * {CORNERS[1][i]}) + y / 8.0 * ((1 - x / 15.0) * {CORNERS[2][i]} + x / 15.0 * {CORNERS[3][i]}))"
    kept = lambda v: f"floor({v} * {stored} + 0.5) / {stored}" if stored else v
    v = ", ".join(f"cast(floor({kept(value(0 if one else i))} * {top} + 0.5) as bigint) as c{i}" for i in range(3))
    return f"select cast(y as int) as y, cast(x as int) as x, {v} from range(0, 9) s(y), range(0, 16) t(x)"


register("make_texture", _pyramid, "select * from (values " + ", ".join(f"({m}, {4 ** (6 - m)}::bigint, 1.75)" for m in range(7)) + ") v(mip, n, mean)")
_TS, _TT = (f"least(greatest(((o_orderkey % {k}) / {k}) * 64 - 0.5, 0), 63) / 63" for k in (97, 89))
register("texture_bilinear", _lookups, f"with q as (select o_orderkey as id, {_TS} as u, {_TT} as v from orders) select id, round((1 - v) * u + v * ((1 - u) * 2 + u * 4) + 1e-9, 6) + 0.0 as c0 from q")


def _periodic(s: SparkSession, d: str) -> DataFrame:
    """Lookups between the first two levels of a pattern that repeats, also beyond its edges."""
    q = _table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("0").alias("image_id"), ((F.col("o_orderkey") % 97) / 48 - 0.5).alias("s"), ((F.col("o_orderkey") % 89) / 44 - 0.5).alias("t"), (1 + (F.col("o_orderkey") % 5) / 5).alias("footprint"))
    a = grid(s, R64, [F.pmod(F.col("x"), F.lit(2)) * 1.0 + F.pmod(F.floor(F.col("y") / 2), F.lit(2)) * 2.0], ["V"])
    return X.texture(X.make_texture(a), q, 64, 64, 1, "periodic").select("id", (F.round(F.col("c0") + 1e-9, 6) + 0.0).alias("c0"))


# Level 0 alternates in x by pixels and in y by pairs; level 1 is 0.5 in x, and alternates in y by pixels.
_TRI = lambda v: f"abs(({v}) - 2 * floor(({v}) / 2) - 1)"
_Q = "select o_orderkey as id, (o_orderkey % 97) / 48.0::double - 0.5 as s, (o_orderkey % 89) / 44.0::double - 0.5 as t, 1 + (o_orderkey % 5) / 5.0::double as f from orders"
_PAIR = lambda y, k: f"((cast(floor(floor({y}) + {k}) as int) & 3) // 2)"
register("texture_trilinear", _periodic, f"with q as ({_Q}), p as (select id, s * 64 - 0.5 as x, t * 64 - 0.5 as y, t * 32 - 0.5 as y1, log2(f) as m from q) select id, round((1 - m) * (1 - {_TRI('x')} + 2 * ((1 - (y - floor(y))) * {_PAIR('y', 0)} + (y - floor(y)) * {_PAIR('y', 1)})) + m * (0.5 + 2 * (1 - {_TRI('y1')})) + 1e-9, 6) + 0.0 as c0 from p")
# Steps of what each format stores; tests read files made by the formats' own rules.
for _fmt, _top, _stored in (("pnm", 255, 255), ("bmp", 255, 255), ("png", 255, 255), ("sgi", 255, 255), ("targa", 255, 255), ("dds", 255, 255), ("ico", 255, 255), ("tiff", 65535, 65535), ("dpx", 65535, 65535), ("cineon", 1023, 1023), ("pfm", 999, None), ("fits", 999, None)):
    register(f"format_{_fmt}", _roundtrip(_fmt, _top), _roundtrip_sql(_top, _stored))
register("format_zfile", _roundtrip("zfile", 999), _roundtrip_sql(999, None, True))
register("format_hdr", lambda s, d: _roundtrip("hdr", 20)(s, d).agg(F.count("*").alias("n")), "select 144::bigint as n")
register("format_gif", lambda s, d: _roundtrip("gif", 30)(s, d), f"with v as ({_roundtrip_sql(3000, 3000)}) select y, x, " + ", ".join(f"cast(floor(round(255.0 * round_even(c{i} / 3000.0 * {n}, 0) / {n}) / 255.0 * 30 + 0.5) as bigint) as c{i}" for i, n in enumerate((5, 6, 5))) + " from v")
register("stream_windows", lambda s, d: T.run_available(s, d, "events.parquet").select("kind", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", (F.round("total", 4) + 0.0).alias("total")), "select event_type as kind, date_trunc('hour', ts) as begin, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by all")


# --- user functions, types, volumes
def _volume(s: SparkSession, d: str) -> DataFrame:
    """A volume that is linear in x, y and z is sampled exactly."""
    roi = Roi(0, 8, 0, 8, 0, 8)
    a = grid(s, roi, [F.col("x") + F.col("y") * 2.0 + F.col("z") * 4.0], ["V"])
    key = F.col("o_orderkey")
    p = _table(s, d, "orders").select(key.alias("id"), F.lit("0").alias("image_id"), (1 + key % 50 / 10).alias("px"), (1 + key % 45 / 10).alias("py"), (1 + key % 40 / 10).alias("pz"))
    return X.texture3d(a, p).select("id", (F.round("c0", 6) + 0.0).alias("c0"))


def _bicubic(s: SparkSession, d: str) -> DataFrame:
    """Splines reproduce a linear image away from its border."""
    a = grid(s, R64, [F.col("x") + F.col("y") * 2.0], ["V"])
    key = F.col("o_orderkey")
    p = _table(s, d, "orders").select(key.alias("id"), F.lit("0").alias("image_id"), (4 + key % 500 / 10).alias("px"), (4 + key % 450 / 10).alias("py"))
    return X.bicubic(a, p).select("id", (F.round("c0", 6) + 0.0).alias("c0"))


register("texture3d", _volume, "select o_orderkey as id, round((1 + o_orderkey % 50 / 10.0 - 0.5) + (1 + o_orderkey % 45 / 10.0 - 0.5) * 2 + (1 + o_orderkey % 40 / 10.0 - 0.5) * 4, 6) + 0.0::double as c0 from orders")
register("interp_bicubic", _bicubic, "select o_orderkey as id, round((4 + o_orderkey % 500 / 10.0 - 0.5) + (4 + o_orderkey % 450 / 10.0 - 0.5) * 2, 6) + 0.0::double as c0 from orders")
unary("perpixel_op", lambda a: U.per_pixel(a.dense(), lambda v: v * 2 + 1), lambda i: f"c{i} * 2 + 1", dense=True)
register("perpixel_op2", lambda s, d: shown(U.per_pixel(_li(s, d, "A"), lambda v, w: v - w + 1e-9, _li(s, d, "R"))), f"{LI} select {_show_sql([f'a{i} - b{i} + 1e-9' for i in range(5)])} from a")
register("parallel_image", lambda s, d: shown(U.per_tile(G.fill(s, R64, [0], [1], [2], [4]), lambda v, roi: v * 0.5, 16)), GRID.format(v="round(0.5 * ((1 - y / 63.0) * (x / 63.0) + y / 63.0 * ((1 - x / 63.0) * 2 + x / 63.0 * 4)), 6) + 0.0 as c0", y0=0, y1=64, x0=0, x1=64))
register("bluenoise_image", lambda s, d: U.bluenoise_image(s).df.agg(F.count("*").alias("n"), *[(F.round(F.avg(f"c{i}"), 6) + 0.0).alias(f"m{i}") for i in range(4)]), "select 1024::bigint as n, 0.5 as m0, 0.5 as m1, 0.5 as m2, 0.5 as m3")
register("noise_blue", lambda s, d: shown(U.blue_noise(G.zero(s, R64), 0.25, 0.75)))
register("convert_type", lambda s, d: emb(s, d).df.select("image_id", "y", "x", Y.convert(Y.convert(F.abs("c0"), "float", "uint16"), "uint16", "uint8").alias("v")), f"{EMB} select image_id, y, x, cast(floor(floor(least(abs(c0) * 65535.0 + 0.5, 65535.0)) / 65535.0 * 255.0 + 0.5) as bigint) as v from a")
register("dither", lambda s, d: G.noise(G.zero(s, R64, 1), "uniform", 0.0, 1.0).df.select("y", "x", Y.dither(F.lit(0.5), F.col("c0")).alias("v")).groupBy("v").agg((F.count("*") > 1000).alias("many")), "select * from (values (127::bigint, true), (128::bigint, true)) v(v, many)")
register("swap_endian", lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", Y.swap_endian(F.col("l_partkey").cast("long")).alias("v")), "select l_orderkey, l_linenumber, ((l_partkey & 255) << 24) | (((l_partkey >> 8) & 255) << 16) | (((l_partkey >> 16) & 255) << 8) | ((l_partkey >> 24) & 255) as v from lineitem")
