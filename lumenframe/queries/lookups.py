"""Filtered lookups over tables: textures of lineitem's quantities, looked up by all orders and parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, image
from lumenframe.operators import lookups as L
from lumenframe.operators import texture as X

N, M = 64, 32
ANISO = L.Lookup("periodic", "mirror", anisotropic=8, missing=(-1.0, -2.0))
BICUBIC = L.Lookup("clamp", "black", "trilinear", "bicubic", fill=0.5)
POLE = 16


def heights(spark: SparkSession, sf: str) -> Image:
    """One image for each return flag: quantities and rows of lineitem, dealt to N x M texels."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("image_id"), (F.col("l_orderkey") % M).alias("y"), (F.col("l_partkey") % N).alias("x"))
    cells = df.agg((F.sum("l_quantity") / 100).alias("c0"), (F.count("*") / 10).alias("c1"))
    return image(cells, Roi(0, N, 0, M), ["R", "G"]).dense()


def textures(spark: SparkSession, sf: str) -> DataFrame:
    """The pyramids of heights()."""
    return X.make_texture(heights(spark, sf))


_LEVELS = f"""
cells as (
  select l_returnflag as image_id, l_orderkey % {M} as y, l_partkey % {N} as x, sum(l_quantity) / 100 as c0, count(*) / 10.0::double as c1
  from lineitem group by all),
tiles as (
  select image_id, mip, y, x, sum(c0) / max(area) as c0, sum(c1) / max(area) as c1
  from (
    select image_id, cast(m as int) as mip, cast(floor(y / pow(2, m)) as int) as y, cast(floor(x / pow(2, m)) as int) as x, c0, c1, least(pow(2, m), {M}) * least(pow(2, m), {N}) as area
    from (select image_id, y, x, c0, c1, unnest(range(0, 7)) as m from cells)) group by all)"""
#: Levels: {N} x {M}, halved until both are 1; the shorter side stays at 1.
_SIZES = "sizes as (select cast(m as int) as mip, cast(greatest(floor({n} / pow(2, m)), 1) as int) as lw, cast(greatest(floor({m} / pow(2, m)), 1) as int) as lh from range(0, 7) t(m))".format(n=N, m=M)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups of all orders; pending ones ask for a texture that does not exist."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flag = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("none")
    return o.select(
        k.alias("id"), flag.alias("image_id"), ((k % 1009 + 0.37) / 500 - 0.5).alias("s"), ((c % 997 + 0.37) / 500 - 0.5).alias("t"),
        ((k % 7 - 3) / 60).alias("dsdx"), ((k % 11 - 5) / 90).alias("dtdx"), ((c % 13 - 6) / 403.7).alias("dsdy"), ((c % 5 - 2) / 151.3).alias("dtdy"),
    )


_ORDERS = """q as (
  select o_orderkey as id, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'none' end as image_id,
         (o_orderkey % 1009 + 0.37::double) / 500 - 0.5 as s, (o_custkey % 997 + 0.37::double) / 500 - 0.5 as t, (o_orderkey % 7 - 3) / 60 as dsdx, (o_orderkey % 11 - 5) / 90 as dtdx,
         (o_custkey % 13 - 6) / 403.7::double as dsdy, (o_custkey % 5 - 2) / 151.3::double as dtdy
  from orders)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Directions of all parts, with differentials."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        k.alias("id"), F.lit("R").alias("image_id"), (k % 21 / 10 - 1).alias("rx"), (k % 31 / 15 - 1).alias("ry"), (size / 25 - 1.01).alias("rz"),
        (k % 5 / 50).alias("xx"), F.lit(0.01).alias("xy"), (k % 3 / 70).alias("xz"), (size / 900).alias("yx"), (k % 4 / 40).alias("yy"), F.lit(0.0).alias("yz"),
    )


_PARTS = """raw as (
  select p_partkey as id, 'R' as image_id, p_partkey % 21 / 10 - 1 as rx, p_partkey % 31 / 15 - 1 as ry, p_size / 25 - 1.01::double as rz,
         p_partkey % 5 / 50 as xx, 0.01::double as xy, p_partkey % 3 / 70 as xz, p_size / 900 as yx, p_partkey % 4 / 40 as yy, 0::double as yz
  from part)"""


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("id", *[(F.round(F.col(c) + 1e-9, digits) + 0.0).alias(c) for c in df.columns if c != "id"])


def _aniso(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(L.texture(textures(spark, sf), _orders(spark, sf), N, M, 2, ANISO, True), 4)


def _bicubic(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(L.texture(textures(spark, sf), _orders(spark, sf), N, M, 3, BICUBIC))


def _environment(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(L.environment(textures(spark, sf), _parts(spark, sf), N, M, 2, L.Lookup(), tile=POLE))


def _info(spark: SparkSession, sf: str) -> DataFrame:
    out = L.texture_info(textures(spark, sf))
    return out.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "levels", "channels")], *[(F.round(f"mean{i}", 6) + 0.0).alias(f"mean{i}") for i in range(2)])


def _texels(spark: SparkSession, sf: str) -> DataFrame:
    out = L.texels(textures(spark, sf), 2, 3, 9, 1, 7)
    return out.select("image_id", "y", "x", *[(F.round(f"c{i}", 6) + 0.0).alias(f"c{i}") for i in range(2)])


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return textures(spark, sf).groupBy("image_id", "mip").agg(F.count("*").alias("n"), *[(F.round(F.avg(f"c{i}"), 6) + 0.0).alias(f"mean{i}") for i in range(2)])


def _bump(spark: SparkSession, sf: str) -> DataFrame:
    out = X.bump_slopes(heights(spark, sf), uv_scale=16.0, scale=(1.0, -0.5))
    return out.df.select("image_id", "y", "x", *[(F.round(F.col(f"c{i}") + 1e-9, 5) + 0.0).alias(f"c{i}") for i in range(6)])


def _wrap(at: str, n: str, mode: str) -> str:
    return {
        "periodic": f"(({at} % {n} + {n}) % {n})",
        "clamp": f"least(greatest({at}, 0), {n} - 1)",
        "mirror": f"case when ({at} % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} then ({at} % (2 * {n}) + 2 * {n}) % (2 * {n}) else 2 * {n} - 1 - ({at} % (2 * {n}) + 2 * {n}) % (2 * {n}) end",
        "black": f"case when {at} between 0 and {n} - 1 then {at} end",
    }[mode]


def _levels(wide: str, side: str) -> str:
    """chosen (id, mip, lw): levels and their shares of a table e with a footprint."""
    return f"""
fits as (select e.id, min(z.mip) as m from e, sizes z where {wide} * {side} <= 1 group by e.id),
blends as (select e.id, m, case when m is null or m = 0 then 0 else least(greatest(2 * {wide} * {side} - 1, 0), 1) end as b from e left join fits using (id) left join sizes z on z.mip = m),
chosen as (select id, coalesce(greatest(m - 1, 0), 6) as level, 1 - b as share from blends union all select id, m, b from blends where b > 0)"""


#: Axes as singular values: the squares' sum and the area give both.
_ANISO = f"""with {_LEVELS}, {_SIZES}, {_ORDERS},
w as (
  select * replace (
    case when nx and ny then 1e-8 when nx then dtdy * 1e-8 / ly else dsdx end as dsdx, case when nx and ny then 0 when nx then -dsdy * 1e-8 / ly else dtdx end as dtdx,
    case when nx and ny then 0 when ny then -dtdx * 1e-8 / lx else dsdy end as dsdy, case when nx and ny then 1e-8 when ny then dsdx * 1e-8 / lx else dtdy end as dtdy)
  from (select *, sqrt(dsdx * dsdx + dtdx * dtdx) as lx, sqrt(dsdy * dsdy + dtdy * dtdy) as ly, lx < 1e-8 as nx, ly < 1e-8 as ny from q)),
f as (
  select id, image_id, s, t, dsdx * dsdx + dsdy * dsdy + dtdx * dtdx + dtdy * dtdy as ss, abs(dsdx * dtdy - dsdy * dtdx) as area,
         atan2(2 * (dsdx * dtdx + dsdy * dtdy), dsdx * dsdx + dsdy * dsdy - dtdx * dtdx - dtdy * dtdy) / 2 as angle from w),
g as (select *, sqrt((ss + sqrt(greatest(ss * ss - 4 * area * area, 0))) / 2) as a0, area / a0 as b0 from f),
e as (
  select id, image_id, s, t, angle, case when a0 / b0 > 8 then (a0 + b0 * 8) / 2 else a0 end as a, case when a0 / b0 > 8 then (a0 + b0 * 8) / 16 else b0 end as b,
         least(greatest(a0 / b0, 1), 8) as aspect from g),
{_levels("b", "least(lw, lh)")},
n as (
  select e.*, greatest(1, cast(floor(2 * case when m = 0 and b * {N} < 0.5 then least(greatest(a * {2 * N}, 1), 8) else aspect end - 1) as int)) as n
  from e left join fits using (id)),
places as (select id, image_id, s, t, angle, a, b, n, case when n = 1 then 0 else 2 * (unnest(range(0, n)) + 0.5) / n - 1 end as p from n),
weighed as (select *, case when n <= 2 then 1 else exp(-2 * pow(p * a / (2 * (a - b)), 2)) end as raw from places),
probes as (select id, image_id, s + p * (a - b) * cos(angle) as s, t + p * (a - b) * sin(angle) as t, raw / sum(raw) over (partition by id) as w from weighed),
spots as (
  select p.id, p.image_id, level as mip, lw, lh, w * share as w, cast(floor(s * lw - 0.5) as bigint) as x0, cast(floor(t * lh - 0.5) as bigint) as y0, s * lw - 0.5 - floor(s * lw - 0.5) as fx, t * lh - 0.5 - floor(t * lh - 0.5) as fy
  from probes p join chosen using (id) join sizes on sizes.mip = level),
taps as (
  select id, image_id, mip, {_wrap('(x0 + i)', 'lw', 'periodic')} as x, {_wrap('(y0 + j)', 'lh', 'mirror')} as y, w * wx * wy as k, w * lw * (2 * i - 1) * wy as ks, w * lh * wx * (2 * j - 1) as kt
  from (select *, case i when 1 then fx else 1 - fx end as wx, case j when 1 then fy else 1 - fy end as wy from spots, (values (0), (1)) u(i), (values (0), (1)) v(j))),
sums as (
  select id, sum(k * c0) as c0, sum(k * c1) as c1, sum(ks * c0) as ds0, sum(ks * c1) as ds1, sum(kt * c0) as dt0, sum(kt * c1) as dt1
  from taps join tiles using (image_id, mip, y, x) group by id)
select q.id, """ + ", ".join(f"round(coalesce({c}, {d}) + 1e-9, 4) + 0.0 as {c}" for c, d in (("c0", -1), ("c1", -2), ("ds0", 0), ("ds1", 0), ("dt0", 0), ("dt1", 0))) + " from q left join sums using (id)"

_CUBIC = lambda f, i: f"case {i} when -1 then pow(1 - {f}, 3) / 6 when 0 then (3 * pow({f}, 3) - 6 * pow({f}, 2) + 4) / 6 when 1 then (-3 * pow({f}, 3) + 3 * pow({f}, 2) + 3 * {f} + 1) / 6 else pow({f}, 3) / 6 end"
_BICUBIC = f"""with {_LEVELS}, {_SIZES}, {_ORDERS},
e as (select id, image_id, s, t, greatest(abs(dsdx), abs(dsdy), abs(dtdx), abs(dtdy), 1e-8) as wide from q),
{_levels("wide", "least(lw, lh)")},
spots as (
  select e.id, e.image_id, level as mip, lw, lh, share as w, cast(floor(s * lw - 0.5) as bigint) as x0, cast(floor(t * lh - 0.5) as bigint) as y0, s * lw - 0.5 - floor(s * lw - 0.5) as fx, t * lh - 0.5 - floor(t * lh - 0.5) as fy
  from e join chosen using (id) join sizes on sizes.mip = level),
taps as (
  select id, image_id, mip, {_wrap('(x0 + i)', 'lw', 'clamp')} as x, {_wrap('(y0 + j)', 'lh', 'black')} as y, w * ({_CUBIC('fx', 'i')}) * ({_CUBIC('fy', 'j')}) as k
  from spots, (select unnest(range(-1, 3)) as i), (select unnest(range(-1, 3)) as j)),
sums as (select id, sum(k * c0) as c0, sum(k * c1) as c1, sum(k) as inside from taps join tiles using (image_id, mip, y, x) group by id)
select q.id, round(case when image_id = 'none' then 0.5 else coalesce(c0, 0) end + 1e-9, 5) + 0.0 as c0, round(case when image_id = 'none' then 0.5 else coalesce(c1, 0) end + 1e-9, 5) + 0.0 as c1,
       round(case when image_id = 'none' then 0.5 else coalesce(inside, 0) * 0.5 end + 1e-9, 5) + 0.0 as c2
from q left join sums using (id)"""

_ENVIRONMENT = f"""with {_LEVELS}, {_SIZES}, {_PARTS},
r as (select id, image_id, rx / l as r0, ry / l as r1, rz / l as r2, (rx + xx) / la as a0, (ry + xy) / la as a1, (rz + xz) / la as a2, (rx + yx) / lb as b0, (ry + yy) / lb as b1, (rz + yz) / lb as b2
  from (select *, sqrt(rx * rx + ry * ry + rz * rz) as l, sqrt(pow(rx + xx, 2) + pow(ry + xy, 2) + pow(rz + xz, 2)) as la, sqrt(pow(rx + yx, 2) + pow(ry + yy, 2) + pow(rz + yz, 2)) as lb from raw)),
f as (select *, greatest(acos(least(greatest(r0 * a0 + r1 * a1 + r2 * a2, -1), 1)), 1e-8) as fa, greatest(acos(least(greatest(r0 * b0 + r1 * b1 + r2 * b2, -1), 1)), 1e-8) as fb from r),
g as (select *, greatest(fa, fb) as g0, least(fa, fb) as s0 from f),
e as (
  select id, image_id, r0, r1, r2, case when fa >= fb then a0 else b0 end as m0, case when fa >= fb then a1 else b1 end as m1, case when fa >= fb then a2 else b2 end as m2,
         case when g0 / s0 > 32 then (g0 + s0 * 32) / 64 else s0 end as wide, cast(greatest(1, ceil(least(greatest(g0 / s0, 1), 32) - 0.25)) as int) as n from g),
{_levels("wide", "lh / pi()")},
placed as (select *, -0.5 + (unnest(range(0, n)) + 0.5) / n as p from e),
moved as (select id, image_id, n, r0 + p * m0 as x, r1 + p * m1 as y, r2 + p * m2 as z from placed),
probes as (select id, image_id, 1.0 / n as w, atan2(-x, z) / (2 * pi()) + 0.5 as s, 0.5 - atan2(y, sqrt(z * z + x * x)) / pi() as t from moved),
faded as (
  select p.id, p.image_id, level as mip, lw, lh, w * share as w, s, t,
         case when lw <= {POLE} and lh <= {POLE} and t * lh < 1 then -1 when lw <= {POLE} and lh <= {POLE} and t * lh > lh - 1 then -2 end as pole,
         case when lw > {POLE} or lh > {POLE} then 0 when t * lh < 1 then pow(least(greatest(1 - t * lh, 0), 1), 2) when t * lh > lh - 1 then pow(t * lh - floor(t * lh), 2) else 0 end as fade
  from probes p join chosen using (id) join sizes on sizes.mip = level),
spots as (select *, cast(floor(s * lw - 0.5) as bigint) as x0, cast(floor(t * lh - 0.5) as bigint) as y0, s * lw - 0.5 - floor(s * lw - 0.5) as fx, t * lh - 0.5 - floor(t * lh - 0.5) as fy from faded),
taps as (
  select id, image_id, mip, {_wrap('(x0 + i)', 'lw', 'periodic')} as x, {_wrap('(y0 + j)', 'lh', 'clamp')} as y, w * (1 - fade) * (case i when 1 then fx else 1 - fx end) * (case j when 1 then fy else 1 - fy end) as k
  from spots, (values (0), (1)) u(i), (values (0), (1)) v(j)
  union all select id, image_id, mip, 0, pole, w * fade from faded where pole is not null),
poles as (
  select image_id, t.mip, p as y, 0 as x, sum(c0) / max(lw) as c0, sum(c1) / max(lw) as c1
  from tiles t join sizes z on z.mip = t.mip, (values (-1), (-2)) v(p) where t.y = case p when -1 then 0 else lh - 1 end group by image_id, t.mip, p),
every as (select image_id, mip, y, x, c0, c1 from tiles union all select image_id, mip, y, x, c0, c1 from poles)
select id, round(coalesce(sum(k * c0), 0) + 1e-9, 5) + 0.0 as c0, round(coalesce(sum(k * c1), 0) + 1e-9, 5) + 0.0 as c1
from taps left join every using (image_id, mip, y, x) group by id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "texture_anisotropic": _aniso, "texture_bicubic_fill": _bicubic, "environment": _environment, "texture_info": _info, "get_texels": _texels, "make_texture_levels": _means, "make_texture_bump": _bump,
}
#: Sobel's weights are the products of a difference and a sum with a middle twice as heavy.
_BUMP = f"""with {_LEVELS},
lattice as (select image_id, cast(yy as int) as y, cast(xx as int) as x from (select distinct image_id from cells), (select unnest(range(0, {M})) as yy), (select unnest(range(0, {N})) as xx)),
h as (select image_id, y, x, coalesce(c0, 0) as c0 from lattice left join cells using (image_id, y, x)),
near as (
  select p.image_id, p.y, p.x, p.c0 as h, i, j, q.c0 as v
  from h p, (select unnest(range(-1, 2)) as i), (select unnest(range(-1, 2)) as j), h q
  where q.image_id = p.image_id and q.x = least(greatest(p.x + i, 0), {N - 1}) and q.y = least(greatest(p.y + j, 0), {M - 1})),
slopes as (
  select image_id, y, x, any_value(h) as h, sum(i * (2 - abs(j)) * v) / 8 * {N} / 16 as s, sum(j * (2 - abs(i)) * v) / 8 * {M} / 16 * -0.5 as t
  from near group by image_id, y, x)
select image_id, y, x, """ + ", ".join(f"round({v} + 1e-9, 5) + 0.0 as c{i}" for i, v in enumerate(("h", "s", "t", "s * s", "t * t", "s * t"))) + " from slopes"

SQL: dict[str, str] = {
    "make_texture_bump": _BUMP,
    "texture_anisotropic": _ANISO,
    "texture_bicubic_fill": _BICUBIC,
    "environment": _ENVIRONMENT,
    "texture_info": f"select l_returnflag as image_id, {N} as width, {M} as height, 7 as levels, 2 as channels, round(sum(l_quantity) / 100 / {N * M}, 6) + 0.0 as mean0, round(count(*) / 10 / {N * M}, 6) + 0.0 as mean1 from lineitem group by l_returnflag",
    "get_texels": f"with {_LEVELS}, area as (select distinct image_id, cast(yy as int) as y, cast(xx as int) as x from cells, lateral (select unnest(range(1, 7)) as yy), (select unnest(range(3, 9)) as xx)) "
    "select image_id, y, x, round(coalesce(c0, 0), 6) + 0.0 as c0, round(coalesce(c1, 0), 6) + 0.0 as c1 from area left join (select * from tiles where mip = 2) using (image_id, y, x)",
    "make_texture_levels": f"with {_LEVELS}, {_SIZES} select image_id, z.mip, max(lw * lh)::bigint as n, round(coalesce(sum(c0), 0) / max(lw * lh), 6) + 0.0 as mean0, round(coalesce(sum(c1), 0) / max(lw * lh), 6) + 0.0 as mean1 from tiles t join sizes z on z.mip = t.mip group by image_id, z.mip",
}
