"""Perceptual differences over the events table: the sums, counts and means of each hour, of even against odd events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, image
from lumenframe.operators import perceptual as P

PPD = 24.0
HDR = P.Exposures("aces", most=2.0)


def pair(spark: SparkSession, sf: str) -> tuple[Image, Image]:
    """Images of days by hours for each event type; the even and the odd events are one image each."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    r = df.agg(F.min(F.dayofyear("ts")), F.max(F.dayofyear("ts"))).first()
    window = Roi(0, 24, int(r[0] or 0), int(r[1] or 0) + 1)
    cells = df.groupBy(F.col("event_type").alias("image_id"), F.dayofyear("ts").alias("y"), F.hour("ts").alias("x"), (F.col("event_id") % 2).alias("side"))
    cells = cells.agg((F.sum("value") / 1000).alias("c0"), (F.count("*") / 10).alias("c1"), (F.avg("value") / 200).alias("c2"))
    a, b = (image(cells.filter(F.col("side") == side), window, list("RGB")) for side in (0, 1))
    return a, b


_PX = """
e as (
  select event_type as image_id, cast(dayofyear(ts) as int) as y, cast(hour(ts) as int) as x, event_id % 2 as side,
         sum(value) / 1000 as c0, count(*) / 10.0::double as c1, avg(value) / 200 as c2
  from events group by all),
w as (select min(y) as y0, max(y) as y1 from e),
lattice as (
  select image_id, cast(yy as int) as y, cast(xx as int) as x
  from (select distinct image_id from e), w, lateral (select unnest(range(w.y0, w.y1 + 1)) as yy), (select unnest(range(0, 24)) as xx)),
px as (
  select l.image_id, l.y, l.x, coalesce(a.c0, 0) as r0, coalesce(a.c1, 0) as r1, coalesce(a.c2, 0) as r2,
         coalesce(b.c0, 0) as t0, coalesce(b.c1, 0) as t1, coalesce(b.c2, 0) as t2
  from lattice l
  left join e a on a.image_id = l.image_id and a.y = l.y and a.x = l.x and a.side = 0
  left join e b on b.image_id = l.image_id and b.y = l.y and b.x = l.x and b.side = 1)"""


def _dot(m, cols: list[str]) -> str:
    return " + ".join(f"{k!r} * {c}" for k, c in zip(m, cols, strict=True))


def _unit(v: str) -> str:
    return f"least(greatest({v}, 0), 1)"


def _flip_sql(px: str, ppd: float) -> str:
    """CTEs up to flips (image_id, k, y, x, flip) of a table px with a key k."""
    white = P.WHITE
    cut = ", ".join(f"{_unit(f'{s}{i}')} as {s}{i}" for s in "rt" for i in range(3))
    xyz = ", ".join(f"({_dot(P.TO_XYZ[i], [f'{s}{j}' for j in range(3)])}) / {white[i]!r} as {s}x{i}" for s in "rt" for i in range(3))
    opponent = ", ".join(f"116 * {s}x1 - 16 as {s}y, 500 * ({s}x0 - {s}x1) as {s}cx, 200 * ({s}x1 - {s}x2) as {s}cz, {s}x1 as {s}l" for s in "rt")
    inner = {"y": ("gy", "y"), "cx": ("gx", "cx"), "z0": ("gz0", "cz"), "z1": ("gz1", "cz"), "fg": ("fg", "l"), "fd": ("fd", "l"), "fdd": ("fdd", "l")}
    outer = {"y": ("gy", "y"), "cx": ("gx", "cx"), "z0": ("gz0", "z0"), "z1": ("gz1", "z1"), "dx": ("fg", "fd"), "ddx": ("fg", "fdd"), "dy": ("fd", "fg"), "ddy": ("fdd", "fg")}
    sums = lambda what: ", ".join(f"sum({tap} * q.{s}{col}) as {s}{name}" for s in "rt" for name, (tap, col) in what.items())
    back = ", ".join(
        f"(({s}y + 16) / 116 + {s}cx / 500) * {white[0]!r} as {s}x0, ({s}y + 16) / 116 as {s}x1, (({s}y + 16) / 116 - ({s}z0 + {s}z1) / 200) * {white[2]!r} as {s}x2, "
        f"sqrt({s}dx * {s}dx + {s}dy * {s}dy) as {s}edge, sqrt({s}ddx * {s}ddx + {s}ddy * {s}ddy) as {s}point"
        for s in "rt"
    )
    rgb = ", ".join(f"{_unit(_dot(P.FROM_XYZ[i], [f'{s}x{j}' for j in range(3)]))} as {s}{i}" for s in "rt" for i in range(3))
    lab = lambda t: f"case when {t} > pow(6.0 / 29, 3) then cbrt({t}) else {t} * 841 / 108 + 4.0 / 29 end"
    curves = ", ".join(f"{lab(f'{s}x{i}')} as {s}f{i}" for s in "rt" for i in range(3))
    hunt = ", ".join(f"116 * {s}f1 - 16 as {s}l, (116 * {s}f1 - 16) * 5 * ({s}f0 - {s}f1) as {s}a, (116 * {s}f1 - 16) * 2 * ({s}f1 - {s}f2) as {s}b" for s in "rt")
    names = ", ".join(f"{s}edge, {s}point" for s in "rt")
    return f"""
offsets as (select unnest(range(-40, 41)) as o),
raw as (
  select o, exp(-pow(pi() * o / {ppd}, 2) / 0.0047) as gy, exp(-pow(pi() * o / {ppd}, 2) / 0.0053) as gx,
         sqrt(34.1 * sqrt(pi() / 0.04)) * exp(-pow(pi() * o / {ppd}, 2) / 0.04) as gz0,
         sqrt(13.5 * sqrt(pi() / 0.025)) * exp(-pow(pi() * o / {ppd}, 2) / 0.025) as gz1
  from offsets where abs(o) <= ceil(3 * sqrt(0.04 / (2 * pi() * pi())) * {ppd})),
spatial as (
  select o, gy / sum(gy) over () as gy, gx / sum(gx) over () as gx,
         gz0 / sqrt(pow(sum(gz0) over (), 2) + pow(sum(gz1) over (), 2)) as gz0,
         gz1 / sqrt(pow(sum(gz0) over (), 2) + pow(sum(gz1) over (), 2)) as gz1 from raw),
bell as (select o, exp(-o * o / (2 * pow(0.041 * {ppd}, 2))) as g from offsets where abs(o) <= ceil(3 * 0.041 * {ppd})),
signed as (select o, g, -o * g as d, (o * o / pow(0.041 * {ppd}, 2) - 1) * g as dd from bell),
feature as (
  select o, g / sum(g) over () as fg, d / (case when d >= 0 then sum(greatest(d, 0)) over () else -sum(least(d, 0)) over () end) as fd,
         dd / (case when dd >= 0 then sum(greatest(dd, 0)) over () else -sum(least(dd, 0)) over () end) as fdd from signed),
taps as (
  select o, coalesce(gy, 0) as gy, coalesce(gx, 0) as gx, coalesce(gz0, 0) as gz0, coalesce(gz1, 0) as gz1,
         coalesce(fg, 0) as fg, coalesce(fd, 0) as fd, coalesce(fdd, 0) as fdd
  from offsets left join spatial using (o) left join feature using (o) where spatial.o is not null or feature.o is not null),
cut as (select image_id, k, y, x, {cut} from {px}),
cie as (select image_id, k, y, x, {xyz} from cut),
seen as (select image_id, k, y, x, {opponent} from cie),
across as (
  select p.image_id, p.k, p.y, p.x, {sums(inner)}
  from seen p, taps, seen q
  where q.image_id = p.image_id and q.k = p.k and q.y = p.y and q.x = least(greatest(p.x + o, 0), 23) group by p.image_id, p.k, p.y, p.x),
down as (
  select p.image_id, p.k, p.y, p.x, {sums(outer)}
  from across p, w, taps, across q
  where q.image_id = p.image_id and q.k = p.k and q.x = p.x and q.y = least(greatest(p.y + o, w.y0), w.y1) group by p.image_id, p.k, p.y, p.x),
back as (select image_id, k, y, x, {back} from down),
rgb as (select image_id, k, y, x, {names}, {rgb} from back),
again as (select image_id, k, y, x, {names}, {xyz} from rgb),
curved as (select image_id, k, y, x, {names}, {curves} from again),
hunt as (select image_id, k, y, x, {names}, {hunt} from curved),
far_xyz as (select {", ".join(f"{_unit(str(j))} * {P.TO_XYZ[i][1]!r} / {white[i]!r} as rx{i}, {P.TO_XYZ[i][2]!r} / {white[i]!r} as tx{i}" for i in range(3) for j in (1,))}),
far_f as (select {curves} from far_xyz),
far as (select {hunt} from far_f),
most as (select pow(abs(rl - tl) + sqrt(pow(ra - ta, 2) + pow(rb - tb, 2)), 0.7) as m from far),
differences as (
  select image_id, k, y, x, pow(abs(rl - tl) + sqrt(pow(ra - ta, 2) + pow(rb - tb, 2)), 0.7) as c,
         sqrt(greatest(abs(redge - tedge), abs(rpoint - tpoint)) / sqrt(2)) as f from hunt),
flips as (
  select image_id, k, y, x,
         pow(case when c < 0.4 * m then c * 0.95 / (0.4 * m) else 0.95 + (c - 0.4 * m) / (0.6 * m) * 0.05 end, 1 - f) as flip
  from differences, most)"""


_SUMMARY = """
select image_id, round(case when abs(avg(flip)) < 1e-6 then 0 else avg(flip) end, 6) + 0.0 as mean_error,
       round(case when abs(max(flip)) < 1e-6 then 0 else max(flip) end, 6) + 0.0 as max_error from {} group by image_id"""


def _ldr(spark: SparkSession, sf: str) -> DataFrame:
    out = P.flip_diff(*pair(spark, sf), PPD, None)
    return out.df.select("image_id", "y", "x", (F.round("c0", 6) + 0.0).alias("flip"))


def _hdr(spark: SparkSession, sf: str) -> DataFrame:
    out = P.flip_diff(*pair(spark, sf), PPD, HDR)
    return out.df.select("image_id", "y", "x", (F.round("c0", 6) + 0.0).alias("flip"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.flip_results(P.flip_diff(*pair(spark, sf), PPD, HDR))
    return rows.select("image_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_error", "max_error")])


def _yee_map(spark: SparkSession, sf: str) -> DataFrame:
    out = P.visible_differences(*pair(spark, sf), 100.0, 45.0)
    return out.df.select("image_id", "y", "x", (F.round("c0", 5) + 0.0).alias("factor"), F.col("c1").cast("int").alias("fails"))


def _yee(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.compare_yee(*pair(spark, sf), 100.0, 45.0)
    return rows.select("image_id", "n_fail", (F.round("max_error", 5) + 0.0).alias("max_error"))


_LDR = f"with {_PX}, one as (select *, 0 as k from px), {_flip_sql('one', PPD)}"
_T = P.TONES["aces"]
_TONED = ", ".join(
    f"(pow({s}{i} * gain, 2) * {_T[0]!r} + {s}{i} * gain * {_T[1]!r}) / (pow({s}{i} * gain, 2) * {_T[3]!r} + {s}{i} * gain * {_T[4]!r} + {_T[5]!r}) as {s}{i}"
    for s in "rt" for i in range(3)
)
#: The curve reaches 0.85 at the positive root of a quadratic.
_HDR = f"""with {_PX},
quadratic as (select {_T[0]!r} - 0.85 * {_T[3]!r} as a, {_T[1]!r} - 0.85 * {_T[4]!r} as b, -0.85 * {_T[5]!r} as c),
root as (select greatest((-b + sqrt(b * b - 4 * a * c)) / (2 * a), (-b - sqrt(b * b - 4 * a * c)) / (2 * a)) as v from quadratic),
span as (select log2(v / 2.0) as lo, log2(v / 0.18) as hi, cast(greatest(2, ceil(log2(v / 0.18) - log2(v / 2.0))) as int) as n from root),
gains as (select unnest(range(0, n)) as k, lo, hi, n from span),
gained as (select k, pow(2, lo + k * (hi - lo) / (n - 1)) as gain from gains),
toned as (select image_id, k, y, x, {_TONED} from px, gained), {_flip_sql('toned', PPD)}"""

_CS = "440 * pow(1 + 0.7 / {lum}, -0.2) * {c} * exp(-0.3 * pow(1 + 100 / {lum}, 0.15) * {c}) * sqrt(1 + 0.06 * exp(0.3 * pow(1 + 100 / {lum}, 0.15) * {c}))"


def _yee_sql() -> str:
    """CTEs up to judged (image_id, y, x, factor, fails)."""
    adobe = P.ADOBE
    xyz = ", ".join(f"{_dot(adobe[i], [f'{s}{j}' for j in range(3)])} as {s}x{i}" for s in "rt" for i in range(3))
    curve = lambda v: f"case when {v} > 216.0 / 24389 then cbrt({v}) else (24389.0 / 27 * {v} + 16) / 116 end"
    f = ", ".join(f"{curve(f'({s}x{i} / {sum(adobe[i])!r})')} as {s}f{i}" for s in "rt" for i in range(3))
    hue = "pow(500 * (rf0 - rf1) - 500 * (tf0 - tf1), 2) + pow(200 * (rf1 - rf2) - 200 * (tf1 - tf2), 2)"
    ctes = [f"cie as (select image_id, y, x, {xyz} from px)", f"lab as (select image_id, y, x, 100 * rx1 as r, 100 * tx1 as t, {f} from cie)", f"l0 as (select image_id, y, x, r, t, {hue} as hue from lab)"]
    ctes.append("tap as (select o, exp(-8.0 * o * o / 25) / sum(exp(-8.0 * o * o / 25)) over () as g from (select unnest(range(-2, 3)) as o))")
    for i in range(1, 8):
        ctes.append(f"m{i} as (select p.image_id, p.y, p.x, sum(g * q.r) as r, sum(g * q.t) as t from l{i - 1} p, tap, l{i - 1} q where q.image_id = p.image_id and q.y = p.y and q.x = least(greatest(p.x + o, 0), 23) group by all)")
        ctes.append(f"l{i} as (select p.image_id, p.y, p.x, sum(g * q.r) as r, sum(g * q.t) as t from m{i} p, w, tap, m{i} q where q.image_id = p.image_id and q.x = p.x and q.y = least(greatest(p.y + o, w.y0), w.y1) group by all)")
    ctes.append("degrees as (select 2 * tan(radians(22.5)) * 180 / pi() as n)")
    steps = ", ".join(f"greatest(abs(l{i}.r - l{i + 1}.r), abs(l{i}.t - l{i + 1}.t)) / greatest(abs(l{i + 2}.r), abs(l{i + 2}.t), 1e-5) as k{i}" for i in range(6))
    joins = " ".join(f"join l{i} using (image_id, y, x)" for i in range(1, 8))
    # 47.5 pixels are a degree's, and 2 to the fifth is the last power below.
    ctes.append(f"k as (select image_id, y, x, l0.hue as hue, abs(l0.r - l0.t) as step, greatest((l5.r + l5.t) / 2, 1e-5) as adapt, {steps} from l0 {joins})")
    best = _CS.format(lum="100.0", c="3.248")
    cpd = lambda i: f"(12.0 / degrees.n / {2**i})"
    parts = " + ".join(
        f"k{i} * ({best}) / ({_CS.format(lum='100.0', c=cpd(i))}) * pow(1 + pow(0.0153 * pow(392.498 * k{i} * {_CS.format(lum='adapt', c=cpd(i))}, 0.7), 4), 0.25)" for i in range(6)
    )
    ctes.append(f"factors as (select image_id, y, x, hue, step, adapt, log10(adapt) as v, least(greatest(({parts}) / greatest({' + '.join(f'k{i}' for i in range(6))}, 1e-5), 1), 10) as factor from k, degrees)")
    tvi = "pow(10, case when v < -3.94 then -2.86 when v < -1.44 then pow(0.405 * v + 1.6, 2.18) - 2.86 when v < -0.0184 then v - 0.395 when v < 1.9 then pow(0.249 * v + 0.65, 2.7) - 0.72 else v - 1.255 end)"
    ctes.append(f"judged as (select image_id, y, x, factor, cast(step / {tvi} > factor or hue * case when adapt < 10 then 0.01 else 1 end > factor as int) as fails from factors)")
    return f"with {_PX}, " + ",\n".join(ctes)


_YEE = _yee_sql()
_FLIPPED = "select image_id, y, x, round(max(flip), 6) + 0.0 as flip from flips group by image_id, y, x"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"flip_diff_ldr": _ldr, "flip_diff_hdr": _hdr, "flip_results": _results, "visible_differences": _yee_map, "compare_yee": _yee}
SQL: dict[str, str] = {
    "flip_diff_ldr": f"{_LDR} {_FLIPPED}",
    "flip_diff_hdr": f"{_HDR} {_FLIPPED}",
    "flip_results": f"{_HDR}, best as (select image_id, y, x, max(flip) as flip from flips group by image_id, y, x) {_SUMMARY.format('best')}",
    "visible_differences": f"{_YEE} select image_id, y, x, round(factor, 5) + 0.0 as factor, fails from judged",
    "compare_yee": f"{_YEE} select image_id, count(*) filter (where fails = 1) as n_fail, round(coalesce(max(factor) filter (where fails = 1), 0), 5) + 0.0 as max_error from judged group by image_id",
}
