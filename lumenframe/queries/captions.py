"""Captions of suppliers, and mattes of what each supplier ships in each month; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, image
from lumenframe.operators import cryptomatte as M
from lumenframe.operators import text as T

SIZE, WIDTH, HEIGHT, SHADOW = 14, 160, 40, 1
COLOR, AT = (0.9, 0.5), (80, 12)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's name over that of its nation."""
    nations = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return _table(spark, sf, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("image_id"), F.concat("s_name", F.lit("\n"), "n_name").alias("text"))


def _balances(spark: SparkSession, sf: str) -> Image:
    """A line for each supplier's balance, across row 10."""
    rows = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(10).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"), (F.col("s_acctbal") / 10000).alias("c0"), F.lit(1.0).alias("c1"))
    return image(rows, Roi(0, WIDTH, 0, HEIGHT), ["Y", "A"])


def _text_size(spark: SparkSession, sf: str) -> DataFrame:
    return T.text_size(_captions(spark, sf), SIZE)


def _render_text(spark: SparkSession, sf: str) -> DataFrame:
    out = T.render_text(_balances(spark, sf), _captions(spark, sf), *AT, SIZE, list(COLOR), alignx="center", shadow=SHADOW)
    return out.df.select("image_id", "y", "x", *[(F.round(c + 1e-9, 6) + 0.0).alias(f"c{i}") for i, c in enumerate(out.c)])


def _font_sql() -> str:
    """The strokes and advances of the font; positions, coverage and boxes follow in SQL."""
    font = T.Font()
    chars = [c for c in font.characters if c]
    quoted = {c: "'" + c.replace("'", "''") + "'" for c in chars}
    strokes = ", ".join(f"({quoted[c]}, {', '.join(repr(float(v)) for v in s)})" for c in chars for s in font.strokes(c))
    advances = ", ".join(f"({quoted[c]}, {font.advance(c, SIZE)})" for c in chars)
    dist = (
        f"select ch, i, j, sqrt(pow(i + 0.5 - {SIZE} * x0 - t * dx, 2) + pow(j + 0.5 - {SIZE} * y0 - t * dy, 2)) as far from (select *, case when dx = 0 and dy = 0 then 0 else "
        f"least(greatest(((i + 0.5 - {SIZE} * x0) * dx + (j + 0.5 - {SIZE} * y0) * dy) / (dx * dx + dy * dy), 0), 1) end as t from (select *, {SIZE} * (x1 - x0) as dx, {SIZE} * (y1 - y0) as dy from strokes), "
        f"(select unnest(range(-{SIZE}, {2 * SIZE})) as i), (select unnest(range(-{2 * SIZE}, {SIZE})) as j))"
    )
    return (
        f"with strokes(ch, x0, y0, x1, y1) as (values {strokes}), advances(ch, step) as (values {advances}), "
        "cap as (select cast(s_suppkey as varchar) as image_id, [s_name, n_name] as own from supplier join nation on s_nationkey = n_nationkey), "
        "parts as (select image_id, own[k] as line, k - 1 as n from cap, lateral (select unnest([1, 2]) as k)), "
        "chars as (select image_id, n, i as pos, line[i] as ch from parts, lateral (select unnest(range(1, length(line) + 1)) as i)), "
        f"pens as (select image_id, ch, n * {SIZE} as py, coalesce(sum(step) over (partition by image_id, n order by pos rows between unbounded preceding and 1 preceding), 0) as px from chars join advances using (ch)), "
        f"glyphs as (select ch, i, j, least(greatest(0.5 + {SIZE} * 0.04 - min(far), 0), 1) as b from ({dist}) group by ch, i, j having b > 0), "
        "hits as (select image_id, px + i as x, py + j as y, b from pens join glyphs using (ch)), "
        "sizes as (select image_id, min(x) as x0, max(x) + 1 as x1, min(y) as y0, max(y) + 1 as y1 from hits group by image_id)"
    )


_TEXT_SIZE = _font_sql() + " select image_id, cast(x0 as int) as x0, cast(x1 as int) as x1, cast(y0 as int) as y0, cast(y1 as int) as y1 from sizes"
_AROUND = f"(select unnest(range(-{SHADOW}, {SHADOW + 1})) as u), (select unnest(range(-{SHADOW}, {SHADOW + 1})) as v)"
_RENDER = (
    _font_sql() + f", placed as (select h.image_id, h.x + {AT[0]} - ((x1 - x0) // 2 + x0) as x, h.y + {AT[1]} as y, b from hits h join sizes using (image_id)), "
    "ink as (select image_id, x, y, max(b) as ink from placed group by all), "
    f"shade as (select image_id, x + u as x, y + v as y, max(b) as shade from placed, {_AROUND} group by 1, 2, 3), "
    f"ground as (select cast(s_suppkey as varchar) as image_id, x, 10 as y, s_acctbal / 10000 as c0, 1.0::double as c1 from supplier, (select unnest(range(0, {WIDTH})) as x)), "
    f"seen as (select s.*, coalesce(ink, 0) as ink from shade s left join ink using (image_id, x, y) where x between 0 and {WIDTH - 1} and y between 0 and {HEIGHT - 1}) "
    "select image_id, cast(y as int) as y, cast(x as int) as x, "
    + ", ".join(f"round(coalesce(ink, 0) * {v} + (1 - coalesce(shade, 0) * {COLOR[1]}) * coalesce(c{i}, 0) + 1e-9, 6) + 0.0 as c{i}" for i, v in enumerate(COLOR))
    + " from ground full join seen using (image_id, x, y)"
)


def mattes(spark: SparkSession, sf: str) -> Image:
    """Month by supplier: the types of parts shipped, by their share of the quantity."""
    parts = _table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
    rows = _table(spark, sf, "lineitem").join(parts, "l_partkey").groupBy(F.col("l_suppkey").alias("y"), (F.month("l_shipdate") - 1).alias("x"), "name").agg(F.sum("l_quantity").alias("q"))
    whole = rows.groupBy("y", "x").agg(F.sum("q").alias("whole"))
    objects = rows.join(whole, ["y", "x"]).select(F.lit("0").alias("image_id"), "y", "x", "name", (F.col("q") / F.col("whole")).alias("coverage"))
    high = _table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0]
    return M.encode(objects, Roi(0, 12, 0, int(high or 0) + 1))


def _matte_names(spark: SparkSession, sf: str) -> DataFrame:
    found = M.coverage_by_name(mattes(spark, sf), _table(spark, sf, "part").select(F.col("p_type").alias("name")))
    return found.select("image_id", "bits", "name", "pixels", (F.round(F.col("coverage") + 1e-9, 6) + 0.0).alias("coverage"))


def _matte_colors(spark: SparkSession, sf: str) -> DataFrame:
    out = M.colors(mattes(spark, sf), "object")
    return out.df.select("image_id", "y", "x", *[(F.round(c + 1e-9, 6) + 0.0).alias(f"c{i}") for i, c in enumerate(out.c)])


def _let(value: str, f: str) -> str:
    return f"list_transform([{value}], lambda v: {f})[1]"


def _mul(h: str, by: int) -> str:
    return f"((({h})::hugeint * {by}) % 4294967296)::bigint"


def _mix(h: str) -> str:
    fold = lambda v, by: _let(v, f"xor(v, v >> {by})")
    return fold(_mul(fold(_mul(fold(h, 16), M.MIX_FIRST), 13), M.MIX_SECOND), 16)


_SCRAMBLED = _mul(_let(_mul("v", M.BLOCK_FIRST), "v * 32768 % 4294967296 + v // 131072"), M.BLOCK_SECOND)
_MATTES = (
    "with t as (select distinct p_type as name, length(p_type) as n from part where p_type is not null), "
    "bytes as (select name, n, i, ascii(name[i + 1])::bigint as b from t, lateral (select unnest(range(0, n)) as i)), "
    "words as (select name, n, i // 4 as k, i // 4 < n // 4 as whole, sum(b << (8 * (i % 4)))::bigint as v from bytes group by all), "
    f"scrambled as (select name, n, k, whole, {_SCRAMBLED} as s from words), "
    f"reduced as (select name, n, list_reduce(list_prepend(0::bigint, coalesce(list(s order by k) filter (where whole), []::bigint[])), "
    f"lambda h, s: (((xor(h, s) * 8192) % 4294967296 + xor(h, s) // 524288) * 5 + {M.BLOCK_ADD}) % 4294967296) as h, coalesce(max(s) filter (where not whole), 0) as tail from scrambled group by name, n), "
    f"hashed as (select name, {_mix('xor(xor(h, tail), n)')} as h from reduced), "
    "ids as (select name, case when (h >> 23) & 255 in (0, 255) then xor(h, 8388608) else h end as bits from hashed), "
    "r as (select l_suppkey as y, month(l_shipdate) - 1 as x, p_type as name, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey where p_type is not null group by all), "
    "shares as (select y, x, name, q / sum(q) over (partition by y, x) as coverage from r)"
)
_COLORED = (
    f", one as (select name, {_mix('bits')} as r from ids), two as (select *, {_mix(f'((r + {M.GREEN_STEP}) % 4294967296)')} as g from one), "
    f"three as (select *, {_mix(f'((g + {M.BLUE_STEP}) % 4294967296)')} as b from two) "
    "select '0' as image_id, cast(y as int) as y, cast(x as int) as x, "
    + ", ".join(f"round(sum(coverage * {c} / 4294967295.0) + 1e-9, 6) + 0.0 as c{i}" for i, c in enumerate("rgb"))
    + " from shares join three using (name) group by y, x"
)

QUERIES = {"text_size": _text_size, "render_text": _render_text, "cryptomatte_names": _matte_names, "cryptomatte_colors": _matte_colors}
SQL = {
    "text_size": _TEXT_SIZE,
    "render_text": _RENDER,
    "cryptomatte_names": f"{_MATTES} select '0' as image_id, bits, name, count(*) as pixels, round(sum(coverage) + 1e-9, 6) + 0.0 as coverage from shares join ids using (name) group by bits, name",
    "cryptomatte_colors": _MATTES + _COLORED,
}
