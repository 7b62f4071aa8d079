"""Object mattes: pairs of channels hold the hash of an object's name, as the bits of a float, and its coverage.

The channels of a layer are called layer00.red, layer00.green (the first pair),
layer00.blue, layer00.alpha (the second), layer01.red and so on; pairs are sorted by
falling coverage.  Hashes, mixing and the bits of floats are column expressions in
64-bit integers; lambda variables hold what is used more than once, so that
expressions do not double with each step.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, Spec, default_names, total

#: Pairs of less coverage, and those of hash 0, are no object.
LEAST_COVERAGE = 1e-5
SUFFIXES = ("red", "green", "blue", "alpha")

# Constants of the 32-bit murmur hash and its final mixing, and what is added between two colours.
BLOCK_FIRST, BLOCK_SECOND, BLOCK_ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
MIX_FIRST, MIX_SECOND = 0x85EBCA6B, 0xC2B2AE35
GREEN_STEP, BLUE_STEP = 0x0101, 0x020000

_WORD = 0xFFFFFFFF


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _times(h: Column, by: int) -> Column:
    """h * by modulo 2^32, by halves, as the whole product would leave 64 bits."""
    return _let(h, lambda v: (v.bitwiseAND(0xFFFF) * by + F.shiftleft((F.shiftright(v, 16) * by).bitwiseAND(0xFFFF), 16)).bitwiseAND(_WORD))


def _turned(h: Column, by: int) -> Column:
    return _let(h, lambda v: F.shiftleft(v, by).bitwiseOR(F.shiftright(v, 32 - by)).bitwiseAND(_WORD))


def _folded(h: Column, by: int) -> Column:
    return _let(h, lambda v: v.bitwiseXOR(F.shiftright(v, by)))


def mixed(h: Column) -> Column:
    """Final mixing of a 32-bit hash, a long."""
    return _folded(_times(_folded(_times(_folded(h, 16), MIX_FIRST), 13), MIX_SECOND), 16)


def _scrambled(block: Column) -> Column:
    return _times(_turned(_times(block, BLOCK_FIRST), 15), BLOCK_SECOND)


def _murmur(digits: Column) -> Column:
    n = F.length(digits).cast("long") / 2

    def little(at: Column, length: int) -> Column:
        """The bytes from at (from 0) as a little-endian number."""
        byte = lambda k: F.conv(F.substr(digits, (at + k) * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return total([F.shiftleft(byte(k), 8 * k) for k in range(length)])

    blocks = F.floor(n / 4).cast("int")
    starts = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(starts, F.lit(0).cast("long"), lambda h, b: (_turned(h.bitwiseXOR(_scrambled(little(b * 4, 4))), 13) * 5 + BLOCK_ADD).bitwiseAND(_WORD))
    for k in (1, 2, 3):
        h = h.bitwiseXOR(F.when(n % 4 == k, _scrambled(little(blocks * 4, k))).otherwise(F.lit(0).cast("long")))
    return mixed(h.bitwiseXOR(n.cast("long")))


def murmur(name: Column) -> Column:
    """32-bit murmur hash, seed 0, of a string's UTF-8 bytes, a long; null for null."""
    return F.when(name.isNotNull(), _let(F.hex(F.encode(name, "utf-8")), _murmur))


def object_bits(name: Column) -> Column:
    """The hash of a name, with a bit of the exponent flipped where the float would be no finite normal number."""
    return _let(murmur(name), lambda h: F.when(F.shiftright(h, 23).bitwiseAND(255).isin(0, 255), h.bitwiseXOR(1 << 23)).otherwise(h))


def _float_of(bits: Column) -> Column:
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND((1 << 23) - 1)
    size = F.when(exponent == 255, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    size = size.when(exponent == 0, fraction * F.lit(2.0**-149)).otherwise((1 + fraction / F.lit(2.0**23)) * F.pow(F.lit(2.0), exponent.cast("double") - 127))
    return size * F.when(F.shiftright(bits, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)


def float_of(bits: Column) -> Column:
    """The double equal to the 32-bit float with these bits."""
    return _let(bits, _float_of)


def _bits_of(v: Column) -> Column:
    size = F.abs(v)

    def normal(exponent: Column) -> Column:
        return (exponent + 127).cast("long") * (1 << 23) + ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**23)).cast("long")

    # The logarithm may be off by one next to a power of two.
    near = lambda e: F.when(size < F.pow(F.lit(2.0), e), e - 1).when(size >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)
    own = F.when(F.isnan(v), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size < 2.0**-126, (size * F.lit(2.0**149)).cast("long"))
    own = own.otherwise(_let(_let(F.floor(F.log2(size)).cast("double"), near), normal))
    return own + F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))


def bits_of(value: Column) -> Column:
    """The bits, as a long, of the 32-bit float nearest to a double; all values that are no number have the same."""
    return _let(value.cast("float").cast("double"), _bits_of)


def pairs(spec: Spec, layer: str) -> list[tuple[int, int]]:
    """(hash, coverage) channels of a layer, in the image's order; a last one without its partner is left out."""
    own = [i for i, name in enumerate(spec.names) if re.fullmatch(re.escape(layer) + r"[0-9][0-9]\..*", name)]
    return list(zip(own[::2], own[1::2], strict=False))


def colors(a: Image, layer: str) -> Image:
    """R, G, B of each pixel: its objects' colours, made of their hashes, weighted by coverage; black where there is none."""
    rgb = lambda r: _let(mixed((r + GREEN_STEP).bitwiseAND(_WORD)), lambda g: F.array(r, g, mixed((g + BLUE_STEP).bitwiseAND(_WORD))))
    own, sums = {}, [F.lit(0.0)] * 3
    for i, j in pairs(a.spec, layer):
        own[f"h{i}"] = F.when((a.c[j] >= LEAST_COVERAGE) & (a.c[i] != 0), _let(mixed(bits_of(a.c[i])), rgb))
        sums = [v + F.coalesce(a.c[j] * F.col(f"h{i}")[k] / float(_WORD), F.lit(0.0)) for k, v in enumerate(sums)]
    return replace(a, df=a.df.withColumns(own) if own else a.df).with_channels(sums, default_names(3))


def encode(objects: DataFrame, data: Roi, layer: str = "object", ranks: int | None = None) -> Image:
    """The mattes of a table of image_id, y, x (z, else 0), name and coverage.

    Coverages of one name in one pixel are added.  All objects of a pixel are kept:
    ranks, if not given, is the largest number in a pixel, at the price of a job; if
    given, those of least coverage beyond it are lost, as the format has it.  Of equal
    coverages the smaller name is first.  Rows with a null or no coverage count nothing.
    """
    z = F.col("z").cast("int") if "z" in objects.columns else F.lit(0)
    rows = objects.filter((F.col("coverage") > 0) & F.col("name").isNotNull())
    rows = rows.groupBy(F.col("image_id").cast("string").alias("image_id"), z.alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "name").agg(F.sum("coverage").cast("double").alias("coverage"))
    own = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("less"), "name"))).alias("own"))
    if ranks is None:
        ranks = own.agg(F.max(F.size("own"))).first()[0] or 0
    made, names = [], []
    for k in range(ranks):
        one = F.get("own", F.lit(k))
        made += [F.coalesce(float_of(object_bits(one["name"])), F.lit(0.0)), F.coalesce(-one["less"], F.lit(0.0))]
        names += [f"{layer}{k // 2:02d}.{s}" for s in SUFFIXES[k % 2 * 2 : k % 2 * 2 + 2]]
    return Image(own.select(*KEYS, *[c.alias(f"c{i}") for i, c in enumerate(made)]), Spec(data, data, tuple(names)))


def fragments(a: Image, layer: str) -> DataFrame:
    """A row for each object of each pixel: the key of the pixel, bits and coverage."""
    own = [F.struct(bits_of(a.c[i]).alias("bits"), a.c[j].alias("coverage"), (a.c[i] != 0).alias("some")) for i, j in pairs(a.spec, layer)]
    if not own:
        return a.df.limit(0).select(*KEYS, F.lit(0).cast("long").alias("bits"), F.lit(0.0).alias("coverage"))
    rows = a.df.select(*KEYS, F.explode(F.array(*own)).alias("o")).select(*KEYS, "o.*")
    return rows.filter(F.col("some") & (F.col("coverage") >= LEAST_COVERAGE)).drop("some")


def coverage_by_name(a: Image, names: DataFrame, layer: str = "object") -> DataFrame:
    """image_id, bits, name, pixels and coverage of each object; names is a table with a column name.

    An object whose hash no name has gets a null name; names of one hash are joined by
    a comma in order.  Fragments are added up before they meet the names.
    """
    found = fragments(a, layer).groupBy("image_id", "bits").agg(F.count("*").alias("pixels"), F.sum("coverage").alias("coverage"))
    table = names.select("name").dropna().distinct().groupBy(object_bits(F.col("name")).alias("bits")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("name"))
    return found.join(table, "bits", "left").select("image_id", "bits", "name", "pixels", "coverage")


def matte(a: Image, chosen: list[str], layer: str = "object") -> Image:
    """One channel: the coverage of the chosen objects together, clamped to one."""
    wanted = [object_bits(F.lit(n)) for n in chosen]
    own = [F.when((a.c[j] >= LEAST_COVERAGE) & (a.c[i] != 0) & bits_of(a.c[i]).isin(*wanted), a.c[j]).otherwise(0.0) for i, j in pairs(a.spec, layer)]
    one = a.with_channels([F.least(total(own), F.lit(1.0)) if own and wanted else F.lit(0.0)], ["A"])
    return replace(one, spec=replace(one.spec, attribs=dict(a.spec.attribs)))
