"""Object mattes against plain Python."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, Spec
from lumenframe.operators import cryptomatte as M
from lumenframe.plans.command import command_line

NAMES = ["", "a", "ab", "abc", "abcd", "hello", "Brand#12", "größe", "x" * 37, "STANDARD", "日本語"]
#: Published results of the 32-bit hash with seed 0.
KNOWN = {"": 0, "a": 0x3C2569B2, "abc": 0xB3DD93FA, "hello": 0x248BFA47, "test": 0xBA6BD213, "Hello, world!": 0xC0363E43}


def fmix(h):
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by % 2**32
    return h ^ h >> 16


def test_murmur(spark):
    df = spark.createDataFrame([(n,) for n in KNOWN] + [(None,)], "name string")
    assert {r[0]: r[1] for r in df.select("name", M.murmur(F.col("name"))).collect()} == {**KNOWN, None: None}


def test_bits(spark):
    rng = np.random.default_rng(0)
    bits = [*map(int, rng.integers(0, 2**32, 3000)), 0, 1, 0x007FFFFF, 0x00800000, 0x3F800000, 0x3F7FFFFF, 0x7F7FFFFF, 0x7F800000, 0xFF800000, *(e << 23 for e in range(1, 255)), *((e << 23) - 1 for e in range(2, 255))]
    bits = [b for b in bits if (b >> 23) % 256 != 255 or b % 2**23 == 0]
    rows = spark.createDataFrame([(b, struct.unpack("f", struct.pack("I", b))[0]) for b in bits], "b long, v double")
    got = rows.select("b", "v", M.bits_of(F.col("v")).alias("back"), M.float_of(F.col("b")).alias("f")).collect()
    assert all(r["back"] == r["b"] and r["f"] == r["v"] for r in got if r["b"] != 2**31)
    assert spark.range(1).select(M.bits_of(F.lit(float("nan")))).first()[0] == 0x7FC00000


def scene(spark):
    rng = np.random.default_rng(1)
    rows = [("p", int(y), int(x), NAMES[k], float(c)) for y in range(5) for x in range(6) for k, c in zip(rng.choice(len(NAMES), 4), rng.uniform(0.01, 0.2, 4), strict=True)]
    rows += [("p", 0, 0, None, 0.5), ("p", 0, 0, "a", None), ("p", 4, 5, "abcd", 0.0), ("q", 2, 2, "a", 1.0)]
    return rows, spark.createDataFrame(rows, "image_id string, y int, x int, name string, coverage double")


def test_names_and_colours(spark):
    rows, df = scene(spark)
    a = M.encode(df, Roi(0, 6, 0, 5))
    assert a.spec.names[:5] == ("object00.red", "object00.green", "object00.blue", "object00.alpha", "object01.red")
    sums = {}
    for i, y, x, n, c in rows:
        if n is not None and c:
            sums[i, y, x, n] = sums.get((i, y, x, n), 0) + c
    want = {}
    for (i, _, _, n), c in sums.items():
        k, s = want.get((i, n), (0, 0.0))
        want[i, n] = k + 1, s + c
    known = [n for n in NAMES if n != "hello"]
    got = M.coverage_by_name(a, spark.createDataFrame([(n,) for n in [*known, "a", None]], "name string")).collect()
    assert {(r["image_id"], r["name"] if r["name"] is not None else "hello"): r["pixels"] for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r["coverage"] - want[r["image_id"], r["name"] if r["name"] is not None else "hello"][1]) < 1e-9 for r in got)
    bits = {n: r for n, r in spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", M.object_bits(F.col("name"))).collect()}
    colour = {}
    for (i, y, x, n), c in sums.items():
        r = fmix(bits[n])
        g = fmix((r + 0x101) % 2**32)
        b = fmix((g + 0x20000) % 2**32)
        colour[i, y, x] = colour.get((i, y, x), 0) + c * np.array([r, g, b]) / (2**32 - 1)
    shown = {(r["image_id"], r["y"], r["x"]): np.array([r["c0"], r["c1"], r["c2"]]) for r in M.colors(a, "object").df.collect()}
    assert shown.keys() == colour.keys() and all(np.allclose(shown[k], colour[k], atol=1e-9) for k in colour)
    chosen = {(r["image_id"], r["y"], r["x"]): r["c0"] for r in M.matte(a, ["a", "abc"]).df.collect()}
    assert all(chosen[k] == pytest.approx(sum(c for (i, y, x, n), c in sums.items() if (i, y, x) == k and n in ("a", "abc"))) for k in chosen)
    top = command_line(spark, ["a", "--cryptomatte-colors", "object"], reader=lambda s, n: a).stack[-1]
    assert top.spec.names == ("R", "G", "B") and {(r["image_id"], r["y"], r["x"]): r["c0"] for r in top.df.collect()} == {k: v[0] for k, v in shown.items()}


def test_corners(spark):
    """No objects, a layer that is not there, tiny coverage, and channels without a partner."""
    empty = M.encode(spark.createDataFrame([], "image_id string, y int, x int, name string, coverage double"), Roi(0, 2, 0, 2))
    assert empty.spec.n == 0 and M.fragments(empty, "object").count() == 0
    df = spark.createDataFrame([("p", 0, 0, 0, 1.5, 1e-6, 2.5, 0.5, 7.0)], "image_id string, z int, y int, x int, c0 double, c1 double, c2 double, c3 double, c4 double")
    a = Image(df, Spec(Roi(0, 1, 0, 1), Roi(0, 1, 0, 1), ("m00.red", "m00.green", "m00.blue", "m00.alpha", "m01.red")))
    assert M.pairs(a.spec, "m") == [(0, 1), (2, 3)] and M.pairs(a.spec, "n") == []
    assert [r["bits"] for r in M.fragments(a, "m").collect()] == [struct.unpack("I", struct.pack("f", 2.5))[0]]
    assert M.colors(a, "n").df.first()[4:] == (0.0, 0.0, 0.0)
