"""Aggregates of images: partial sums on the map side, one small row for each image and channel.

A pixel of the data window without a row is zero: how many there are follows from
the number of rows, so they count without being made.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, every, finite, joined, per_channel, some


def long_form(a: Image) -> DataFrame:
    """A row for each pixel and channel: c and v."""
    return a.df.select("image_id", "z", "y", "x", F.posexplode(F.array(*a.c)).alias("c", "v"))


def _absent(a: Image) -> Column:
    """Of a group's pixels those without a row."""
    return F.lit(0).cast("long") if a.whole else F.greatest(F.lit(a.spec.data.pixels) - F.count("*"), F.lit(0).cast("long"))


def pixel_stats(a: Image) -> DataFrame:
    """image_id, c, min, max, avg, stddev, sum, nan, inf, finite of all pixels.

    Only finite values count; without any all are 0.  One pass over wide rows: the
    channels are aggregates of one grouping, not a multiple of the rows.
    """
    aggs = []
    for i, v in enumerate(a.c):
        ok = F.when(finite(v), v)
        aggs += [F.min(ok).alias(f"lo{i}"), F.max(ok).alias(f"hi{i}"), F.sum(ok).alias(f"s{i}"), F.sum(ok * ok).alias(f"q{i}"), F.count(ok).alias(f"n{i}")]
        aggs += [F.count_if(F.isnan(v)).alias(f"nan{i}"), F.count_if(F.abs(v) == float("inf")).alias(f"inf{i}")]
    wide = a.df.groupBy("image_id").agg(*aggs, _absent(a).alias("absent"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    with_absent = lambda f, c: F.when(F.col("absent") > 0, f(zero(F.col(c)), F.lit(0.0))).otherwise(zero(F.col(c)))
    rows = []
    for i in range(a.spec.n):
        n = F.greatest(F.col(f"n{i}") + F.col("absent"), F.lit(1))
        avg = zero(F.col(f"s{i}")) / n
        var = F.greatest(zero(F.col(f"q{i}")) / n - avg * avg, F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(i).alias("c"), with_absent(F.least, f"lo{i}").alias("min"), with_absent(F.greatest, f"hi{i}").alias("max"), avg.alias("avg"), F.sqrt(var).alias("stddev"),
                zero(F.col(f"s{i}")).alias("sum"), F.col(f"nan{i}").alias("nan"), F.col(f"inf{i}").alias("inf"), (F.col(f"n{i}") + F.col("absent")).alias("finite"),
            )
        )
    return wide.select("image_id", F.explode(F.array(*rows)).alias("r")).select("image_id", "r.*")


def compare(a: Image, b: Image, fail: float, warn: float, fail_relative: float = 0.0, warn_relative: float = 0.0) -> DataFrame:
    """image_id, mean_error, rms_error, psnr, max_error with its place, n_warn, n_fail, over the union of both windows.

    A pixel counts once, if in some channel both the absolute and the relative
    threshold are exceeded.  Among equal errors the first pixel in scan order has
    the maximum.  Two NaN or two equal infinite values are equal; else a value that
    is not finite is an infinite error.
    """
    df, x, y, spec = joined(a, b)
    pairs = list(zip(x, y, strict=False))
    err, bad, warned, big = [], [], [], []
    for p, q in pairs:
        same = (F.isnan(p) & F.isnan(q)) | (p == q)
        e = F.when(same, 0.0).when(finite(p) & finite(q), F.abs(p - q)).otherwise(float("inf"))
        err.append(e)
        m = F.greatest(F.abs(p), F.abs(q))
        bad.append((e > fail) & ((e > fail_relative * m) if fail_relative else F.lit(True)))
        warned.append((e > warn) & ((e > warn_relative * m) if warn_relative else F.lit(True)))
        big.append(m)
    n = len(pairs)
    top = F.greatest(*err) if n > 1 else err[0]
    total_e, total_q = sum(err[1:], err[0]), sum((e * e for e in err[1:]), err[0] * err[0])
    rows = df.select("image_id", "z", "y", "x", top.alias("top"), total_e.alias("e"), total_q.alias("q"), some(bad).alias("bad"), some(warned).alias("warned"), (F.greatest(*big) if n > 1 else big[0]).alias("big"), *[e.alias(f"e{i}") for i, e in enumerate(err)])
    place = F.expr("0")
    for i in range(n - 1, -1, -1):
        place = F.when(F.col(f"e{i}") == F.col("top"), i).otherwise(place)
    pixels = spec.data.pixels * n
    out = rows.groupBy("image_id").agg(
        F.sum("e").alias("e"), F.sum("q").alias("q"), F.max("big").alias("big"), F.count_if("bad").alias("n_fail"), F.count_if("warned").alias("n_warn"),
        F.max("top").alias("max_error"), F.max_by(F.struct("z", "y", "x", place.alias("c")), F.struct("top", (-F.col("z")).alias("z"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("at"),
    )
    mean, rms = F.col("e") / pixels, F.sqrt(F.col("q") / pixels)
    psnr = F.when(F.col("q") == 0, float("inf")).otherwise(20 * F.log10(F.greatest(F.lit(1.0), F.col("big")) / F.when(F.col("q") > 0, rms)))
    return out.select("image_id", mean.alias("mean_error"), rms.alias("rms_error"), psnr.alias("psnr"), "max_error", "at.x", "at.y", "at.z", "at.c", "n_warn", "n_fail")


def is_constant_color(a: Image, threshold: float = 0.0) -> DataFrame:
    """image_id, constant: all pixels within threshold of the first in scan order."""
    d, n = a.spec.data, range(a.spec.n)
    first = a.df.groupBy("image_id").agg(
        F.min(F.struct("z", "y", "x")).alias("at"), _absent(a).alias("absent"), *[F.min_by(c, F.struct("z", "y", "x")).alias(f"f{i}") for i, c in enumerate(a.c)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(a.c)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(a.c)],
    )
    corner = (F.col("at.z") == d.z0) & (F.col("at.y") == d.y0) & (F.col("at.x") == d.x0)
    head = [F.when(F.lit(a.whole) | corner, F.col(f"f{i}")).otherwise(0.0) for i in n]
    near = lambda v, i: F.abs(v - head[i]) <= threshold
    far = [(near(F.col(f"hi{i}"), i)) & near(F.col(f"lo{i}"), i) & ((F.col("absent") == 0) | near(F.lit(0.0), i)) for i in n]
    return first.select("image_id", every(far).alias("constant"))


def is_constant_channel(a: Image, channel: int, value: float, threshold: float = 0.0) -> DataFrame:
    rows = a.df.groupBy("image_id").agg(F.bool_and(F.abs(a.c[channel] - value) <= threshold).alias("all"), _absent(a).alias("absent"))
    return rows.select("image_id", (F.col("all") & ((F.col("absent") == 0) | F.lit(abs(value) <= threshold))).alias("constant"))


def is_monochrome(a: Image, threshold: float = 0.0) -> DataFrame:
    """Pixels without a row are monochrome."""
    spread = F.greatest(*a.c) - F.least(*a.c) if a.spec.n > 1 else F.lit(0.0)
    return a.df.groupBy("image_id").agg(F.bool_and(spread <= threshold).alias("monochrome"))


def color_count(a: Image, colors: list[list[float]], eps=0.001) -> DataFrame:
    """image_id, color, n: pixels that match each colour; a pixel can match several."""
    e = per_channel(eps, a.spec.n)
    hits = []
    for k in colors:
        want = per_channel(k, a.spec.n)
        black = all(abs(v) <= t for v, t in zip(want, e, strict=True))
        hits.append(F.count_if(every([F.abs(c - v) <= t for c, v, t in zip(a.c, want, e, strict=True)])) + (_absent(a) if black else F.lit(0)))
    rows = a.df.groupBy("image_id").agg(F.array(*hits).alias("n"))
    return rows.select("image_id", F.posexplode("n").alias("color", "n"))


def color_range_check(a: Image, low, high) -> DataFrame:
    lo, hi = per_channel(low, a.spec.n), per_channel(high, a.spec.n)
    under, above = some([c < v for c, v in zip(a.c, lo, strict=True)]), some([c > v for c, v in zip(a.c, hi, strict=True)])
    # Where black pixels belong.
    black_low, black_high = any(v > 0 for v in lo), any(v < 0 for v in hi)
    also = lambda n, if_black: n + _absent(a) if if_black else n
    return a.df.groupBy("image_id").agg(
        also(F.count_if(under), black_low).alias("n_low"), also(F.count_if(above), black_high).alias("n_high"), also(F.count_if(~under & ~above), not black_low and not black_high).alias("n_in")
    )


def nonzero_region(a: Image) -> DataFrame:
    ends = [f(k).alias(f"{k}{n}") for k in "xyz" for f, n in ((F.min, 0), (lambda c: F.max(c) + 1, 1))]
    return a.df.filter(some([c != 0 for c in a.c])).groupBy("image_id").agg(*ends)


def bounds(a: Image) -> Roi:
    """The region of non-zero pixels of all images; empty if there is none."""
    r = nonzero_region(a).agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1"), F.min("z0"), F.max("z1")).first()
    return Roi(*r) if r[0] is not None else Roi(0, 0, 0, 0)


def histogram(a: Image, channel: int = 0, bins: int = 256, low: float = 0.0, high: float = 1.0, ignore_empty: bool = False) -> DataFrame:
    """image_id, bin, n for all bins; values beyond the ends are in the first and last bin."""
    df = a.df.filter(some([c != 0 for c in a.c])) if ignore_empty else a.df
    v = a.c[channel]
    at = F.least(F.greatest(F.floor((v - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.groupBy("image_id", at.alias("bin")).agg(F.count("*").alias("n"))
    black = min(max(math.floor((0.0 - low) * (bins / (high - low))), 0), bins - 1)
    absent = F.lit(0).cast("long") if ignore_empty else _absent(a)
    full = a.df.groupBy("image_id").agg(absent.alias("absent")).select("image_id", "absent", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    also = F.when(F.col("bin") == black, F.col("absent")).otherwise(0)
    return full.join(counted, ["image_id", "bin"], "left").select("image_id", "bin", (F.coalesce("n", F.lit(0).cast("long")) + also).alias("n"))


def pixel_hash(a: Image, block_rows: int = 64, extra: str = "") -> DataFrame:
    """image_id, sha1: of the pixels' 32-bit values as bytes, channel by channel in scan order.

    Each block of rows is hashed by a task of its own, and the result is the hash of
    the blocks' digests; extra goes in at the end.  Pixels without a row are zero.
    """
    d, n = a.spec.data, a.spec.n
    lines = F.expr(f"(z - {d.z0}) * {d.height} + y - {d.y0}").cast("long")

    def digest(key: tuple, table: pa.Table) -> pa.Table:
        block = key[1].as_py()
        rows = min(block_rows, d.depth * d.height - block * block_rows)
        full = np.zeros((rows, d.width, n), "<f4")
        at = table.column("line").to_numpy() - block * block_rows
        for i in range(n):
            full[at, table.column("x").to_numpy() - d.x0, i] = table.column(f"c{i}").to_numpy()
        return pa.table({"image_id": [key[0].as_py()], "block": pa.array([block], pa.int64()), "h": [hashlib.sha1(full.tobytes()).hexdigest()]})

    rows = a.df.filter(d.has()).select("image_id", lines.alias("line"), "x", *a.c).withColumn("block", F.expr(f"line div {block_rows}"))
    blocks = rows.groupBy("image_id", "block").applyInArrow(digest, "image_id string, block long, h string")
    # Blocks without any row are zero throughout.
    zero = lambda rows: hashlib.sha1(np.zeros((rows, d.width, n), "<f4").tobytes()).hexdigest()
    count, last = divmod(d.depth * d.height, block_rows)
    every = F.explode(F.expr(f"sequence(0L, {count - (last == 0)}L)")).alias("block")
    whole = a.df.select("image_id").distinct().select("image_id", every).join(blocks, ["image_id", "block"], "left")
    missing = F.when(F.col("block") == count, zero(last)).otherwise(zero(block_rows))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", F.coalesce("h", missing).alias("h")))), lambda r: r["h"])
    return whole.groupBy("image_id").agg(F.sha1(F.concat(F.concat_ws("", ordered), F.lit(extra)).cast("binary")).alias("sha1"))


def diff_status(results: DataFrame, pixels: int, fail_percent: float = 0.0, hard_fail: float = math.inf, warn_percent: float = 0.0, hard_warn: float = math.inf) -> DataFrame:
    """compare()'s rows with status FAILURE, WARNING or PASS."""
    share = lambda n: F.col(n) * (100.0 / pixels)
    return results.withColumn(
        "status",
        F.when((share("n_fail") > fail_percent) | (F.col("max_error") > hard_fail), "FAILURE").when((share("n_warn") > warn_percent) | (F.col("max_error") > hard_warn), "WARNING").otherwise("PASS"),
    )


def top_pixels(a: Image, channel: int, n: int) -> DataFrame:
    """The n largest values of a channel in each image, ties in scan order."""
    w = Window.partitionBy("image_id").orderBy(F.desc(a.c[channel]), "z", "y", "x")
    return a.df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def igrep(files: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Of files (filename, attribs: map of strings) the entries whose value matches; inverted, the files without one."""
    entries = files.select("filename", F.explode("attribs").alias("name", "value"))
    hit = entries.filter(F.col("value").rlike(("(?i)" if ignore_case else "") + pattern))
    return files.join(hit.select("filename"), "filename", "left_anti") if invert else hit
