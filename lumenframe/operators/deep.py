"""Deep images: each pixel has an array of samples, ordered by depth.

Columns image_id, z, y, x and samples: array of struct(R, G, B, A, Z, Zback).
Operators of one image are higher-order functions on the array, without a shuffle;
the merge of two joins them by pixel and works on whole batches of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image
from lumenframe.session import ship

FIELDS = ("R", "G", "B", "A", "Z", "Zback")
SAMPLES = "array<struct<R:double,G:double,B:double,A:double,Z:double,Zback:double>>"
FAR = 1e30
EMPTY = f"cast(array() as {SAMPLES})"


def deepen(a: Image, zvalue: float = 1.0) -> DataFrame:
    """One sample for pixels with a non-zero channel other than depth (or with a finite depth of their own), else none."""
    at = {n: i for i, n in enumerate(a.spec.names)}
    c = lambda n: a.c[at[n]] if n in at else F.lit(1.0 if n == "A" else 0.0)
    z = c("Z") if "Z" in at else F.lit(float(zvalue))
    lit = F.lit(False)
    for n, i in at.items():
        lit = lit | ((a.c[i] != 0) & (a.c[i] < FAR) if n in ("Z", "Zback") else a.c[i] != 0)
    sample = F.struct(*[c(n).alias(n) for n in FIELDS[:4]], z.alias("Z"), (c("Zback") if "Zback" in at else z).alias("Zback"))
    return a.df.select(*KEYS, F.when(lit, F.array(sample)).otherwise(F.expr(EMPTY)).alias("samples"))


def sort(deep: DataFrame) -> DataFrame:
    """By Z, then Zback; equal ones stay in their order."""
    return deep.withColumn("samples", F.expr("transform(array_sort(transform(samples, (s, i) -> struct(s.Z as k1, s.Zback as k2, i as k3, s as s))), t -> t.s)"))


def opaque_z() -> Column:
    """Far side of the first opaque sample; the largest float if there is none."""
    return F.expr("coalesce(get(filter(samples, s -> s.A >= 1), 0).Zback, 3.4028234663852886e38D)")


def occlusion_cull(deep: DataFrame) -> DataFrame:
    """Without what lies behind the first opaque sample."""
    return deep.withColumn("samples", F.expr("filter(samples, (s, i) -> not exists(slice(samples, 1, i), t -> t.A >= 1))"))


def _part(zf: str, zb: str, share: str) -> str:
    """A sample between zf and zb that has this share of the optical depth."""
    alpha = f"case when s.A >= 1 then s.A else -expm1({share} * log1p(-s.A)) end"
    factor = f"case when s.A >= 1 then 1D when s.A < 1e-12D then {share} else (-expm1({share} * log1p(-s.A))) / s.A end"
    return f"named_struct('R', s.R * ({factor}), 'G', s.G * ({factor}), 'B', s.B * ({factor}), 'A', {alpha}, 'Z', {zf}, 'Zback', {zb})"


def split(deep: DataFrame, depth: str) -> DataFrame:
    """Samples that span depth (an SQL expression of the row) become two, alpha by the law of absorption."""
    d = f"cast({depth} as double)"
    near, behind = f"(({d} - s.Z) / (s.Zback - s.Z))", f"((s.Zback - {d}) / (s.Zback - s.Z))"
    return deep.withColumn("samples", F.expr(f"flatten(transform(samples, s -> case when s.Z < {d} and {d} < s.Zback then array({_part('s.Z', d, near)}, {_part(d, 's.Zback', behind)}) else array(s) end))"))


def merge_overlaps(deep: DataFrame) -> DataFrame:
    """Neighbouring samples of one interval become one; colours add up by their share of the optical depth."""
    depth = lambda s: f"(case when {s}.A >= 1 then 1e30D else -log1p(-{s}.A) end)"
    am = "(p.A + s.A - p.A * s.A)"
    total = f"({depth('p')} + {depth('s')})"
    color = lambda c: (
        f"case when p.A >= 1 and s.A >= 1 then (p.{c} + s.{c}) / 2 when p.A >= 1 then p.{c} when s.A >= 1 then s.{c} when {total} < 1e-12D then p.{c} + s.{c} "
        f"else {am} / {total} * (case when p.A < 1e-12D then p.{c} else p.{c} * {depth('p')} / p.A end + case when s.A < 1e-12D then s.{c} else s.{c} * {depth('s')} / s.A end) end"
    )
    merged = "named_struct(" + ", ".join(f"'{c}', {color(c)}" for c in "RGB") + f", 'A', {am}, 'Z', s.Z, 'Zback', s.Zback)"
    fold = (
        f"aggregate(samples, {EMPTY}, (acc, s) -> case when size(acc) > 0 and element_at(acc, -1).Z = s.Z and element_at(acc, -1).Zback = s.Zback "
        f"then concat(slice(acc, 1, size(acc) - 1), transform(slice(acc, -1, 1), p -> {merged})) else concat(acc, array(s)) end)"
    )
    return deep.withColumn("samples", F.expr(fold))


def flatten(deep: DataFrame) -> DataFrame:
    """Front to back in the stored order until opaque: R, G, B, A, depth (1e30 without samples)."""
    start = "named_struct('R', 0D, 'G', 0D, 'B', 0D, 'A', 0D, 'Z', 0D)"
    step = "named_struct('R', acc.R + (1 - acc.A) * s.R, 'G', acc.G + (1 - acc.A) * s.G, 'B', acc.B + (1 - acc.A) * s.B, 'A', acc.A + (1 - acc.A) * s.A, 'Z', acc.Z + (1 - acc.A) * s.A * s.Z)"
    folded = deep.withColumn("f", F.expr(f"aggregate(samples, {start}, (acc, s) -> case when acc.A >= 1 then acc else {step} end)"))
    z = F.when(F.col("f.A") > 0, F.col("f.Z") / F.when(F.col("f.A") > 0, F.col("f.A"))).otherwise(FAR)
    return folded.select(*KEYS, "f.R", "f.G", "f.B", "f.A", z.alias("depth"))


#: Pairs of a sample and a piece of it that are held at a time; one pixel's pairs stay together.
PAIRS = 1 << 20


def _merged(pixel: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The merged samples of pixels, ordered by pixel, Z and Zback: each piece between two cuts is a sum over the samples that cover it."""
    long = s["Zback"] > s["Z"]
    mine, points = np.flatnonzero(long), np.flatnonzero(~long)
    # All ends cut what spans them, and so do points.
    at_pixel = np.concatenate([pixel[mine], pixel[mine], pixel[points]])
    at_z = np.concatenate([s["Z"][mine], s["Zback"][mine], s["Z"][points]])
    order = np.lexsort((at_z, at_pixel))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(at_pixel[order]) != 0) | (np.diff(at_z[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    cut_pixel, cut_z = at_pixel[order][new], at_z[order][new]
    first, last = rank[: len(mine)], rank[len(mine) : 2 * len(mine)]
    count = last - first
    own = np.repeat(mine, count)
    piece = np.arange(len(own)) + np.repeat(first - (np.cumsum(count) - count), count)
    share = (cut_z[piece + 1] - cut_z[piece]) / (s["Zback"][own] - s["Z"][own]) if len(own) else np.zeros(0)
    # Points are merged with those of the same depths.
    order = points[np.lexsort((s["Zback"][points], s["Z"][points], pixel[points]))]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(pixel[order]) != 0) | (np.diff(s["Z"][order]) != 0) | (np.diff(s["Zback"][order]) != 0)
    heads, n = order[new], len(cut_z)
    own, share = np.concatenate([own, order]), np.concatenate([share, np.ones(len(order))])
    piece = np.concatenate([piece, n + np.cumsum(new) - 1]).astype(np.int64)
    size = n + len(heads)
    add = lambda v: np.bincount(piece, v, size)
    alpha = s["A"][own]
    solid, faint = alpha >= 1, alpha < 1e-12
    depth = np.where(solid, 0.0, -np.log1p(-np.where(solid, 0.0, alpha)))
    total, opaque = add(depth * share), add(solid.astype(float))
    gain = np.where(solid, 0.0, np.where(faint, share, depth * share / np.where(faint, 1.0, alpha)))
    factor = np.where(total < 1e-12, 1.0, -np.expm1(-total) / np.where(total < 1e-12, 1.0, total))
    out = {c: np.where(opaque > 0, add(np.where(solid, s[c][own], 0.0)) / np.maximum(opaque, 1), factor * add(s[c][own] * gain)) for c in "RGB"}
    out["A"] = np.where(opaque > 0, 1.0, -np.expm1(-total))
    out["Z"] = np.concatenate([cut_z, s["Z"][heads]])
    out["Zback"] = np.concatenate([np.append(cut_z[1:], 0.0), s["Zback"][heads]])
    owner = np.concatenate([cut_pixel, pixel[heads]])
    there = np.flatnonzero(np.bincount(piece, minlength=size) > 0)
    there = there[np.lexsort((out["Zback"][there], out["Z"][there], owner[there]))]
    return owner[there], {k: v[there] for k, v in out.items()}


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("samples")
        offsets, values = np.asarray(lists.offsets), lists.values
        s = {k: values.field(k).fill_null(0.0).to_numpy(zero_copy_only=False) for k in FIELDS}
        begin = 0
        while begin < batch.num_rows:
            # A pixel of n samples has fewer than 2 n cuts, so no more than 2 n * n pairs.
            sizes = np.diff(offsets[begin:]).astype(float)
            end = begin + max(1, int(np.searchsorted(np.cumsum(2 * sizes * sizes), PAIRS, "right")))
            a, b = offsets[begin], offsets[end]
            pixel, out = _merged(np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1])), {k: v[a:b] for k, v in s.items()})
            ends = np.concatenate([[0], np.cumsum(np.bincount(pixel, minlength=end - begin))]).astype(np.int32)
            samples = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(out[k]) for k in FIELDS], list(FIELDS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], samples] if (begin, end) == (0, batch.num_rows) else [*[c[begin:end] for c in batch.columns[:-1]], samples], names=batch.schema.names)
            begin = end


def deep_merge(a: DataFrame, b: DataFrame, cull: bool = False) -> DataFrame:
    """Both images' samples, split where they overlap, sorted, and equal intervals merged.

    Within a sample its optical depth is even, and so are its colours by optical
    depth.  So a piece between two neighbouring cuts of a pixel needs only sums over
    the samples that cover it; nothing is subtracted, so a thin dense sample does
    not blur what lies behind it.  Where opaque samples cover a piece, they alone
    make it, each with the same share.  One exchange brings a pixel's samples
    together, which stay one row.
    """
    mine, other = (d.select(*KEYS, F.col("samples").alias(n)) for d, n in ((a, "p"), (b, "q")))
    both = mine.join(other, KEYS, "full_outer").select(*KEYS, F.concat(*[F.coalesce(c, F.expr(EMPTY)) for c in "pq"]).alias("samples"))
    ship(a.sparkSession)
    merged = both.mapInArrow(_merge_batches, f"{', '.join(f'{c} {t}' for c, t in both.dtypes[:-1])}, samples {SAMPLES}")
    return occlusion_cull(merged) if cull else merged


def deep_holdout(a: DataFrame, holdout: DataFrame) -> DataFrame:
    """What of a lies before holdout's first opaque sample ends."""
    limit = holdout.select(*KEYS, opaque_z().alias("zt"))
    both = a.join(limit, KEYS, "left").withColumn("zt", F.coalesce("zt", F.lit(3.4028234663852886e38)))
    kept = split(both.withColumn("samples", F.expr("filter(samples, s -> s.Z <= zt)")), "zt")
    return kept.withColumn("samples", F.expr("filter(samples, s -> s.Zback <= zt)")).drop("zt")


def sample_count(deep: DataFrame) -> DataFrame:
    return deep.select(*KEYS, F.size("samples").alias("samples"))


def insert_sample(deep: DataFrame, at: int, values: dict[str, float]) -> DataFrame:
    s = "named_struct(" + ", ".join(f"'{k}', cast({values.get(k, 0.0)} as double)" for k in FIELDS) + ")"
    return deep.withColumn("samples", F.expr(f"concat(slice(samples, 1, {at}), array({s}), slice(samples, {at} + 1, greatest(size(samples) - {at}, 0)))"))


def erase_samples(deep: DataFrame, at: int, n: int = 1) -> DataFrame:
    return deep.withColumn("samples", F.expr(f"filter(samples, (s, i) -> i < {at} or i >= {at + n})"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Rows of image_id, z, y, x and sample become pixels, with samples by Z, Zback and then the other fields; a pixel's samples are one array, so they must fit in a row."""
    order = F.struct(*[F.col(f"sample.{k}").alias(f"k{i}") for i, k in enumerate(("Z", "Zback", "R", "G", "B", "A"))], F.col("sample").alias("s"))
    return rows.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(order)), lambda t: t["s"]).alias("samples"))
