"""Pixels without a row are zero, and change where an operator changes zero; targets by arithmetic; deep merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core import Roi, image
from lumenframe.operators import arithmetic as A
from lumenframe.operators import deep as D
from lumenframe.operators import geometry as G
from lumenframe.operators import neighborhood as N

PIXELS = "image_id string, y int, x int, c0 double"


@pytest.fixture
def sparse(spark):
    return image(spark.createDataFrame([("a", 0, 0, 0.5)], PIXELS), Roi(0, 2, 0, 1), ["Y"])


def values(a):
    return {(r["x"], r["y"]): r["c0"] for r in a.df.collect()}


@pytest.mark.parametrize(
    ("f", "first", "other"),
    [
        (lambda a: A.add(a, 0.25), 0.75, 0.25), (lambda a: A.sub(1.0, a), 0.5, 1.0), (A.invert, 0.5, 1.0), (lambda a: A.power(a, 0), 1.0, 1.0), (lambda a: A.maximum(a, 0.1), 0.5, 0.1),
        (lambda a: A.clamp(a, 0.2, 0.4), 0.4, 0.2), (lambda a: A.contrast_remap(a, 0.1, 0.5), 1.0, -0.25), (lambda a: A.mad(a, 2.0, 1.0), 2.0, 1.0), (lambda a: A.absdiff(a, 0.75), 0.25, 0.75),
        (lambda a: A.add(A.add(a, 0.25), A.add(a, 1.0)), 2.25, 1.25), (lambda a: A.contrast_remap(a, 0.25, 0.25), 1.0, 0.0),
    ],
)
def test_constants_on_sparse_images(sparse, f, first, other):
    got = values(f(sparse).dense())
    assert got == pytest.approx({(0, 0): first, (1, 0): other})


def test_zero_stays_sparse(sparse):
    for f in (lambda a: A.mul(a, 3.0), lambda a: A.clamp(a, -1.0, 2.0), lambda a: A.power(a, 2.0), lambda a: A.minimum(a, 0.1)):
        assert f(sparse).df.count() == 1


def test_constant_channel(sparse):
    got = G.channels(sparse, [0, -1], [0, 0.5], ["Y", "A"]).df.collect()
    assert sorted((r["x"], r["c0"], r["c1"]) for r in got) == [(0, 0.5, 0.5), (1, 0.0, 0.5)]


def test_repeated_points(spark, sparse):
    points = spark.createDataFrame([("a", 0.5, 0.5)] * 3 + [("a", 1.0, 0.5)], "image_id string, px double, py double")
    got = sorted((r["px"], r["c0"]) for r in N.interp_bilinear(sparse, points).collect())
    assert got == [(0.5, 0.5)] * 3 + [(1.0, 0.25)]


def whole(spark, v):
    rows = [("a", y, x, float(v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return image(spark.createDataFrame(rows, PIXELS), Roi(0, v.shape[1], 0, v.shape[0]), ["Y"])


@pytest.mark.parametrize("shape", [(5, 7), (1, 4), (2, 1)])
def test_convolve_small_windows(spark, shape):
    v = np.random.default_rng(1).uniform(0, 1, shape)
    k = {(dx, dy): 1.0 + dx + 10.0 * dy for dx in range(-3, 4) for dy in range(-2, 3)}
    got = values(N.convolve(whole(spark, v), k, False))
    h, w = shape
    for y in range(h):
        for x in range(w):
            want = sum(f * v[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] for (dx, dy), f in k.items())
            assert got[x, y] == pytest.approx(want)


@pytest.mark.parametrize(("width", "height", "name"), [(5, 4, "lanczos3"), (13, 17, "triangle"), (3, 20, "box"), (1, 1, "gaussian"), (9, 7, "mitchell")])
def test_resize_without_a_table(spark, width, height, name, monkeypatch):
    a = whole(spark, np.random.default_rng(2).uniform(0, 1, (7, 9)))
    want = values(N.resize(a, width, height, name))
    monkeypatch.setattr(N, "TABLE_TARGETS", 0)
    assert values(N.resize(a, width, height, name)) == pytest.approx(want, abs=2e-3 if name == "box" else 1e-6)


@pytest.mark.parametrize(("width", "height"), [(4, 3), (20, 15), (9, 7), (1, 1)])
def test_resample(spark, width, height):
    v = np.random.default_rng(3).uniform(0, 1, (7, 9))
    a = whole(spark, v)
    near, linear = values(N.resample(a, width, height, False)), values(N.resample(a, width, height, True))
    at = lambda y, x: v[min(max(y, 0), 6), min(max(x, 0), 8)]
    for ty in range(height):
        for tx in range(width):
            sx, sy = (tx + 0.5) * 9 / width, (ty + 0.5) * 7 / height
            assert near[tx, ty] == pytest.approx(at(int(sy), int(sx)))
            px, py = sx - 0.5, sy - 0.5
            i, j = int(np.floor(px)), int(np.floor(py))
            fx, fy = px - i, py - j
            want = (1 - fy) * ((1 - fx) * at(j, i) + fx * at(j, i + 1)) + fy * ((1 - fx) * at(j + 1, i) + fx * at(j + 1, i + 1))
            assert linear[tx, ty] == pytest.approx(want)


def deep_image(spark, samples):
    return spark.createDataFrame([("a", 0, 0, 0, samples)], f"image_id string, z int, y int, x int, samples {D.SAMPLES}")


def test_merge_of_many_samples(spark):
    rng = np.random.default_rng(5)

    def own(n):
        out = []
        for _ in range(n):
            z, a = rng.uniform(0, 50), rng.uniform(0.01, 0.3)
            out.append((a * 0.5, a * 0.2, a, a, z, z + rng.uniform(1, 30)))
        return out

    p, q = own(400), own(400)
    got = D.deep_merge(deep_image(spark, p), deep_image(spark, q)).first()["samples"]
    cuts = sorted({v for s in p + q for v in s[4:]})
    assert len(got) == len(cuts) - 1 and [s["Z"] for s in got] == cuts[:-1]
    for k in range(0, len(got), 37):
        inside = [(s, (cuts[k + 1] - cuts[k]) / (s[5] - s[4])) for s in p + q if s[4] <= cuts[k] and s[5] >= cuts[k + 1]]
        depth = sum(-np.log1p(-s[3]) * share for s, share in inside)
        red = sum(s[0] / s[3] * -np.log1p(-s[3]) * share for s, share in inside)
        assert got[k]["A"] == pytest.approx(1 - np.exp(-depth)) and got[k]["R"] == pytest.approx((1 - np.exp(-depth)) / depth * red)


def test_merge_of_opaque_and_point_samples(spark):
    p = [(1.0, 0.0, 0.0, 1.0, 5.0, 7.0), (0.1, 0.1, 0.1, 0.5, 1.0, 1.0)]
    q = [(0.0, 0.2, 0.0, 0.5, 4.0, 6.0), (0.3, 0.1, 0.1, 0.5, 1.0, 1.0)]
    got = D.deep_merge(deep_image(spark, p), deep_image(spark, q)).first()["samples"]
    assert [(s["Z"], s["Zback"]) for s in got] == [(1, 1), (4, 5), (5, 6), (6, 7)]
    assert got[0]["A"] == pytest.approx(0.75) and got[0]["R"] == pytest.approx(0.75 / 2 * 2 * (0.2 + 0.6) / 2)
    assert got[2]["A"] == got[3]["A"] == 1 and got[2]["R"] == 1 and got[2]["G"] == 0
    assert [s["A"] for s in D.deep_merge(deep_image(spark, p), deep_image(spark, q), True).first()["samples"]][-1] == 1
    none = D.deep_merge(deep_image(spark, []), deep_image(spark, []))
    assert none.first()["samples"] == []


def test_merge_beside_a_thin_dense_sample(spark):
    """Nothing of a thin dense sample is left in the sums of the pieces behind it."""
    p, q = [(0.9, 0.9, 0.9, 0.9, 1.0, 1.0 + 1e-12)], [(0.1, 0.05, 0.02, 0.1, 0.5, 2.0)]
    got = D.deep_merge(deep_image(spark, p), deep_image(spark, q)).first()["samples"]
    ends = [0.5, 1.0, 1.0 + 1e-12, 2.0]
    assert [(s["Z"], s["Zback"]) for s in got] == list(zip(ends, ends[1:], strict=False))
    for s in (got[0], got[2]):
        alpha = 1 - 0.9 ** ((s["Zback"] - s["Z"]) / 1.5)
        assert s["A"] == pytest.approx(alpha, abs=1e-12) and s["G"] == pytest.approx(alpha / 2, abs=1e-12)


def test_merge_of_other_pixels_and_nulls(spark):
    schema = f"image_id string, z int, y int, x int, samples {D.SAMPLES}"
    one = (0.1, 0.1, 0.1, 0.2, 1.0, 2.0)
    a = spark.createDataFrame([("a", 0, 0, x, [one] * x) for x in range(4)] + [("a", 0, 9, 0, None)], schema)
    b = spark.createDataFrame([("a", 0, 0, x, [one]) for x in (3, 4)], schema)
    got = {(r["y"], r["x"]): r["samples"] for r in D.deep_merge(a, b).collect()}
    assert {k: len(v) for k, v in got.items()} == {(0, 0): 0, (0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 1, (9, 0): 0}
    assert got[0, 3][0]["A"] == pytest.approx(1 - 0.8**4) and got[0, 4][0]["A"] == pytest.approx(0.2)


def test_aggregates_count_pixels_without_a_row(spark):
    from lumenframe.core import Image, Roi, Spec
    from lumenframe.operators import statistics as S

    rng = np.random.default_rng(7)
    roi = Roi(2, 7, -1, 4)
    rows = [(k, 0, y, x, float(rng.uniform(-1, 1)), float(rng.uniform(0.2, 1))) for k in "ab" for y in range(-1, 4) for x in range(2, 7) if rng.random() < (0.5 if k == "a" else 1)]
    sparse = Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, c0 double, c1 double"), Spec(roi, roi, ("R", "G")))
    full = sparse.dense()
    for f in (
        S.pixel_stats, lambda a: S.is_constant_color(a, 0.9), lambda a: S.is_constant_channel(a, 1, 0.6, 0.5), lambda a: S.is_constant_channel(a, 1, 0.6, 0.6), S.is_monochrome,
        lambda a: S.color_count(a, [[0.0, 0.0], [0.3, 0.5]], 0.3), lambda a: S.color_range_check(a, 0.1, 0.5), lambda a: S.color_range_check(a, -0.5, -0.1), lambda a: S.color_range_check(a, -1, 1),
        lambda a: S.histogram(a, 0, 8, -1.0, 1.0), lambda a: S.histogram(a, 1, 4, 0.5, 1.0, True),
    ):
        x, y = (sorted(map(tuple, f(a).collect())) for a in (sparse, full))
        assert len(x) == len(y)
        for p, q in zip(x, y, strict=True):
            assert p == pytest.approx(q) if all(isinstance(v, int | float) for v in p) else all(u == pytest.approx(v) if isinstance(u, float) else u == v for u, v in zip(p, q, strict=True))
