import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi
from lumenframe.operators import arithmetic as A
from lumenframe.operators import color as C
from lumenframe.operators import deep as D
from lumenframe.operators import filters
from lumenframe.operators import geometry as G
from lumenframe.operators import neighborhood as N
from lumenframe.operators import statistics as S
from lumenframe.sources import codecs, files


def array(a: Image) -> np.ndarray:
    d = a.spec.data
    out = np.zeros((d.height, d.width, a.spec.n))
    for r in a.df.collect():
        out[r["y"] - d.y0, r["x"] - d.x0] = [r[f"c{i}"] for i in range(a.spec.n)]
    return out


@pytest.fixture(scope="module")
def ramp(spark):
    return G.fill(spark, Roi(0, 8, 0, 6), [0, 0.5], [1, 0.25], [0.5, 0], [0.25, 1])


def test_fill_and_crop(spark):
    a = G.fill(spark, Roi(0, 8, 0, 6), [0.6, 0.7, 0.3, 0.9])
    b = array(G.fill_region(a, Roi(3, 5, 0, 4), [0.42, 0.43, 0.44, 0.45]))
    assert b[0, 3].tolist() == [0.42, 0.43, 0.44, 0.45] and b[4, 3].tolist() == [0.6, 0.7, 0.3, 0.9]
    c = G.crop(a, Roi(3, 5, 0, 4))
    assert c.spec.data == Roi(3, 5, 0, 4) and c.df.count() == 8
    assert G.cut(a, Roi(3, 5, 0, 4)).spec.data == Roi(0, 2, 0, 4)


def test_over_and_zover(spark):
    names = list("RGBA")
    bg = G.fill(spark, Roi(0, 4, 0, 4), [0.5, 0, 0, 0.5], names=names)
    fg = G.fill_region(G.fill(spark, Roi(0, 4, 0, 4), [0, 0, 0, 0], names=names), Roi(2, 4, 1, 3), [0, 0.5, 0, 0.5])
    out = array(A.over(fg, bg))
    assert out[1, 2].tolist() == [0.25, 0.5, 0, 0.75] and out[0, 0].tolist() == [0.5, 0, 0, 0.5]
    deep = [*names, "Z"]
    a = G.fill(spark, Roi(0, 4, 0, 4), [0.5, 0.5, 0.5, 1, 10], names=deep)
    b = G.fill_region(G.fill(spark, Roi(0, 4, 0, 4), [0, 0, 0, 1, 15], names=deep), Roi(2, 4, 1, 3), [1, 1, 1, 1, 5])
    z = array(A.zover(a, b))
    assert z[1, 2].tolist() == [1, 1, 1, 1, 5] and z[0, 0].tolist() == [0.5, 0.5, 0.5, 1, 10]


def test_compare(spark):
    a = G.fill(spark, Roi(0, 10, 0, 10), [0.5, 0.5, 0.5])
    b = a.with_channels([F.when(F.col("y") == 0, c + 0.01 * F.col("x")).otherwise(c) for c in a.c])
    r = S.compare(b, a, 0.0501, 0.0251).first()
    assert (r["n_fail"], r["n_warn"], r["x"], r["y"]) == (4, 7, 9, 0) and abs(r["max_error"] - 0.09) < 1e-9 and abs(r["mean_error"] - 0.0045) < 1e-9


def test_constant_stats_histogram(spark):
    a = G.fill(spark, Roi(0, 10, 0, 10), [0.25, 0.5, 0.75])
    assert S.is_constant_color(a).first()["constant"] and S.is_constant_channel(a, 1, 0.5).first()["constant"]
    b = a.with_channels([a.c[0], F.when((F.col("x") == 2) & (F.col("y") == 2), 0.51).otherwise(a.c[1]), a.c[2]])
    assert not S.is_constant_color(b).first()["constant"] and S.is_constant_color(b, 0.015).first()["constant"]
    assert not S.is_monochrome(a).first()["monochrome"]
    bw = G.checker(spark, Roi(0, 2, 0, 2), 1, 1, 1, [0] * 3, [1] * 3)
    for r in S.pixel_stats(G.flip(bw)).collect():
        assert (r["min"], r["max"], r["avg"], r["stddev"], r["finite"]) == (0, 1, 0.5, 0.5, 4)
    rows = F.when(F.col("y") < 8, 0.2).when(F.col("y") < 24, 0.5).otherwise(0.8)
    g = G.zero(spark, Roi(0, 64, 0, 64), 1).with_channels([rows])
    bins = {r["bin"]: r["n"] for r in S.histogram(g).collect()}
    assert len(bins) == 256 and {k: v for k, v in bins.items() if v} == {51: 512, 128: 1024, 204: 2560}


@pytest.mark.parametrize(("op", "ref"), [(G.flip, lambda v: v[::-1]), (G.flop, lambda v: v[:, ::-1]), (G.rotate180, lambda v: v[::-1, ::-1]), (G.transpose, lambda v: v.transpose(1, 0, 2)), (G.rotate90, lambda v: np.rot90(v, -1)), (G.rotate270, lambda v: np.rot90(v)), (lambda a: G.circular_shift(a, 3, 2), lambda v: np.roll(v, (2, 3), (0, 1)))])
def test_orientation(ramp, op, ref):
    assert np.allclose(array(op(ramp)), ref(array(ramp)))


def test_stencils(ramp):
    v = array(ramp)
    pad = np.pad(v, ((1, 1), (1, 1), (0, 0)), "edge")
    shifts = [pad[1 + j : 7 + j, 1 + i : 9 + i] for j in (-1, 0, 1) for i in (-1, 0, 1)]
    assert np.allclose(array(N.convolve(ramp, filters.kernel("box", 3, 3))), sum(shifts) / 9)
    assert np.allclose(array(N.laplacian(ramp)), shifts[1] + shifts[3] + shifts[5] + shifts[7] - 4 * v)
    assert np.allclose(array(N.dilate(ramp, 3, 3)), np.max(shifts, 0)) and np.allclose(array(N.erode(ramp, 3, 3)), np.min(shifts, 0))
    assert np.allclose(array(N.blur(ramp, "gaussian", 3, 3)), array(N.convolve(ramp, filters.kernel("gaussian", 3, 3))))
    inner = array(N.median_filter(ramp))[1:-1, 1:-1]
    assert np.allclose(inner, np.median(shifts, 0)[1:-1, 1:-1])


def test_resampling(ramp):
    assert np.allclose(array(N.resize(ramp, 8, 6, "box")), array(ramp))
    half = array(ramp).reshape(3, 2, 4, 2, 2).mean((1, 3))
    assert np.allclose(array(N.resample(ramp, 4, 3, True)), half)
    assert np.allclose(array(N.warp(ramp, [1, 0, 0, 0, 1, 0, 0, 0, 1], "box")), array(ramp))
    assert len(N.pyramid(ramp)) == 4 and N.pyramid(ramp)[-1].spec.data.pixels == 1
    assert N.fit(ramp, 16, 16).spec.data == Roi(0, 16, 2, 14)


def test_fft(ramp):
    one = G.channels(ramp, [0])
    assert np.allclose(array(N.ifft(N.fft(one))), array(one))


def test_demosaic(spark):
    a = G.fill(spark, Roi(0, 8, 0, 8), [0.2, 0.5, 0.8])
    assert np.allclose(array(N.demosaic(N.mosaic_bayer(a)))[1:-1, 1:-1], [0.2, 0.5, 0.8])


def test_curves(ramp):
    back = C.convert(C.convert(ramp, "linear", "sRGB"), "sRGB", "linear")
    assert np.allclose(array(back), array(ramp))
    assert np.allclose(array(A.rangeexpand(A.rangecompress(A.mul(ramp, 8.0)))), array(ramp) * 8)
    m = C.to_xyz("rec709")
    assert np.allclose(m.sum(1), [0.95045593, 1.0, 1.08905775], atol=1e-4)
    assert np.allclose(array(A.div(ramp, 0.0)), 0)


def test_fillholes(spark):
    a = G.fill(spark, Roi(0, 16, 0, 16), [0.5, 0.25, 0.125, 1.0])
    out = array(N.fillholes_pushpull(a.within(Roi(4, 8, 4, 8), [F.lit(0.0)] * 4)))
    assert (out[5, 5, 3] > 0.5) and np.allclose(out[0, 0], [0.5, 0.25, 0.125, 1])


def test_noise_repeats(spark):
    roi = Roi(0, 32, 0, 32)
    a, b = (array(G.noise(G.zero(spark, roi), "uniform", 0.25, 0.75, seed=k)) for k in (1, 2))
    assert np.array_equal(a, array(G.noise(G.zero(spark, roi), "uniform", 0.25, 0.75, seed=1))) and not np.array_equal(a, b)
    assert 0.25 <= a.min() and a.max() < 0.75 and abs(a.mean() - 0.5) < 0.02
    g = array(G.noise(G.zero(spark, roi), "gaussian", 0.5, 0.1))
    assert abs(g.mean() - 0.5) < 0.01 and abs(g.std() - 0.1) < 0.01


def deep(spark, *samples):
    rows = [("0", 0, 0, 0, [(float(r), 0.0, 0.0, float(a), float(z), float(b)) for r, a, z, b in samples])]
    return spark.createDataFrame(rows, f"image_id string, z int, y int, x int, samples {D.SAMPLES}")


def samples(df):
    return [tuple(round(s[k], 6) for k in ("R", "A", "Z", "Zback")) for s in df.first()["samples"]]


def test_deep(spark):
    a = deep(spark, (0.5, 0.5, 10, 20))
    halves = samples(D.split(a, "15"))
    part = 1 - math.sqrt(0.5)
    assert halves == [(round(0.5 * part / 0.5, 6), round(part, 6), 10, 15), (round(0.5 * part / 0.5, 6), round(part, 6), 15, 20)]
    merged = D.deep_merge(a, deep(spark, (0.2, 0.5, 15, 25)))
    assert [s[2:] for s in samples(merged)] == [(10, 15), (15, 20), (20, 25)]
    assert abs(D.flatten(merged).first()["A"] - 0.75) < 1e-9
    assert samples(D.occlusion_cull(deep(spark, (0, 0.5, 1, 1), (0, 1, 2, 2), (0, 1, 3, 3)))) == [(0, 0.5, 1, 1), (0, 1, 2, 2)]
    held = D.deep_holdout(deep(spark, (0, 0.5, 1, 1), (0.5, 0.5, 2, 6), (0, 1, 9, 9)), deep(spark, (0, 1, 4, 4)))
    assert [s[2:] for s in samples(held)] == [(1, 1), (2, 4)]
    assert samples(D.sort(deep(spark, (1, 0, 2, 3), (2, 0, 2, 2), (3, 0, 1, 1)))) == [(3, 0, 1, 1), (2, 0, 2, 2), (1, 0, 2, 3)]
    assert len(samples(D.erase_samples(D.insert_sample(a, 1, {"Z": 30}), 0))) == 1


@pytest.mark.parametrize("fmt", ["pnm", "pfm", "bmp", "png", "hdr", "sgi", "fits", "zfile", "targa"])
def test_codecs(fmt):
    rng = random.Random(1)
    n = 1 if fmt == "zfile" else 3
    v = np.array([[[rng.random() for _ in range(n)] for _ in range(7)] for _ in range(5)])
    got = codecs.decode(codecs.by_name(fmt).encode(v), "x.tga")
    assert got.shape == v.shape and np.abs(got - v).max() < 0.01


def test_files(spark, tmp_path):
    v = np.linspace(0, 1, 48).reshape(4, 4, 3)
    (tmp_path / "a.ppm").write_bytes(codecs.CODECS["pnm"].encode(v))
    (tmp_path / "b.png").write_bytes(codecs.CODECS["png"].encode(v[:2]))
    (tmp_path / "c.bmp").write_bytes(b"BM broken")
    rows = {r["filename"].rsplit("/", 1)[-1]: r for r in files.headers(spark, str(tmp_path)).collect()}
    assert (rows["a.ppm"]["width"], rows["b.png"]["height"]) == (4, 2) and rows["c.bmp"]["error"]
    a = files.read(spark, str(tmp_path))
    assert a.df.count() == 24 and a.spec.data == Roi(0, 4, 0, 4)
    assert files.encoded(a, "ppm").count() == 2
