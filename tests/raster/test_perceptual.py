"""Perceptual differences against plain numpy."""

import math

import numpy as np
import pytest

from lumenframe.core import Image, Roi, Spec
from lumenframe.operators import perceptual as P


def table(spark, arrays, x0=0, y0=0):
    rows = [(k, 0, y0 + y, x0 + x, *map(float, a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    h, w = next(iter(arrays.values())).shape[:2]
    return Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, c0 double, c1 double, c2 double"), Spec(Roi(x0, x0 + w, y0, y0 + h), Roi(x0, x0 + w, y0, y0 + h), tuple("RGB")))


def pictures(seed, h=9, w=11, top=1.0):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, top, (h, w, 3))
    b = np.clip(a + rng.normal(0, 0.15, a.shape), 0, None)
    b[: h // 2] = a[: h // 2]
    return a, b


def filtered(v, across, down):
    def one(v, taps, axis):
        n = v.shape[axis]
        return sum(t * np.take(v, np.clip(np.arange(n) + o, 0, n - 1), axis) for o, t in taps.items())

    return one(one(v, across, 1), down, 0)


def plain_flip(a, b, ppd):
    white = np.array([0.950428545, 1.0, 1.088900371])
    to = np.array(P.TO_XYZ)

    def lab(rgb):
        t = rgb @ to.T / white
        t = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * 841 / 108 + 4 / 29)
        lum = 116 * t[..., 1] - 16
        return lum, 0.01 * lum * 500 * (t[..., 0] - t[..., 1]), 0.01 * lum * 200 * (t[..., 1] - t[..., 2])

    def gauss(a, b, root=False):
        r = math.ceil(3 * math.sqrt(0.04 / (2 * math.pi**2)) * ppd)
        h = a * math.sqrt(math.pi / b)
        return {k: (math.sqrt(h) if root else h) * math.exp(-((math.pi * k / ppd) ** 2) / b) for k in range(-r, r + 1)}

    def unit(taps, s):
        return {k: v / s for k, v in taps.items()}

    gy, gx = gauss(1, 0.0047), gauss(1, 0.0053)
    gy, gx = unit(gy, sum(gy.values())), unit(gx, sum(gx.values()))
    z0, z1 = gauss(34.1, 0.04, True), gauss(13.5, 0.025, True)
    s = math.sqrt(sum(z0.values()) ** 2 + sum(z1.values()) ** 2)
    z0, z1 = unit(z0, s), unit(z1, s)
    sd = 0.041 * ppd
    r = math.ceil(3 * sd)
    g = {k: math.exp(-k * k / (2 * sd * sd)) for k in range(-r, r + 1)}

    def signed(taps):
        up, down = sum(max(v, 0) for v in taps.values()), -sum(min(v, 0) for v in taps.values())
        return {k: v / (up if v >= 0 else down) for k, v in taps.items()}

    d, dd = signed({k: -k * v for k, v in g.items()}), signed({k: (k * k / sd**2 - 1) * v for k, v in g.items()})
    g = unit(g, sum(g.values()))
    seen, edges = [], []
    for rgb in (a, b):
        t = np.clip(rgb, 0, 1) @ to.T / white
        y, cx, cz = 116 * t[..., 1] - 16, 500 * (t[..., 0] - t[..., 1]), 200 * (t[..., 1] - t[..., 2])
        fy, fx, fz = filtered(y, gy, gy), filtered(cx, gx, gx), filtered(cz, z0, z0) + filtered(cz, z1, z1)
        fy = (fy + 16) / 116
        xyz = np.stack([fy + fx / 500, fy, fy - fz / 200], -1) * white
        seen.append(lab(np.clip(xyz @ np.array(P.FROM_XYZ).T, 0, 1)))
        lum = (y + 16) / 116
        edges.append((np.hypot(filtered(lum, d, g), filtered(lum, g, d)), np.hypot(filtered(lum, dd, g), filtered(lum, g, dd))))
    (l0, a0, b0), (l1, a1, b1) = seen
    color = (np.abs(l0 - l1) + np.hypot(a0 - a1, b0 - b1)) ** 0.7
    (m0, ma, mb), (n0, na, nb) = lab(np.array([0.0, 1, 0])), lab(np.array([0.0, 0, 1]))
    most = (abs(m0 - n0) + math.hypot(ma - na, mb - nb)) ** 0.7
    color = np.where(color < 0.4 * most, color * 0.95 / (0.4 * most), 0.95 + (color - 0.4 * most) / (0.6 * most) * 0.05)
    feature = np.sqrt(np.maximum(abs(edges[0][0] - edges[1][0]), abs(edges[0][1] - edges[1][1])) / math.sqrt(2))
    return color ** (1 - feature)


def as_array(img, channel=0, image_id="p"):
    d = img.spec.data
    out = np.full((d.height, d.width), np.nan)
    for r in img.df.filter(f"image_id = '{image_id}'").collect():
        out[r["y"] - d.y0, r["x"] - d.x0] = r[f"c{channel}"]
    return out


def test_flip_of_low_range(spark):
    a, b = pictures(1)
    got = P.flip_diff(table(spark, {"p": a, "q": b}), table(spark, {"p": b, "q": b}), 30.0, None)
    want = plain_flip(a, b, 30.0)
    assert np.allclose(as_array(got), want, atol=1e-9) and np.allclose(as_array(got, 0, "q"), 0)
    r = {x["image_id"]: x for x in P.flip_results(got).collect()}
    y, x = np.unravel_index(want.argmax(), want.shape)
    assert r["p"]["mean_error"] == pytest.approx(want.mean()) and (r["p"]["max_x"], r["p"]["max_y"]) == (x, y)
    assert (r["q"]["mean_error"], r["q"]["max_error"], r["q"]["max_x"], r["q"]["max_y"]) == (0, 0, 0, 0)


@pytest.mark.parametrize("tone", ["aces", "hable", "reinhard"])
def test_flip_of_high_range(spark, tone):
    a, b = pictures(2, 6, 7, 4.0)
    got = P.flip_diff(table(spark, {"p": a}, 3, -2), table(spark, {"p": b}, 3, -2), 20.0, P.Exposures(tone, most=5.0))
    t = P.TONES[tone]
    roots = np.roots([t[i] - 0.85 * t[i + 3] for i in range(3)])
    first, last = math.log2(max(roots) / 5.0), math.log2(max(roots) / 0.18)
    n = max(2, math.ceil(last - first))
    maps = []
    for k in range(n):
        gain = 2 ** (first + k * (last - first) / (n - 1))
        if tone == "reinhard":
            c = [v * gain / (1 + v * gain @ np.array(P.LUMINANCE))[..., None] for v in (a, b)]
        else:
            c = [((v * gain) ** 2 * t[0] + v * gain * t[1] + t[2]) / ((v * gain) ** 2 * t[3] + v * gain * t[4] + t[5]) for v in (a, b)]
        maps.append(plain_flip(*c, 20.0))
    maps = np.array(maps)
    assert np.allclose(as_array(got), maps.max(axis=0), atol=1e-9)
    assert np.allclose(as_array(got, 1), np.where(maps.max(axis=0) > 0, maps.argmax(axis=0) / (n - 1), 0))


def test_exposures_of_the_image(spark):
    a, b = pictures(3, 4, 4, 3.0)
    lum = np.sort((a @ np.array(P.LUMINANCE)).ravel())
    auto = P.flip_diff(table(spark, {"p": a}), table(spark, {"p": b}), 10.0, P.Exposures(most=0))
    same = P.flip_diff(table(spark, {"p": a}), table(spark, {"p": b}), 10.0, P.Exposures(most=lum[-1], median=lum[len(lum) // 2]))
    assert np.allclose(as_array(auto), as_array(same))
    with pytest.raises(Exception, match="first exposure"):
        P.flip_diff(table(spark, {"p": a}), table(spark, {"p": b}), 10.0, P.Exposures(start=2.0, stop=1.0)).df.collect()


def test_pixels_without_a_row_are_black(spark):
    a, b = pictures(4, 5, 5)
    a[1:3, 1:4] = 0
    full, other = table(spark, {"p": a}), table(spark, {"p": b})
    sparse = Image(full.df.filter("c0 + c1 + c2 > 0"), full.spec)
    assert np.allclose(as_array(P.flip_diff(sparse, other, 15.0, None)), plain_flip(a, b, 15.0))


def plain_yee(a, b, luminance, fov):
    m = np.array(P.ADOBE)
    white = m.sum(axis=1)

    def lab(xyz):
        r = xyz / white
        f = np.where(r > 216 / 24389, np.cbrt(r), (24389 / 27 * r + 16) / 116)
        return 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])

    g = np.exp(-2 * (np.arange(-2, 3) * 2 / 5.0) ** 2)
    taps = dict(zip(range(-2, 3), g / g.sum(), strict=True))
    pyramids = []
    for c in (a, b):
        levels = [(c @ m.T)[..., 1] * luminance]
        for _ in range(7):
            levels.append(filtered(levels[-1], taps, taps))
        pyramids.append(levels)
    la, lb = pyramids
    h, w = la[0].shape
    one = 2 * math.tan(math.radians(fov / 2)) * 180 / math.pi
    level = max(i for i in range(8) if 2**i <= one)
    cs = lambda c, lum: 440 * (1 + 0.7 / lum) ** -0.2 * c * math.exp(-(s := 0.3 * (1 + 100 / lum) ** 0.15) * c) * math.sqrt(1 + 0.06 * math.exp(s * c))
    cpd = [0.5 * w / one / 2**i for i in range(8)]
    la_ab, lb_ab = lab(a @ m.T), lab(b @ m.T)
    factors, fails = np.zeros((h, w)), np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            con = [max(abs(p[i][y, x] - p[i + 1][y, x]) for p in pyramids) / max(*(abs(p[i + 2][y, x]) for p in pyramids), 1e-5) for i in range(6)]
            adapt = max((la[level][y, x] + lb[level][y, x]) / 2, 1e-5)
            masks = [(1 + (0.0153 * (392.498 * con[i] * cs(cpd[i], adapt)) ** 0.7) ** 4) ** 0.25 for i in range(6)]
            f = sum(con[i] * cs(3.248, 100) / cs(cpd[i], 100) * masks[i] for i in range(6)) / max(sum(con), 1e-5)
            f = factors[y, x] = min(max(f, 1), 10)
            v = math.log10(adapt)
            tvi = 10 ** (-2.86 if v < -3.94 else (0.405 * v + 1.6) ** 2.18 - 2.86 if v < -1.44 else v - 0.395 if v < -0.0184 else (0.249 * v + 0.65) ** 2.7 - 0.72 if v < 1.9 else v - 1.255)
            hue = sum((p[y, x] - q[y, x]) ** 2 for p, q in zip(la_ab, lb_ab, strict=True)) * (0.01 if adapt < 10 else 1)
            fails[y, x] = abs(la[0][y, x] - lb[0][y, x]) / tvi > f or hue > f
    return factors, fails


@pytest.mark.parametrize(("luminance", "fov", "share"), [(100.0, 45.0, 0.1), (8.0, 60.0, 1.0)])
def test_yee(spark, luminance, fov, share):
    a, b = pictures(5, 8, 9)
    b = a + (b - a) * share
    factors, fails = plain_yee(a, b, luminance, fov)
    shown = P.visible_differences(table(spark, {"p": a}, 2, 1), table(spark, {"p": b}, 2, 1), luminance, fov)
    assert np.allclose(as_array(shown), factors) and (as_array(shown, 1) == fails).all() and 0 < fails.sum() < fails.size
    r = P.compare_yee(table(spark, {"p": a}), table(spark, {"p": b}), luminance, fov).first()
    most = np.where(fails, factors, 0)
    y, x = np.unravel_index(most.argmax(), most.shape)
    assert r["n_fail"] == fails.sum() and r["max_error"] == pytest.approx(most.max()) and (r["max_x"], r["max_y"]) == (x, y)


def test_yee_of_equal_images(spark):
    a, _ = pictures(6, 4, 5)
    assert tuple(P.compare_yee(table(spark, {"p": a}), table(spark, {"p": a})).first()) == ("p", 0, 0.0, 0, 0)
