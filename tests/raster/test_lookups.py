"""Filtered lookups against plain loops over probes."""

import math

import numpy as np
import pytest

from lumenframe.operators import lookups as L
from lumenframe.operators import texture as X

W = H = 16


def textures(spark, seed=1, w=W, h=H, channels=2):
    """The rows of a pyramid of means, and its levels as arrays."""
    a = np.random.default_rng(seed).uniform(0, 1, (h, w, channels))
    levels = [a]
    while max(levels[-1].shape[:2]) > 1:
        v = levels[-1]
        hh, ww = max(1, v.shape[0] // 2), max(1, v.shape[1] // 2)
        levels.append(v[: hh * 2 if v.shape[0] > 1 else 1, : ww * 2 if v.shape[1] > 1 else 1].reshape(hh, v.shape[0] // hh, ww, v.shape[1] // ww, channels).mean(axis=(1, 3)))
    rows = [("p", m, y, x, *map(float, v[y, x])) for m, v in enumerate(levels) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id string, mip int, y int, x int, " + ", ".join(f"c{i} double" for i in range(channels))), levels


def wrap(i, n, mode):
    if mode in ("periodic", "periodicpow2"):
        return i % n
    if mode == "clamp":
        return min(max(i, 0), n - 1)
    if mode == "mirror":
        m = i % (2 * n)
        return m if m < n else 2 * n - 1 - m
    if mode == "periodicsharedborder":
        return i % (max(n, 2) - 1)
    return i if 0 <= i < n else None


def sample(v, s, t, o, ws, wt):
    """Value, derivatives and the weight inside, of one probe on one level."""
    h, w = v.shape[:2]
    px, py = (s * w, t * h) if o.interp == "closest" else (s * w - 0.5, t * h - 0.5)
    x0, y0 = math.floor(px), math.floor(py)

    def weights(f):
        if o.interp == "closest":
            return {0: (1.0, 0.0)}
        if o.interp == "bilinear":
            return {0: (1 - f, -1.0), 1: (f, 1.0)}
        basis = lambda x: [(1 - x) ** 3 / 6, (3 * x**3 - 6 * x**2 + 4) / 6, (-3 * x**3 + 3 * x**2 + 3 * x + 1) / 6, x**3 / 6]
        e = 1e-6
        up, down = basis(f + e), basis(f - e)
        return {i - 1: (basis(f)[i], (up[i] - down[i]) / (2 * e)) for i in range(4)}

    out, ds, dt, inside = np.zeros(v.shape[2]), np.zeros(v.shape[2]), np.zeros(v.shape[2]), 0.0
    for i, (a, da) in weights(px - x0).items():
        for j, (b, db) in weights(py - y0).items():
            x, y = wrap(x0 + i, w, ws), wrap(y0 + j, h, wt)
            if x is not None and y is not None:
                out += a * b * v[y, x]
                ds += w * da * b * v[y, x]
                dt += h * a * db * v[y, x]
                inside += a * b
    return out, ds, dt, inside


def plain_levels(levels, measure, o):
    widths = [measure * min(v.shape[:2]) for v in levels]
    if o.mip == "none":
        return [(0, 1.0)]
    for m, w in enumerate(widths):
        if w <= 1:
            if m == 0:
                return [(0, 1.0)]
            b = min(max(2 * w - 1, 0), 1)
            return [(m, 1.0)] if o.mip == "onelevel" else [(m - 1, 1 - b), (m, b)]
    return [(len(levels) - 1, 1.0)]


def plain_texture(levels, q, o):
    s, t, dsdx, dtdx, dsdy, dtdy = q
    dsdx, dtdx, dsdy, dtdy = dsdx * o.width_s, dtdx * o.width_t, dsdy * o.width_s, dtdy * o.width_t
    lx, ly = math.hypot(dsdx, dtdx), math.hypot(dsdy, dtdy)
    if lx < 1e-8 and ly < 1e-8:
        dsdx, dtdx, dsdy, dtdy = 1e-8, 0, 0, 1e-8
    elif lx < 1e-8:
        dsdx, dtdx = dtdy * 1e-8 / ly, -dsdy * 1e-8 / ly
    elif ly < 1e-8:
        dsdy, dtdy = -dtdx * 1e-8 / lx, dsdx * 1e-8 / lx
    if o.mip in ("trilinear", "none"):
        sf, tf = max(abs(dsdx), abs(dsdy)), max(abs(dtdx), abs(dtdy))
        chosen, probes = plain_levels(levels, (max if o.conservative else min)(sf, tf) + max(o.blur_s, o.blur_t), o), [(0, 0, 1)]
    else:
        # The axes are the singular values of the Jacobian.
        u, size, _ = np.linalg.svd(np.array([[dsdx, dsdy], [dtdx, dtdy]]))
        major, minor = size
        direction = u[:, 0]
        if o.blur_s + o.blur_t:
            c, si = abs(direction)
            major += math.hypot(o.blur_s * c, o.blur_t * si)
            minor += math.hypot(o.blur_s * si, o.blur_t * c)
            if minor > major:
                major, minor, direction = minor, major, np.array([-direction[1], direction[0]])
        aspect = min(max(major / minor, 1), 1e6)
        if aspect > o.anisotropic:
            if o.conservative:
                major = (major + minor * o.anisotropic) / 2
                minor = major / o.anisotropic
            else:
                major = minor * o.anisotropic
            aspect = o.anisotropic
        r = max(levels[0].shape[:2])
        chosen = plain_levels(levels, minor, o)
        if minor * min(levels[0].shape[:2]) <= 1 and minor * r < 0.5:
            aspect = min(max(major * r * 2, 1), o.anisotropic)
        n = max(1, int(2 * aspect - 1))
        length = 2 * (major - minor)
        places = [2 * (i + 0.5) / n - 1 for i in range(n)] if n > 1 else [0.0]
        weights = [1.0 if n <= 2 else math.exp(-2 * (p * major / length) ** 2) for p in places]
        probes = [(p * length / 2 * direction[0], p * length / 2 * direction[1], w / sum(weights)) for p, w in zip(places, weights, strict=True)]
    parts = [np.array(0.0)] * 4
    for m, lw in chosen:
        for ps, pt, w in probes:
            got = sample(levels[m], s + ps, t + pt, o, o.wrap_s, o.wrap_t)
            parts = [a + lw * w * b for a, b in zip(parts, got, strict=True)]
    return parts


QUERIES = [
    (0.3, 0.4, 0.11, 0.02, -0.01, 0.09), (0.9, 0.1, 0.5, 0.3, 0.01, 0.004), (-0.2, 1.3, 0.02, 0.0, 0.0, 0.3), (0.01, 0.99, 0.0, 0.0, 0.0, 0.0),
    (0.5, 0.5, 0.0, 0.0, 0.2, 0.1), (0.45, 0.55, 0.3, 0.1, 0.0, 0.0), (0.7, 0.2, 3.0, 0.0, 0.0, 4.0), (0.123, 0.777, 0.03, -0.04, 0.001, 0.002), (0.6, 0.6, 0.01, 0.0, 0.0, 0.011),
]


@pytest.mark.parametrize(
    "o",
    [
        L.Lookup(), L.Lookup("periodic", "mirror", conservative=False, anisotropic=4), L.Lookup("clamp", "clamp", "onelevel", "closest"), L.Lookup("periodicpow2", "clamp", "trilinear", "bicubic"),
        L.Lookup("mirror", "periodicsharedborder", interp="bicubic", blur_s=0.1, blur_t=0.02), L.Lookup("black", "periodic", "none", width_s=2.0), L.Lookup("periodic", "periodic", "trilinear", conservative=False, blur_t=0.05),
    ],
)
def test_texture(spark, o):
    tiles, levels = textures(spark)
    q = spark.createDataFrame([(i, "p", *v) for i, v in enumerate(QUERIES)], "id int, image_id string, s double, t double, dsdx double, dtdx double, dsdy double, dtdy double")
    got = {r["id"]: r for r in L.texture(tiles, q, W, H, 3, L.Lookup(**{**o.__dict__, "fill": 0.25}), True).collect()}
    assert len(got) == len(QUERIES)
    for i, v in enumerate(QUERIES):
        out, ds, dt, inside = plain_texture(levels, v, o)
        r = got[i]
        assert [r["c0"], r["c1"], r["c2"]] == pytest.approx([*out, inside * 0.25], abs=1e-9), i
        assert [r["ds0"], r["ds1"], r["dt0"], r["dt1"]] == pytest.approx([*ds, *dt], rel=1e-5, abs=1e-5), i
        assert (r["ds2"], r["dt2"]) == (0, 0)


def test_missing_textures(spark):
    tiles, _ = textures(spark)
    q = spark.createDataFrame([(1, "nowhere", *QUERIES[0]), (2, None, *QUERIES[0]), (3, "p", *QUERIES[0])], "id int, image_id string, s double, t double, dsdx double, dtdx double, dsdy double, dtdy double")
    got = {r["id"]: (r["c0"], r["c1"], r["ds0"]) for r in L.texture(tiles, q, W, H, 2, L.Lookup(missing=(1.0, 0.5), fill=0.1), True).collect()}
    assert got[1] == got[2] == (1.0, 0.5, 0.0) and got[3][2] != 0
    assert L.texture(tiles, q, W, H, 2, L.Lookup(fill=0.1)).filter("id = 1").first()["c0"] == 0.1
    assert L.texture(tiles, q.limit(0), W, H, 2).count() == 0


DIRECTIONS = [
    (0.3, 0.2, 0.9, 0.05, 0.0, 0.01, 0.0, 0.06, 0.0), (0.001, 5.0, 0.001, 0.1, 0.0, 0.0, 0.0, 0.0, 0.3), (0.0, -1.0, 0.02, 0.01, 0.0, 0.0, 0.0, 0.0, 0.01), (0.01, 0.1, -1.0, 0.4, 0.0, 0.0, 0.0, 0.01, 0.0),
    (-0.01, 0.1, -1.0, 0.4, 0.0, 0.0, 0.0, 0.01, 0.0), (1.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
]
SCHEMA = "id int, image_id string, rx double, ry double, rz double, xx double, xy double, xz double, yx double, yy double, yz double"


def plain_environment(levels, q, o, tile):
    raw = np.array(q).reshape(3, 3)
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v * 0
    r, a, b = unit(raw[0]), unit(raw[0] + raw[1]), unit(raw[0] + raw[2])
    fx, fy = (max(math.acos(min(max(float(r @ v), -1), 1)), 1e-8) for v in (a, b))
    main, major, minor = (a, fx, fy) if fx >= fy else (b, fy, fx)
    n = 1
    if o.mip == "aniso":
        aspect = min(max(major / minor, 1), 1e6)
        if aspect > o.anisotropic:
            major = (major + minor * o.anisotropic) / 2
            minor, aspect = major / o.anisotropic, o.anisotropic
        n, wide = max(1, math.ceil(aspect - 0.25)), minor
    else:
        wide = major
    widths = [wide * v.shape[0] / math.pi for v in levels]
    m = next((i for i, w in enumerate(widths) if w <= 1), None)
    blend = 0 if m is None or m == 0 else min(max(2 * widths[m] - 1, 0), 1)
    chosen = [(len(levels) - 1, 1.0)] if m is None else [(0, 1.0)] if m == 0 else [(m - 1, 1 - blend), (m, blend)]
    out = np.zeros(levels[0].shape[2])
    for i in range(n):
        x, y, z = r + (-0.5 + (i + 0.5) / n) * main
        s, t = math.atan2(-x, z) / (2 * math.pi) + 0.5, 0.5 - math.atan2(y, math.hypot(z, x)) / math.pi
        for m, lw in chosen:
            v = levels[m]
            h, w = v.shape[:2]
            fade, pole = 0.0, 0
            if w <= tile and h <= tile:
                if t * h < 1:
                    fade = 1 - t * h
                elif t * h > h - 1:
                    fade, pole = t * h - math.floor(t * h), h - 1
            fade = min(max(fade, 0), 1) ** 2
            out = out + lw / n * (fade * v[pole].mean(axis=0) + (1 - fade) * sample(v, s, t, o, "periodic", "clamp")[0])
    return out


@pytest.mark.parametrize(("o", "tile"), [(L.Lookup(), 64), (L.Lookup(mip="trilinear"), 4), (L.Lookup(interp="bicubic", anisotropic=2), 8)])
def test_environment(spark, o, tile):
    tiles, levels = textures(spark, 2, 32, 16)
    got = {r["id"]: r for r in L.environment(tiles, spark.createDataFrame([(i, "p", *v) for i, v in enumerate(DIRECTIONS)], SCHEMA), 32, 16, 2, o, tile=tile).collect()}
    for i, v in enumerate(DIRECTIONS):
        assert [got[i]["c0"], got[i]["c1"]] == pytest.approx(list(plain_environment(levels, v, o, tile)), abs=1e-9), i


def test_no_jump_at_seam_and_poles(spark):
    tiles, _ = textures(spark, 3, 32, 16)
    e, small = 1e-5, (1e-9, 0, 0, 0, 1e-9, 0)
    around = [(i, "p", *map(float, (x, y, z, *small))) for i, (x, y, z) in enumerate([(e, 0.2, -1), (-e, 0.2, -1), (e, 1, 0), (-e, 1, 0), (0, 1, e), (e, -1, 0), (0, -1, -e)])]
    c = [r["c0"] for r in L.environment(tiles, spark.createDataFrame(around, SCHEMA), 32, 16, 1).orderBy("id").collect()]
    assert c[0] == pytest.approx(c[1], abs=1e-3) and c[2] == pytest.approx(c[3], abs=1e-3) == pytest.approx(c[4], abs=1e-3) and c[5] == pytest.approx(c[6], abs=1e-3)


def test_info_and_texels(spark):
    tiles, levels = textures(spark, 4, 8, 4)
    r = L.texture_info(tiles).first()
    assert (r["width"], r["height"], r["levels"], r["channels"]) == (8, 4, 4, 2) and r["mean0"] == pytest.approx(levels[0][..., 0].mean())
    got = {(t["y"], t["x"]): t["c1"] for t in L.texels(tiles, 1, 1, 3, 0, 2).collect()}
    assert got == {(y, x): pytest.approx(levels[1][y, x, 1]) for y in range(2) for x in (1, 2)}


def test_bump_slopes(spark):
    from lumenframe.core import Image, Roi, Spec
    from lumenframe.operators import texture as X

    rng = np.random.default_rng(9)
    v = rng.uniform(-1, 1, (6, 8, 3))
    rows = [("p", 0, y, x, *map(float, v[y, x])) for y in range(6) for x in range(8)]
    roi = Roi(0, 8, 0, 6)
    a = Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, c0 double, c1 double, c2 double"), Spec(roi, roi, tuple("RGB")), True)
    got = lambda b: np.array([[r[f"c{i}"] for i in range(6)] for r in b.df.orderBy("y", "x").collect()]).reshape(6, 8, 6)
    p = np.pad(v[..., 0], 1, mode="edge")
    side = lambda dy, dx: p[1 + dy : 7 + dy, 1 + dx : 9 + dx]
    sobel_s = sum(w * (side(dy, 1) - side(dy, -1)) for dy, w in ((-1, 1), (0, 2), (1, 1))) / 8
    sobel_t = sum(w * (side(1, dx) - side(-1, dx)) for dx, w in ((-1, 1), (0, 2), (1, 1))) / 8
    for out, s, t, h in (
        (X.bump_slopes(a), sobel_s, sobel_t, v[..., 0]),
        (X.bump_slopes(a, kernel="centraldiff", uv_scale=4.0, scale=(-1.0, 2.0)), -(side(0, 1) - side(0, -1)) / 2 * 2, 2 * (side(1, 0) - side(-1, 0)) / 2 * 1.5, v[..., 0]),
        (X.bump_slopes(a, "normal"), -v[..., 0] / v[..., 2], -v[..., 1] / v[..., 2], -np.ones((6, 8))),
        (X.bump_slopes(a, "normal", centered=False), -(v[..., 0] - 0.5) / (v[..., 2] - 0.5), -(v[..., 1] - 0.5) / (v[..., 2] - 0.5), -np.ones((6, 8))),
    ):
        assert np.allclose(got(out), np.stack([h, s, t, s * s, t * t, s * t], -1))
    with pytest.raises(ValueError, match="neither"):
        X.bump_slopes(a, "depth")
    mean = X.make_texture(X.bump_slopes(a)).filter("mip = 1").agg({"c3": "avg"}).first()[0]
    assert mean == pytest.approx((sobel_s[:, :] ** 2).mean())


@pytest.mark.parametrize("most", [0, 30, 10**6])
def test_no_task_gets_the_taps_of_a_coarse_level(spark, most, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_ROWS", most)
    tiles, levels = textures(spark, 5, 32, 16)
    n = 200
    many = [(i, "p" if i % 10 else "none", i / n, 0.3, 0.4, 0.0, 0.0, 0.3 if i % 2 else 0.01) for i in range(n)]
    queries = spark.createDataFrame(many, "id int, image_id string, s double, t double, dsdx double, dtdx double, dsdy double, dtdy double")
    o = L.Lookup("periodic", "clamp", anisotropic=4, missing=(-1.0, -2.0))
    for out in (L.texture(tiles, queries, 32, 16, 2, o), L.environment(tiles, spark.createDataFrame([(i, "p", *v) for i, v in enumerate(DIRECTIONS)], SCHEMA), 32, 16, 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        texel_shuffles = [line for line in plan.splitlines() if "hashpartitioning(image_id" in line and "mip#" in line and "x#" in line]
        assert bool(texel_shuffles) == (most < 10**6)  # only levels that are too large for the tasks
        got = {r["id"]: [r["c0"], r["c1"]] for r in out.collect()}
        if len(got) == n:
            assert all((v == [-1.0, -2.0]) == (i % 10 == 0) for i, v in got.items())
            plain = L.texture(tiles, queries.filter("id = 11"), 32, 16, 2, o).first()
            assert got[11] == pytest.approx([plain["c0"], plain["c1"]], abs=1e-12)
        else:
            for i, v in enumerate(DIRECTIONS):
                assert got[i] == pytest.approx(list(plain_environment(levels, v, L.Lookup(), 64)), abs=1e-9), i
