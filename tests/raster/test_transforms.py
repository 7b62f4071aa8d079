"""Colour transforms against plain numpy."""

import math
from dataclasses import replace

import numpy as np
import pytest

from lumenframe.core import Image, Roi, Spec
from lumenframe.operators import color
from lumenframe.operators import transforms as T

WARM = T.Grade((1.1, 1.0, 0.8), (0.01, 0.0, -0.02), (1.2, 1.0, 0.9), 0.8)


def config():
    c = T.default_config()
    views = {"sRGB": {"Film": T.View("srgb", ("warm",)), "Plain": T.View("srgb")}, "Wide": {"Film": T.View("lin_rec2020", ("warm", "cold"))}}
    looks = {"warm": T.Look("acescg", (WARM,)), "cold": T.Look("srgb", (T.Matrix(((0.9, 0, 0), (0, 1, 0), (0, 0, 1.2)), (0.0, 0.0, 0.01)),))}
    return replace(c, looks=looks, displays=views, named={"bright": (T.Curve("g2", lambda v: v * v, lambda v: v**0.5), T.Matrix(((2, 0, 0), (0, 2, 0), (0, 0, 2))))}, roles=c.roles | {"paint": "color_picking"})


def pixels(spark, values, alpha=True):
    rows = [("p", 0, 0, i, *map(float, v)) for i, v in enumerate(values)]
    n = len(values[0])
    return Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, " + ", ".join(f"c{i} double" for i in range(n))), Spec(Roi(0, len(values), 0, 1), Roi(0, len(values), 0, 1), tuple("RGBA"[:n])), True)


def got(a):
    return np.array([[r[f"c{i}"] for i in range(a.spec.n)] for r in a.df.orderBy("x").collect()])


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(0).uniform(0.02, 0.98, (40, 4))


def test_names():
    c = config()
    assert c.space("sRGB") == c.space("paint") == c.space("PAINT") == c.space("srgb_rec709_scene") == "srgb" and c.space("scene_linear") == c.space("linear") == "lin_rec709"
    with pytest.raises(ValueError, match="unknown colour space"):
        c.space("nothing")
    with pytest.raises(ValueError, match="unknown colour space"):
        replace(c, roles={"a": "b", "b": "a"}).space("a")
    assert ("view", "Film", "Wide") in c.inventory() and ("look", "warm", "acescg") in c.inventory()


def test_folding():
    c = T.default_config()
    way = T.folded(c.between("srgb", "acescg"))
    assert [type(s) for s in way] == [T.Curve, T.Matrix]
    assert T.folded([*c.between("srgb", "g22_rec709"), *c.between("g22_rec709", "srgb")]) == [] and T.folded(c.between("lin_rec709", "linear")) == []
    assert [type(s) for s in T.folded(c.between("srgb", "g22_rec709"))] == [T.Curve, T.Curve]


def test_conversion_agrees_with_convert(spark, values):
    a = pixels(spark, values)
    for s, t in (("srgb", "acescg"), ("lin_rec2020", "rec709"), ("xyz", "srgb")):
        out = T.apply(a, T.default_config().between(s, t))
        if s != "xyz":
            assert np.allclose(got(out), got(color.convert(a, s, t)))
    plan = T.apply(a, T.default_config().between("srgb", "acescg")).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def graded(v):
    x = np.clip(v * np.array(WARM.slope) + np.array(WARM.offset), 0, 1) ** np.array(WARM.power)
    luma = (x @ np.array(T.LUMA))[:, None]
    return luma + (x - luma) * WARM.saturation


def to_linear(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def from_linear(v):
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)


def m(a, b):
    return np.linalg.inv(color.to_xyz(b)) @ color.to_xyz(a)


def test_look(spark, values):
    a, c = pixels(spark, values), config()
    rgb = values[:, :3]
    want = from_linear(graded(rgb @ m("rec709", "acescg").T) @ m("acescg", "rec709").T)
    out = T.look(a, "warm", "scene_linear", "paint", c)
    assert np.allclose(got(out)[:, :3], want) and np.allclose(got(out)[:, 3], values[:, 3]) and out.spec.attribs["colorspace"] == "srgb"
    both = T.look(a, "warm, +cold", "lin_rec709", "srgb", c)
    assert np.allclose(got(both)[:, :3], want * [0.9, 1, 1.2] + [0, 0, 0.01])
    with pytest.raises(ValueError, match="unknown look"):
        T.look(a, "none", "srgb", "srgb", c)


def test_inverse_look(spark):
    v = np.random.default_rng(1).uniform(0.3, 0.6, (20, 3))
    a, c = pixels(spark, v), config()
    there = T.look(a, "warm,cold", "lin_rec709", "acescg", c)
    back = T.look(there, "warm,cold", "acescg", "lin_rec709", c, inverse=True)
    assert np.allclose(got(back), v)
    assert np.allclose(got(T.look(there, "-cold,-warm", "acescg", "lin_rec709", c)), v)


def test_display(spark, values):
    a, c = pixels(spark, values), config()
    out = T.display(a, "", "", "acescg", c)
    assert np.allclose(got(out)[:, :3], from_linear(graded(values[:, :3]) @ m("acescg", "rec709").T)) and out.spec.attribs["colorspace"] == "srgb"
    plain = T.display(a, "sRGB", "Plain", "lin_rec709", c)
    assert np.allclose(got(plain)[:, :3], from_linear(values[:, :3]))
    assert np.allclose(got(T.display(plain, "sRGB", "Plain", "lin_rec709", c, inverse=True)), values)
    cold = T.display(a, "sRGB", "Plain", "srgb", c, looks="cold")
    assert np.allclose(got(cold)[:, :3], values[:, :3] * [0.9, 1, 1.2] + [0, 0, 0.01])
    for d, v in (("x", ""), ("sRGB", "x")):
        with pytest.raises(ValueError, match="unknown"):
            T.display(a, d, v, "srgb", c)


def test_named_and_premultiplied(spark, values):
    a, c = pixels(spark, values), config()
    out = T.named_transform(a, "bright", c)
    assert np.allclose(got(out)[:, :3], 2 * values[:, :3] ** 2) and np.allclose(got(T.named_transform(out, "bright", c, inverse=True)), values)
    alpha = values[:, 3:]
    assert np.allclose(got(T.named_transform(a, "bright", c, unpremultiply=True))[:, :3], 2 * (values[:, :3] / alpha) ** 2 * alpha)


def cube(n, f, low=0.0, high=1.0):
    grid = [tuple(low + (high - low) * k / (n - 1) for k in (r, g, b)) for b in range(n) for g in range(n) for r in range(n)]
    return f"TITLE \"t\"\nLUT_3D_SIZE {n}\nDOMAIN_MIN {low} {low} {low}\nDOMAIN_MAX {high} {high} {high}\n# rows\n" + "\n".join(" ".join(map(repr, f(*p))) for p in grid)


def tetrahedral(v, n, f):
    """By barycentric weights of the simplex whose vertices are sorted by fraction."""
    p = np.clip(v, 0, 1) * (n - 1)
    i = np.minimum(np.floor(p).astype(int), n - 2)
    frac = p - i
    order = sorted(range(3), key=lambda k: -frac[k])
    at, out, last = i.copy(), np.zeros(3), 1.0
    for k in order:
        out += (last - frac[k]) * np.array(f(*(at / (n - 1))))
        last = frac[k]
        at[k] += 1
    return out + last * np.array(f(*(at / (n - 1))))


def bent(r, g, b):
    return r * r * (1 - 0.2 * g), 0.5 * g + 0.3 * b * b, math.sin(b + r)


@pytest.mark.parametrize("limit", [T.LITERAL_CELLS, 10])
def test_lattice(spark, values, monkeypatch, limit):
    monkeypatch.setattr(T, "LITERAL_CELLS", limit)
    v = np.concatenate([values * 1.3 - 0.1, [[0, 0, 0, 1], [1, 1, 1, 1], [0.5, 0.5, 0.5, 1], [0.25, 0.25, 0.8, 0], [1, 0, 1, 0.5]]])
    same = T.file_transform(pixels(spark, v), cube(5, lambda r, g, b: (r, g, b)))
    assert np.allclose(got(same)[:, :3], np.clip(v[:, :3], 0, 1)) and np.allclose(got(same)[:, 3], v[:, 3])
    out = got(T.file_transform(pixels(spark, v), cube(5, bent)))
    assert np.allclose(out[:, :3], [tetrahedral(x, 5, bent) for x in v[:, :3]])
    with pytest.raises(ValueError, match="no inverse"):
        T.file_transform(pixels(spark, v), cube(5, bent), inverse=True)


def test_tables_of_one_dimension(spark, values):
    text = "LUT_1D_SIZE 5\nLUT_1D_INPUT_RANGE 0 2\n" + "\n".join(f"{(k / 4) ** 2} {k / 4} {k / 2 + 0.1}" for k in range(5))
    out = T.file_transform(pixels(spark, values), text)
    want = np.stack([np.interp(values[:, i], np.linspace(0, 2, 5), row) for i, row in enumerate([[(k / 4) ** 2 for k in range(5)], [k / 4 for k in range(5)], [k / 2 + 0.1 for k in range(5)]])], 1)
    assert np.allclose(got(out)[:, :3], want) and np.allclose(got(T.file_transform(out, text, inverse=True)), values)
    for bad in ("1 2 3", "LUT_3D_SIZE 2\n0 0 0", "LUT_1D_SIZE 3\n0 0 0", "LUT_1D_SIZE 2\nDOMAIN_MIN 0 1 0\n0 0 0\n1 1 1"):
        with pytest.raises(ValueError):
            T.read_cube(bad)


def test_missing_rows_are_black(spark, values):
    a = pixels(spark, values)
    sparse = Image(a.df.filter("x > 3"), a.spec)
    out = got(T.apply(sparse, [T.Matrix(((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0.5, 0.0, 0.0))]))
    assert len(out) == len(values) and np.allclose(out[:4], [[0.5, 0, 0, 0]] * 4)
