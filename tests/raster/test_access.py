import pytest

from lumenframe.core import Roi, Spec, image
from lumenframe.operators import access as X
from lumenframe.operators import deep as D


@pytest.fixture
def small(spark):
    rows = [("a", y, x, 10.0 * y + x + 1) for y in range(2) for x in range(3)] + [("b", 0, 0, 7.0)]
    return image(spark.createDataFrame(rows, "image_id string, y int, x int, c0 double"), Roi(0, 3, 0, 2), ["Y"])


@pytest.mark.parametrize(("at", "wrap", "want"), [((1, 1), "black", 12), ((3, 0), "black", 0), ((5, -1), "clamp", 3), ((4, 3), "periodic", 12), ((3, 2), "mirror", 13), ((-1, 0), "mirror", 1)])
def test_getpixel(small, at, wrap, want):
    got = {r["image_id"]: r["c0"] for r in X.getpixel(small, *at, wrap=wrap).collect()}
    assert got["a"] == want and set(got) == {"a", "b"}


def test_set_and_get(small):
    changed = X.setpixel(X.set_pixels(small, Roi(1, 9, 0, 1), [5.0]), 0, 1, [9.0, 4.0])
    got = {(r["image_id"], r["y"], r["x"]): r["c0"] for r in changed.df.collect()}
    assert len(got) == 12 and got["a", 0, 2] == got["b", 0, 1] == 5 and got["b", 1, 0] == 9 and got["a", 1, 1] == 12 and got["b", 0, 0] == 7
    region = X.get_pixels(small, Roi(-1, 4, 0, 1), "periodic")
    assert [r["c0"] for r in region.df.filter("image_id = 'a'").orderBy("x").collect()] == [3, 1, 2, 3, 1]
    black = X.get_pixels(small, Roi(2, 4, 1, 3))
    assert [r["c0"] for r in black.df.filter("image_id = 'a'").orderBy("y", "x").collect()] == [13, 0, 0, 0]


def test_windows_and_metadata(small):
    assert X.contains_roi(small, Roi(0, 3, 1, 2)) and not X.contains_roi(small, Roi(0, 4, 0, 1)) and not X.contains_roi(small, Roi(0, 1, 0, 1), 0, 2)
    a = type(small)(small.df, Spec(small.spec.data, small.spec.full, ("Y",), {"artist": "me", "Orientation": 6}))
    b = type(small)(small.df, Spec(small.spec.data, Roi(0, 9, 0, 9), ("Y",), {"artist": "you", "year": 3, "Year": 4}))
    assert X.copy_metadata(a, b).spec.attribs == b.spec.attribs and X.copy_metadata(a, b).spec.full.width == 9
    assert X.merge_metadata(a, b).spec.attribs == {"artist": "me", "Orientation": 6, "year": 3, "Year": 4}
    assert X.merge_metadata(a, b, True, "^art").spec.attribs == {"artist": "you", "Orientation": 6}
    assert X.oriented(a)["width"] == 2 and X.oriented(b)["width"] == 3


def test_deep_samples(spark):
    s = lambda z: (0.1, 0.2, 0.3, 0.5, z, z + 1)
    schema = f"image_id string, z int, y int, x int, samples {D.SAMPLES}"
    deep = spark.createDataFrame([("a", 0, 0, 0, [s(1.0), s(5.0)]), ("a", 0, 0, 1, [])], schema)
    other = spark.createDataFrame([("a", 0, 0, 0, [s(9.0)])], schema)
    depths = lambda df: {r["x"]: [t["Z"] for t in r["samples"]] for r in df.collect()}
    assert {r["x"]: r["v"] for r in X.deep_value(deep, "Z", 1).collect()} == {0: 5.0, 1: 0.0}
    assert depths(X.set_deep_value(deep, "Z", 1, 6.0)) == {0: [1, 6], 1: []}
    assert depths(X.copy_deep_sample(deep, 0, other, 0)) == {0: [9, 5], 1: []} and depths(X.copy_deep_sample(deep, 5, other, 0)) == {0: [1, 5, 9], 1: []}
    assert depths(X.copy_deep_pixel(deep, other)) == {0: [9], 1: []} and depths(X.copy_deep_pixel(deep, other, -1)) == {0: [1, 5], 1: [9]}


@pytest.mark.parametrize("mode", ["black", "clamp", "periodic", "mirror"])
def test_regions_by_arithmetic(spark, mode):
    from lumenframe.core import Image, Roi, Spec
    from lumenframe.operators import access as X

    data = Roi(2, 5, -1, 3)
    rows = [("a", 0, y, x, float(10 * y + x + 100)) for y in range(-1, 3) for x in range(2, 5)]
    a = Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, c0 double"), Spec(data, data, ("Y",)), True)

    def source(v, lo, hi):
        n, m = hi - lo, (v - lo) % (2 * (hi - lo))
        return {"black": v if lo <= v < hi else None, "clamp": min(max(v, lo), hi - 1), "periodic": lo + (v - lo) % n, "mirror": lo + (m if m < n else 2 * n - 1 - m)}[mode]

    for roi in (Roi(-9, 12, -7, 9), Roi(3, 4, 0, 2), Roi(6, 9, -1, 3), Roi(-6, 1, 5, 6)):
        got = {(r["y"], r["x"]): r["c0"] for r in X.get_pixels(a, roi, mode).df.collect()}
        want = {}
        for y in range(roi.y0, roi.y1):
            for x in range(roi.x0, roi.x1):
                sy, sx = source(y, -1, 3), source(x, 2, 5)
                want[y, x] = 0.0 if sy is None or sx is None else 10.0 * sy + sx + 100
        assert got == want
