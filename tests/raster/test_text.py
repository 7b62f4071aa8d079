"""Captions against plain Python."""

import numpy as np
import pytest

from lumenframe.core import Image, Roi, Spec
from lumenframe.operators import text as T
from lumenframe.plans.command import command_line

TEXTS = {"p": "Ab 1!\nxyz", "q": "", "r": None, "s": "i\r\n\n#ß.", "t": "  ", "u": "a" * 300}
SIZE = 11


def pens(text, font, size):
    out, x, y = [], 0, 0
    for ch in text or "":
        if ch == "\n":
            x, y = 0, y + size
        elif ch != "\r":
            out.append((ch, x, y))
            x += font.advance(ch, size)
    return out


def box(text, font, size):
    own = [(x + i, y + j) for ch, x, y in pens(text, font, size) for i, j, _ in font.pixels(ch, size)]
    return (min(i for i, _ in own), max(i for i, _ in own) + 1, min(j for _, j in own), max(j for _, j in own) + 1) if own else (0, 0, 0, 0)


def captions(spark):
    return spark.createDataFrame(list(TEXTS.items()), "image_id string, text string")


def test_glyphs():
    """Coverage by the formula, pixel by pixel; what is narrow; small letters and unknown characters."""
    font = T.Font()
    got = {(i, j): b for i, j, b in font.pixels("K", 16)}
    for j in range(-14, 4):
        for i in range(-3, 14):
            far = 1e9
            for x0, y0, x1, y1 in np.array(font.strokes("K")) * 16:
                u, v = np.array([x1 - x0, y1 - y0]), np.array([i + 0.5 - x0, j + 0.5 - y0])
                far = min(far, np.linalg.norm(v - np.clip(u @ v / (u @ u), 0, 1) * u))
            assert got.get((i, j), 0.0) == pytest.approx(min(max(0.5 + 0.04 * 16 - far, 0), 1))
    assert font.advance("!", 10) == 3 and font.advance("W", 10) == 6 and font.drawn("ß") == font.missing and font.pixels(" ", 9) == []
    assert min(j for _, j, _ in font.pixels("x", 20)) > min(j for _, j, _ in font.pixels("X", 20))
    assert len({font.drawn(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}) == 36


def test_layout_and_size(spark):
    font = T.Font()
    got = {}
    for r in T.layout(captions(spark), SIZE).orderBy("image_id", "line", "pos").collect():
        got.setdefault(r["image_id"], []).append((r["ch"], r["px"], r["py"]))
    assert got == {k: pens(v, font, SIZE) for k, v in TEXTS.items() if pens(v, font, SIZE)}
    assert {r[0]: tuple(r[1:]) for r in T.text_size(captions(spark), SIZE).collect()} == {k: box(v, font, SIZE) for k, v in TEXTS.items()}


@pytest.mark.parametrize(("alignx", "aligny", "shadow", "whole"), [("left", "baseline", 0, False), ("center", "top", 2, True), ("right", "bottom", 1, False), ("left", "center", 0, True)])
def test_render(spark, alignx, aligny, shadow, whole):
    font, w, h, at, color = T.Font(), 50, 30, (20, 14), [0.9, 0.25, 0.5]
    rng = np.random.default_rng(3)
    base = {k: rng.uniform(0, 1, (h, w, 3)) for k in TEXTS}
    if not whole:
        for k in base:
            base[k][rng.uniform(size=(h, w)) < 0.5] = 0
    rows = [(k, 0, y, x, *map(float, base[k][y, x])) for k in base for y in range(h) for x in range(w) if whole or base[k][y, x].any()]
    a = Image(spark.createDataFrame(rows, "image_id string, z int, y int, x int, c0 double, c1 double, c2 double"), Spec(Roi(0, w, 0, h), Roi(0, w, 0, h), ("R", "G", "A")), whole)
    out = T.render_text(a, captions(spark), *at, SIZE, color, None, alignx, aligny, shadow)
    got = {k: np.zeros((h, w, 3)) for k in TEXTS}
    for r in out.df.collect():
        got[r["image_id"]][r["y"], r["x"]] = r["c0"], r["c1"], r["c2"]
    for k, text in TEXTS.items():
        x0, x1, y0, y1 = box(text, font, SIZE)
        dx = at[0] - {"left": 0, "right": x1 - x0, "center": (x1 - x0) // 2 + x0}[alignx]
        dy = at[1] - {"baseline": 0, "top": y0, "bottom": y1, "center": (y1 - y0) // 2 + y0}[aligny]
        wide = np.zeros((h + 400, w + 6000))  # the window begins at 200, 3000
        for ch, px, py in pens(text, font, SIZE):
            for i, j, b in font.pixels(ch, SIZE):
                p = 200 + dy + py + j, 3000 + dx + px + i
                wide[p] = max(wide[p], b)
        cut = lambda v, u: wide[200 + v : 200 + v + h, 3000 + u : 3000 + u + w]  # noqa: E731, B023
        ink, near = cut(0, 0), np.max([cut(v, u) for v in range(-shadow, shadow + 1) for u in range(-shadow, shadow + 1)], 0)
        assert np.allclose(got[k], ink[..., None] * color + (1 - near * 0.5)[..., None] * base[k], atol=1e-9), k


def test_command(spark):
    c = command_line(spark, ["--create", "40x20", "3", "--text:x=4:y=15:size=12:color=1,0.5,0", "Hi"])
    want = {(4 + px + i, 15 + j): b for ch, px, _ in pens("Hi", T.Font(), 12) for i, j, b in T.Font().pixels(ch, 12)}
    got = {(r["x"], r["y"]): (r["c0"], r["c1"], r["c2"]) for r in c.stack[-1].df.collect() if r["c0"]}
    assert got.keys() == want.keys() and all(np.allclose(got[k], (want[k], want[k] / 2, 0)) for k in want)


def test_pixels_of_glyphs_are_not_shuffled(spark, monkeypatch):
    roi = Roi(0, 90, 0, 30)
    a = Image(spark.createDataFrame([("a", 0, y, x, 0.5) for y in range(30) for x in range(0, 90, 2)], "image_id string, z int, y int, x int, c0 double"), Spec(roi, roi, ("Y",)))
    texts = spark.createDataFrame([("a", "Ab 1"), ("b", "xy"), ("c", None)], "image_id string, text string")
    drawn = lambda: T.render_text(a, texts, 3, 20, 12, 0.9, shadow=2).df
    plan = drawn()._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and " y#" in line]  # by blocks, not by pixels
    whole = {tuple(r) for r in drawn().collect()}
    monkeypatch.setattr(T, "BLOCK", 7)  # glyphs that reach into several blocks
    assert {tuple(r) for r in drawn().collect()} == whole and {r[0] for r in whole} == {"a", "b"}
