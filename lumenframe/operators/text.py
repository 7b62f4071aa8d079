"""Captions: characters laid out by running sums of advances, and glyphs joined to pixels.

Glyphs are strokes of a display of sixteen segments, so a font is a small value and
every size is drawn by one rule: a pixel's coverage falls with its centre's distance
from the nearest stroke.  Small letters are capitals of less height.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, per_channel, small_table

#: Strokes in a cell of width and height 1, y downwards to the baseline.
SEGMENTS = {
    "a": (0, 0, 1, 0), "b": (1, 0, 1, 0.5), "c": (1, 0.5, 1, 1), "d": (0, 1, 1, 1), "e": (0, 0.5, 0, 1), "f": (0, 0, 0, 0.5), "g": (0, 0.5, 0.5, 0.5), "h": (0.5, 0.5, 1, 0.5),
    "i": (0, 0, 0.5, 0.5), "j": (0.5, 0, 0.5, 0.5), "k": (1, 0, 0.5, 0.5), "l": (0, 1, 0.5, 0.5), "m": (0.5, 0.5, 0.5, 1), "n": (0.5, 0.5, 1, 1), "p": (0.5, 1, 0.5, 1), "q": (0.5, 0.5, 0.5, 0.5),
}
GLYPHS = {
    " ": "", "!": "jp", '"': "fj", "#": "bcdghjm", "$": "acdfghjm", "%": "cfkl", "&": "adegin", "'": "j", "(": "kn", ")": "il", "*": "ghijklmn", "+": "ghjm", ",": "l", "-": "gh", ".": "p", "/": "kl",
    "0": "abcdefkl", "1": "bck", "2": "abdegh", "3": "abcdh", "4": "bcfgh", "5": "adfgn", "6": "acdefgh", "7": "akl", "8": "abcdefgh", "9": "abcdfgh",
    ":": "pq", ";": "lq", "<": "gkn", "=": "dgh", ">": "hil", "?": "abhp", "@": "abdefhj",
    "A": "abcefgh", "B": "abcdhjm", "C": "adef", "D": "abcdjm", "E": "adefgh", "F": "aefgh", "G": "acdefh", "H": "bcefgh", "I": "adjm", "J": "bcde", "K": "efgkn", "L": "def", "M": "bcefik", "N": "bcefin",
    "O": "abcdef", "P": "abefgh", "Q": "abcdefn", "R": "abefghn", "S": "acdfgh", "T": "ajm", "U": "bcdef", "V": "efkl", "W": "bcefln", "X": "ikln", "Y": "ikm", "Z": "adkl",
    "[": "adjm", "\\": "in", "]": "abcd", "^": "ln", "_": "d", "`": "i", "{": "adgjm", "|": "jm", "}": "adhjm", "~": "hi",
}


#: Side of the blocks in which captions and pixels meet, and glyph cells of a task.
BLOCK, PART_PIXELS = 256, 1 << 20


@dataclass(frozen=True)
class Font:
    """Lengths are shares of the size; a glyph of strokes in the middle of its cell only is narrow."""

    glyphs: dict[str, str] = field(default_factory=lambda: dict(GLYPHS))
    missing: str = "abcdefil"
    wide: float = 0.6
    narrow: float = 0.3
    width: float = 0.45
    height: float = 0.7
    small: float = 0.7
    stroke: float = 0.04

    def drawn(self, ch: str) -> str:
        return self.glyphs.get(ch, self.glyphs.get(ch.upper(), self.missing)) if ch.isascii() else self.glyphs.get(ch, self.missing)

    def is_narrow(self, ch: str) -> bool:
        return set(self.drawn(ch)) <= set("jmpq")

    def advance(self, ch: str, size: int) -> int:
        return round(size * (self.narrow if self.is_narrow(ch) else self.wide))

    def strokes(self, ch: str) -> list[tuple[float, float, float, float]]:
        """Ends of the strokes from the pen on the baseline, in shares of the size."""
        scale = self.small if ch not in self.glyphs and ch.isascii() and ch.islower() else 1.0
        left = (self.narrow if self.is_narrow(ch) else self.wide) / 2 - self.width / 2
        at = lambda u, v: (left + u * self.width, -(1 - v) * self.height * scale)
        return [(*at(a, b), *at(c, d)) for a, b, c, d in (SEGMENTS[s] for s in self.drawn(ch))]

    def pixels(self, ch: str, size: int) -> list[tuple[int, int, float]]:
        """(dx, dy, coverage) of the glyph's pixels, from the pen; those without coverage are left out."""
        strokes = np.array(self.strokes(ch)).reshape(-1, 1, 1, 4) * size
        if not strokes.size:
            return []
        x, y = np.arange(-size, 2 * size)[None, :] + 0.5, np.arange(-2 * size, size)[:, None] + 0.5
        x0, y0, x1, y1 = np.moveaxis(strokes, 3, 0)
        length = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / np.where(length == 0, 1, length), 0, 1)
        far = np.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)).min(0)
        b = np.clip(0.5 + self.stroke * size - far, 0, 1)
        return [(int(i) - size, int(j) - 2 * size, float(b[j, i])) for j, i in zip(*np.nonzero(b), strict=True)]

    @property
    def characters(self) -> list[str]:
        """Those with a glyph; the empty string stands for all others."""
        return sorted({*self.glyphs, *(c.lower() for c in self.glyphs if c.isascii() and c.isalpha()), ""})

    def known(self, ch: Column) -> Column:
        return F.when(ch.isin(self.characters), ch).otherwise(F.lit(""))


def _of(font: Font, ch: str) -> str:
    return ch or "\x00"  # any character without a glyph


def glyph_table(spark: SparkSession, font: Font, size: int, around: int = 0) -> DataFrame:
    """glyph, dx, dy, b (coverage) and a (the largest coverage within `around` pixels); grows with the size alone."""
    rows: list[tuple] = []
    for ch in font.characters:
        own = {(i, j): b for i, j, b in font.pixels(_of(font, ch), size)}
        near: dict[tuple[int, int], float] = {}
        for (i, j), b in own.items():
            for p in ((i + u, j + v) for u in range(-around, around + 1) for v in range(-around, around + 1)):
                near[p] = max(near.get(p, 0.0), b)
        rows += [(ch, i, j, own.get((i, j), 0.0), a) for (i, j), a in near.items()]
    return small_table(spark, rows, "glyph string, dx int, dy int, b double, a double")


def layout(captions: DataFrame, size: int, font: Font | None = None, keys: Iterable[str] = ("image_id",)) -> DataFrame:
    """A row for each character of the column text: keys, line, pos, ch, glyph, and its pen's x and y from the text's origin.

    \\n begins a line, size pixels further down; \\r is nothing.  A null text has no
    row.  Each line is a running sum, so lines and not texts are the unit of work.
    """
    font, keys = font or Font(), list(keys)
    lines = captions.select(*keys, F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("line", "own"))
    chars = lines.select(*keys, "line", F.posexplode(F.filter(F.split("own", ""), lambda c: c != "")).alias("pos", "ch"))
    glyph = font.known(F.col("ch"))
    thin = [c for c in font.characters if font.is_narrow(_of(font, c))]
    step = F.when(glyph.isin(thin), round(size * font.narrow)).otherwise(round(size * font.wide))
    before = Window.partitionBy(*keys, "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return chars.select(*keys, "line", "pos", "ch", glyph.alias("glyph"), F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int").alias("px"), (F.col("line") * size).alias("py"))


def text_size(captions: DataFrame, size: int, font: Font | None = None, keys: Iterable[str] = ("image_id",)) -> DataFrame:
    """keys, x0, x1, y0, y1: the box of all glyphs' pixels; all 0 for a null text or one without any.

    keys must tell the texts apart; texts with the same keys share a box.
    """
    font, keys = font or Font(), list(keys)
    boxes = []
    for ch in font.characters:
        own = font.pixels(_of(font, ch), size)
        if own:
            boxes.append((ch, min(i for i, _, _ in own), max(i for i, _, _ in own) + 1, min(j for _, j, _ in own), max(j for _, j, _ in own) + 1))
    table = small_table(captions.sparkSession, boxes, "glyph string, gx0 int, gx1 int, gy0 int, gy1 int")
    at = [(f(F.col(f"p{k}") + F.col(f"g{k}{n}"))).alias(f"{k}{n}") for k in "xy" for n, f in ((0, F.min), (1, F.max))]
    found = layout(captions, size, font, keys).join(table, "glyph").groupBy(*keys).agg(*at)
    names = [f"{k}{n}" for k in "xy" for n in (0, 1)]
    return captions.select(*keys).distinct().join(found, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def render_text(a: Image, captions: DataFrame | str, x: int, y: int, size: int = 16, color=1.0, font: Font | None = None, alignx: str = "left", aligny: str = "baseline", shadow: int = 0) -> Image:
    """Text over an image, its first pen at x, y; captions is one text, or a table of image_id and text.

    alignx is left, right or center, aligny baseline, top, bottom or center, each by the
    text's own box.  shadow darkens so many pixels around.  An alpha in the colour, also
    a fourth value where the image has no alpha, lets the image through.  Where glyphs
    overlap the larger coverage counts.  Pixels outside the data window are left out;
    an image without a caption, or with a null one, stays as it is.
    """
    font, spark, n = font or Font(), a.df.sparkSession, a.spec.n
    values = list(color) if isinstance(color, list | tuple) else [color]
    opacity = per_channel(values, n)[a.spec.alpha] if a.spec.alpha >= 0 else values[3] if n <= 4 and len(values) == 4 else 1.0
    if isinstance(captions, str):
        captions = a.df.select("image_id").distinct().withColumn("text", F.lit(captions))
    captions = captions.select(F.col("image_id").cast("string").alias("image_id"), "text")
    pens = layout(captions, size, font)
    across, down = F.lit(x), F.lit(y)
    if alignx != "left" or aligny != "baseline":
        pens = pens.join(text_size(captions, size, font), "image_id")
        half = lambda k: F.floor((F.col(f"{k}1") - F.col(f"{k}0")) / 2).cast("int") + F.col(f"{k}0")
        across -= {"left": F.lit(0), "right": F.col("x1") - F.col("x0"), "center": half("x")}[alignx]
        down -= {"baseline": F.lit(0), "top": F.col("y0"), "bottom": F.col("y1"), "center": half("y")}[aligny]
    pens = pens.select("image_id", (F.col("px") + across).cast("int").alias("px"), (F.col("py") + down).cast("int").alias("py"), "glyph")
    # Characters and not their pixels are shuffled, to every block they may reach into; a block has its own pixels only.
    reach = [("y", "py", -2 * size - shadow, size + shadow), ("x", "px", -size - shadow, 2 * size + shadow)]
    for axis, pen, low, high in reach:
        pens = pens.withColumn(f"block_{axis}", F.explode(F.sequence(F.floor((F.col(pen) + low) / BLOCK), F.floor((F.col(pen) + high) / BLOCK))))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    channels = [f"c{i}" for i in range(n)]
    pens = pens.select("image_id", "block_y", "block_x", nothing("z", "int"), nothing("y", "int"), nothing("x", "int"), *[nothing(c, "double") for c in channels], "px", "py", "glyph")
    block = [F.floor(F.col(k) / BLOCK).alias(f"block_{k}") for k in "yx"]
    pixels = a.df.select("image_id", *block, "z", "y", "x", *[c.cast("double").alias(f"c{i}") for i, c in enumerate(a.c)], nothing("px", "int"), nothing("py", "int"), nothing("glyph", "string"))
    length = captions.agg(F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), length * size * size // PART_PIXELS)
    rows = pixels.unionByName(pens).repartition(parts, "image_id", "block_y", "block_x").join(glyph_table(spark, font, size, shadow), "glyph", "left")
    drawn = F.col("glyph").isNotNull()
    own = lambda k, at: F.when(drawn, at).otherwise(F.col(k)).cast("int").alias(k)
    rows = rows.select("image_id", "block_y", "block_x", own("z", F.lit(a.spec.data.z0)), own("y", F.col("py") + F.col("dy")), own("x", F.col("px") + F.col("dx")), *channels, "b", "a", (~drawn).alias("there"))
    # A blank has no pixels, so its place is null.
    inside = a.spec.data.has() & (F.floor(F.col("y") / BLOCK) == F.col("block_y")) & (F.floor(F.col("x") / BLOCK) == F.col("block_x"))
    rows = rows.filter(F.col("there") | inside)
    df = rows.groupBy(*KEYS, "block_y", "block_x").agg(*[F.max(c).alias(c) for c in channels], F.max("b").alias("ink"), F.max("a").alias("shade"), F.max("there").alias("there"))
    df = df.filter("there") if a.whole else df
    ink, shade = F.coalesce("ink", F.lit(0.0)), F.coalesce("shade", F.lit(0.0)) * float(opacity)
    out = [ink * v + (1 - shade) * F.coalesce(c, F.lit(0.0)) for v, c in zip(per_channel(values, n), a.c, strict=True)]
    return Image(df, a.spec, a.whole).with_channels(out, list(a.spec.names))
