"""Colour transforms as a graph: spaces, roles, aliases, looks, displays with views, named transforms and files of tables.

A request becomes a list of steps at plan time: the way from one space to the
reference and on to another, with looks in their own spaces between.  Steps that
undo each other go, neighbouring matrices become one, and what is left is one
projection, but for three-dimensional tables, which take their input from a column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, total
from lumenframe.operators import color
from lumenframe.operators.arithmetic import premult, unpremult

#: Tables of up to so many cells are a literal of the plan; larger ones are joined.
LITERAL_CELLS = 40_000
# Weights of luminance for saturation.
LUMA = (0.2126, 0.7152, 0.0722)

Triple = list[Column]


class Step:
    """A change of three channels."""

    def inverse(self) -> Step:
        raise ValueError(f"{type(self).__name__} has no inverse")

    def apply(self, c: Triple) -> Triple:
        raise NotImplementedError


@dataclass(frozen=True)
class Matrix(Step):
    """m times the channels, plus an offset."""

    m: tuple[tuple[float, ...], ...]
    offset: tuple[float, ...] = (0.0, 0.0, 0.0)

    def inverse(self) -> Matrix:
        m = np.linalg.inv(np.array(self.m))
        return _matrix(m, -m @ np.array(self.offset))

    def apply(self, c: Triple) -> Triple:
        return [total([v * float(w) for v, w in zip(c, row, strict=True)]) + o for row, o in zip(self.m, self.offset, strict=True)]

    def after(self, first: Matrix) -> Matrix:
        m = np.array(self.m)
        return _matrix(m @ np.array(first.m), m @ np.array(first.offset) + np.array(self.offset))

    @property
    def same(self) -> bool:
        return np.allclose(self.m, np.eye(3), atol=1e-12) and np.allclose(self.offset, 0, atol=1e-12)


def _matrix(m: np.ndarray, offset: np.ndarray | None = None) -> Matrix:
    return Matrix(tuple(tuple(map(float, row)) for row in m), tuple(map(float, np.zeros(3) if offset is None else offset)))


@dataclass(frozen=True)
class Curve(Step):
    """A function of each channel and its inverse."""

    name: str
    to: Callable[[Column], Column]
    back: Callable[[Column], Column]

    def inverse(self) -> Curve:
        return Curve(self.name.removesuffix("-inverse") if self.name.endswith("-inverse") else f"{self.name}-inverse", self.back, self.to)

    def apply(self, c: Triple) -> Triple:
        return [self.to(v) for v in c]


@dataclass(frozen=True)
class Grade(Step):
    """(v * slope + offset, cut to 0 to 1) to a power for each channel, then saturation about the luminance."""

    slope: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    power: tuple[float, float, float] = (1.0, 1.0, 1.0)
    saturation: float = 1.0
    backwards: bool = False

    def inverse(self) -> Grade:
        return replace(self, backwards=not self.backwards)

    def apply(self, c: Triple) -> Triple:
        unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        luma = lambda x: total([v * w for v, w in zip(x, LUMA, strict=True)])
        parts = list(zip(self.slope, self.offset, self.power, strict=True))
        if not self.backwards:
            v = [F.pow(unit(x * s + o), F.lit(p)) for x, (s, o, p) in zip(c, parts, strict=True)]
            return [luma(v) + (x - luma(v)) * self.saturation for x in v] if self.saturation != 1 else v
        v = [luma(c) + (x - luma(c)) / self.saturation for x in c] if self.saturation != 1 else c
        return [(F.pow(unit(x), F.lit(1 / p)) - o) / s for x, (s, o, p) in zip(v, parts, strict=True)]


@dataclass(frozen=True)
class Table1D(Step):
    """Values at equal steps of [low, high] for each channel, straight between them, constant beyond."""

    values: tuple[tuple[float, ...], ...]
    low: float = 0.0
    high: float = 1.0
    backwards: bool = False

    def inverse(self) -> Table1D:
        for row in self.values:
            if any(b <= a for a, b in zip(row, row[1:], strict=False)):
                raise ValueError("only a growing table has an inverse")
        return replace(self, backwards=not self.backwards)

    def apply(self, c: Triple) -> Triple:
        n = len(self.values[0])
        out = []
        for v, row in zip(c, self.values, strict=True):
            table = F.lit(np.array(row, float))
            if self.backwards:
                out.append(self._inverted(v, table, n))
                continue
            at = F.least(F.greatest((v - self.low) / (self.high - self.low), F.lit(0.0)), F.lit(1.0)) * (n - 1)
            i = F.least(F.floor(at).cast("int"), F.lit(n - 2))
            out.append(F.get(table, i) * (1 - (at - i)) + F.get(table, i + 1) * (at - i))
        return out

    def _inverted(self, v: Column, table: Column, n: int) -> Column:
        """Each segment adds as much of its width as lies below v."""
        share = lambda i: F.least(F.greatest((v - F.get(table, i)) / (F.get(table, i + 1) - F.get(table, i)), F.lit(0.0)), F.lit(1.0))
        below = F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), F.lit(0.0), lambda acc, i: acc + share(i))
        return self.low + (self.high - self.low) / (n - 1) * below


@dataclass(frozen=True)
class Table3D(Step):
    """size ** 3 colours, red fastest, over [low, high] of each channel; between them by tetrahedra, clamped beyond."""

    size: int
    colors: tuple[tuple[float, float, float], ...]
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self) -> None:
        if self.size < 2 or len(self.colors) != self.size**3:
            raise ValueError(f"a table of size {self.size} needs {self.size ** 3} colours, not {len(self.colors)}")

    def apply(self, c: Triple) -> Triple:
        columns = [F.lit(np.array([v[k] for v in self.colors], float)) for k in range(3)]
        cells = corners(c, self.size, self.low, self.high)
        return [total([w * F.get(column, cell) for cell, w in cells]) for column in columns]


def corners(c: Triple, n: int, low: float, high: float) -> list[tuple[Column, Column]]:
    """(cell, weight) of the four corners of the tetrahedron that holds a colour.

    From the cell's near corner it walks to the far one along the axes, that of the
    largest fraction first.
    """
    at = [F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (n - 1) for v in c]
    cell = [F.least(F.floor(v).cast("int"), F.lit(n - 2)) for v in at]
    r, g, b = (v - i for v, i in zip(at, cell, strict=True))
    strides = (1, n, n * n)
    base = total([i * s for i, s in zip(cell, strides, strict=True)])
    first = F.when((r >= g) & (r >= b), strides[0]).when(g >= b, strides[1]).otherwise(strides[2])
    last = F.when((b <= g) & (b <= r), strides[2]).when(g <= r, strides[1]).otherwise(strides[0])
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    middle = r + g + b - most - least
    # Ties leave a corner without weight, whichever it is.
    return [(base, 1 - most), (base + first, most - middle), (base + sum(strides) - last, middle - least), (base + sum(strides), least)]


def joined_table(a: Image, lattice: DataFrame, size: int, low: float = 0.0, high: float = 1.0) -> Image:
    """Table3D of a table (cell, v0, v1, v2; cell as r + size * (g + size * b)) too large for a plan: four rows a pixel meet it in a join."""
    cells = corners([F.col(f"c{i}") for i in range(3)], size, low, high)
    taps = F.array(*[F.struct(cell.cast("int").alias("cell"), w.alias("w")) for cell, w in cells])
    own = [f"c{i}" for i in range(a.spec.n)]
    rows = a.dense().df.select(*KEYS, *own, F.explode(taps).alias("tap")).select(*KEYS, *own, "tap.*").filter("w > 0")
    rows = rows.join(lattice.select("cell", *[F.col(f"v{i}").cast("double").alias(f"v{i}") for i in range(3)]), "cell")
    sums = [F.sum(F.col("w") * F.col(f"v{i}")).alias(f"c{i}") for i in range(3)] + [F.max(c).alias(c) for c in own[3:]]
    return Image(rows.groupBy(*KEYS).agg(*sums), a.spec, True)


def read_cube(text: str) -> Step:
    """The step of a .cube file: LUT_1D_SIZE or LUT_3D_SIZE, DOMAIN_MIN and DOMAIN_MAX of equal channels, and rows of three numbers."""
    low, high, size, kind, rows = 0.0, 1.0, 0, "", []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words or words[0] == "TITLE":
            continue
        if words[0] in ("LUT_1D_SIZE", "LUT_3D_SIZE"):
            kind, size = words[0][4:6], int(words[1])
        elif words[0] in ("DOMAIN_MIN", "DOMAIN_MAX"):
            if len(set(words[1:])) != 1:
                raise ValueError("the channels' domains differ")
            low, high = (float(words[1]), high) if words[0].endswith("MIN") else (low, float(words[1]))
        elif words[0].endswith("INPUT_RANGE"):
            low, high = float(words[1]), float(words[2])
        else:
            rows.append(tuple(map(float, words)))
    if not kind or any(len(r) != 3 for r in rows):
        raise ValueError("this is no table of colours")
    if kind == "3D":
        return Table3D(size, tuple(rows), low, high)
    if len(rows) != size or size < 2:
        raise ValueError(f"a table of size {size} needs as many rows, not {len(rows)}")
    return Table1D(tuple(zip(*rows, strict=True)), low, high)


@dataclass(frozen=True)
class Look:
    space: str
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class View:
    space: str
    looks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """spaces: the steps to the reference; names are found whatever their case, first as they are, then as roles and aliases."""

    spaces: dict[str, tuple[Step, ...]]
    roles: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    looks: dict[str, Look] = field(default_factory=dict)
    displays: dict[str, dict[str, View]] = field(default_factory=dict)
    named: dict[str, tuple[Step, ...]] = field(default_factory=dict)
    default_display: str = ""

    def space(self, name: str) -> str:
        """The space that a name, role or alias stands for; a role may name an alias."""
        seen: set[str] = set()
        while name.lower() not in seen:
            seen.add(name.lower())
            for known in self.spaces:
                if known.lower() == name.lower():
                    return known
            for table in (self.roles, self.aliases):
                for known, other in table.items():
                    if known.lower() == name.lower():
                        name = other
                        break
                else:
                    continue
                break
        raise ValueError(f"unknown colour space {name!r}")

    def between(self, source: str, target: str) -> list[Step]:
        a, b = self.space(source), self.space(target)
        return [] if a == b else [*self.spaces[a], *reversed([s.inverse() for s in self.spaces[b]])]

    def through_looks(self, looks: Sequence[str] | str, source: str, target: str, inverse: bool = False) -> list[Step]:
        """Looks one after the other, each in its own space; -name undoes a look, and inverse all of them from the last on."""
        words = [w.strip() for w in looks.replace(":", ",").split(",")] if isinstance(looks, str) else list(looks)
        words = [w for w in words if w]
        if inverse:
            words = [w[1:] if w.startswith("-") else f"-{w.lstrip('+')}" for w in reversed(words)]
        out, at = [], source
        for word in words:
            name = word.lstrip("+-")
            if name not in self.looks:
                raise ValueError(f"unknown look {name!r}")
            look = self.looks[name]
            out += self.between(at, look.space)
            out += reversed([s.inverse() for s in look.steps]) if word.startswith("-") else look.steps
            at = look.space
        return out + self.between(at, target)

    def to_display(self, display: str, view: str, source: str, looks: Sequence[str] | str | None = None, inverse: bool = False) -> list[Step]:
        """To a display's view, through the view's looks unless others are given; empty or "default" names are the first."""
        display = self.default_display or next(iter(self.displays), "") if display in ("", "default") else display
        if display not in self.displays:
            raise ValueError(f"unknown display {display!r}")
        views = self.displays[display]
        view = next(iter(views)) if view in ("", "default") else view
        if view not in views:
            raise ValueError(f"unknown view {view!r} of {display!r}")
        chosen = views[view].looks if not looks else looks
        steps = self.through_looks(chosen, source, views[view].space)
        return list(reversed([s.inverse() for s in steps])) if inverse else steps

    def by_name(self, name: str, inverse: bool = False) -> list[Step]:
        if name not in self.named:
            raise ValueError(f"unknown transform {name!r}")
        return list(reversed([s.inverse() for s in self.named[name]])) if inverse else list(self.named[name])

    def inventory(self) -> list[tuple[str, str, str]]:
        """(kind, name, of) of all that is known."""
        rows = [("space", n, "") for n in self.spaces] + [("role", n, s) for n, s in self.roles.items()] + [("alias", n, s) for n, s in self.aliases.items()]
        rows += [("look", n, look.space) for n, look in self.looks.items()] + [("display", n, "") for n in self.displays]
        rows += [("view", v, d) for d, views in self.displays.items() for v in views]
        return rows + [("named transform", n, "") for n in self.named]


def default_config() -> Config:
    """The library's own spaces around XYZ, with a display for each display-referred one."""
    spaces: dict[str, tuple[Step, ...]] = {}
    for name, (to, back, primaries) in color.SPACES.items():
        curve = (Curve(name, to, back),) if to is not back else ()
        spaces[name] = (*curve, _matrix(color.to_xyz(primaries)))
    spaces["xyz"] = ()
    shown = {"sRGB": "srgb", "Rec.709": "rec709", "P3": "srgb_p3d65"}
    displays = {d: {"Standard": View(s), "Raw": View("lin_rec709")} for d, s in shown.items()}
    roles = {"scene_linear": "lin_rec709", "rendering": "acescg", "color_picking": "srgb", "aces_interchange": "aces2065_1"}
    aliases = {k: v for k, v in color.ALIASES.items() if k not in roles}
    return Config(spaces, roles, aliases, {}, displays, {}, "sRGB")


def folded(steps: Sequence[Step]) -> list[Step]:
    """Without matrices beside each other, matrices that change nothing, and curves beside their inverses."""
    out: list[Step] = []
    for s in steps:
        out.append(s)
        while out:
            if isinstance(out[-1], Matrix) and out[-1].same:
                out.pop()
            elif len(out) > 1 and isinstance(out[-1], Matrix) and isinstance(out[-2], Matrix):
                out[-2:] = [out[-1].after(out[-2])]
            elif len(out) > 1 and isinstance(out[-1], Curve) and isinstance(out[-2], Curve) and out[-1].name == out[-2].inverse().name:
                del out[-2:]
            else:
                break
    return out


def apply(a: Image, steps: Sequence[Step], unpremultiply: bool = False, colorspace: str | None = None) -> Image:
    """The first three channels through all steps; alpha and further channels stay, and fewer than three are not changed.

    A pixel without a row counts as black, which a step may change, so all pixels get a row.
    """
    steps = folded(steps)
    attribs = {"colorspace": colorspace} if colorspace else {}
    if a.spec.n < 3 or not steps:
        return replace(a, spec=replace(a.spec, attribs=a.spec.attribs | attribs))
    out = unpremult(a.dense()) if unpremultiply else a.dense()
    names = list(out.spec.names)
    c = out.c[:3]
    for s in steps:
        if isinstance(s, Table3D | Table1D):  # it reads its input many times
            out = out.with_channels(c + out.c[3:], names)
            if isinstance(s, Table3D) and len(s.colors) > LITERAL_CELLS:
                rows = [(i, *v) for i, v in enumerate(s.colors)]
                out = joined_table(out, a.df.sparkSession.createDataFrame(rows, "cell int, v0 double, v1 double, v2 double"), s.size, s.low, s.high)
            else:
                out = out.with_channels(s.apply(out.c[:3]) + out.c[3:], names)
            c = out.c[:3]
        else:
            c = s.apply(c)
    out = out.with_channels(c + out.c[3:], names)
    out = premult(out) if unpremultiply else out
    return replace(out, spec=replace(out.spec, attribs=out.spec.attribs | attribs))


def look(a: Image, looks: str, source: str, target: str, config: Config, inverse: bool = False, unpremultiply: bool = False) -> Image:
    return apply(a, config.through_looks(looks, source, target, inverse), unpremultiply, config.space(target))


def display(a: Image, name: str, view: str, source: str, config: Config, looks: str = "", inverse: bool = False, unpremultiply: bool = False) -> Image:
    steps = config.to_display(name, view, source, looks, inverse)
    name = config.default_display or next(iter(config.displays)) if name in ("", "default") else name
    view = next(iter(config.displays[name])) if view in ("", "default") else view
    return apply(a, steps, unpremultiply, config.space(source) if inverse else config.space(config.displays[name][view].space))


def file_transform(a: Image, text: str, inverse: bool = False, unpremultiply: bool = False) -> Image:
    step = read_cube(text)
    return apply(a, [step.inverse() if inverse else step], unpremultiply)


def named_transform(a: Image, name: str, config: Config, inverse: bool = False, unpremultiply: bool = False) -> Image:
    return apply(a, config.by_name(name, inverse), unpremultiply)
