"""Colour transforms over embeddings: an image of one line for each vector, of three neighbouring components a pixel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, image
from lumenframe.operators import color
from lumenframe.operators import transforms as T

GRADE = T.Grade((1.1, 1.0, 0.8), (0.01, 0.0, -0.02), (1.2, 1.0, 0.9), 0.8)
SIZE = 9


def lines(spark: SparkSession, sf: str) -> Image:
    """All components of all vectors: pixel x of a vector has the components x, x + 1 and x + 2, as (1 + v) / 2."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    at = lambda k: F.get("embedding", (F.col("x") + k) % 64).cast("double") / 2 + 0.5
    rows = df.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return replace(image(rows.select("image_id", "y", "x", *[at(k).alias(f"c{k}") for k in range(3)]), Roi(0, 64, 0, 1), list("RGB")), whole=True)


_LINES = (
    "v as (select cast(vec_id as varchar) as image_id, embedding as e, unnest(range(0, 64)) as x from embeddings), "
    "p as (select image_id, 0 as y, cast(x as int) as x, " + ", ".join(f"e[(x + {k}) % 64 + 1]::double / 2 + 0.5 as c{k}" for k in range(3)) + " from v)"
)


def config() -> T.Config:
    c = T.default_config()
    looks = {"warm": T.Look("acescg", (GRADE,)), "lift": T.Look("lin_rec709", (T.Matrix(((0.9, 0.0, 0.05), (0.0, 1.0, 0.0), (0.1, 0.0, 0.9)), (0.01, 0.02, 0.0)),))}
    displays = {"Screen": {"Film": T.View("srgb", ("warm",)), "Wide": T.View("lin_rec2020", ("warm", "lift"))}}
    return replace(c, looks=looks, displays=displays, named={"square": (T.Curve("square", lambda v: v * v, F.sqrt),)}, default_display="Screen")


def bent(r: float, g: float, b: float) -> tuple[float, float, float]:
    return r * r * (1 - 0.2 * g), 0.5 * g + 0.3 * b * b, b * (1 - 0.5 * r)


def cube() -> str:
    axis = [k / (SIZE - 1) for k in range(SIZE)]
    return f"LUT_3D_SIZE {SIZE}\n" + "\n".join(" ".join(map(repr, bent(r, g, b))) for b in axis for g in axis for r in axis)


def _shown(a: Image) -> DataFrame:
    return a.df.select("image_id", "y", "x", *[(F.round(F.col(f"c{i}") + 1e-9, 5) + 0.0).alias(f"c{i}") for i in range(3)])


def _look(s: SparkSession, d: str) -> DataFrame:
    return _shown(T.look(lines(s, d), "warm,lift", "scene_linear", "color_picking", config()))


def _look_inverse(s: SparkSession, d: str) -> DataFrame:
    return _shown(T.look(lines(s, d), "lift", "srgb", "linear", config(), inverse=True))


def _display(s: SparkSession, d: str) -> DataFrame:
    return _shown(T.display(lines(s, d), "default", "Wide", "ACEScg", config()))


def _named(s: SparkSession, d: str) -> DataFrame:
    return _shown(T.named_transform(lines(s, d), "square", config(), inverse=True))


def _file(s: SparkSession, d: str) -> DataFrame:
    return _shown(T.file_transform(lines(s, d), cube()))


def _joined(s: SparkSession, d: str) -> DataFrame:
    """The lattice as a table that Spark makes: the general way for lattices that no plan can hold."""
    k = F.col("id")
    axis = [(k % SIZE) / (SIZE - 1), (k / SIZE).cast("long") % SIZE / (SIZE - 1), (k / SIZE**2).cast("long") / (SIZE - 1)]
    lattice = s.range(SIZE**3).select(k.cast("int").alias("cell"), *[v.alias(f"v{i}") for i, v in enumerate(bent(*axis))])
    return _shown(T.joined_table(lines(s, d), lattice, SIZE))


def _file_1d(s: SparkSession, d: str) -> DataFrame:
    text = "LUT_1D_SIZE 6\n" + "\n".join(f"{(k / 5) ** 2!r} {k / 10 + 0.2!r} {(k / 5) ** 3 + k / 50!r}" for k in range(6))
    return _shown(T.file_transform(lines(s, d), text, inverse=True))


def _linear(v: str) -> str:
    return f"case when {v} <= 0.04045 then {v} / 12.92 else pow(({v} + 0.055) / 1.055, 2.4) end"


def _srgb(v: str) -> str:
    return f"case when {v} <= 0.0031308 then {v} * 12.92 else 1.055 * pow(greatest({v}, 0), 1 / 2.4::double) - 0.055 end"


def _times(m: np.ndarray, offset=(0, 0, 0)) -> list[str]:
    return [" + ".join(f"{float(w)!r} * c{i}" for i, w in enumerate(row)) + f" + {float(o)!r}" for row, o in zip(m, offset, strict=True)]


def _steps(*steps: list[str] | Callable[[str], str]) -> str:
    """Nested selects, one for each step."""
    sql = "p"
    for s in steps:
        values = s if isinstance(s, list) else [s(f"c{i}") for i in range(3)]
        sql = f"(select image_id, y, x, {', '.join(f'{v} as c{i}' for i, v in enumerate(values))} from {sql})"
    return f"with {_LINES} select image_id, y, x, {', '.join(f'round(c{i} + 1e-9, 5) + 0.0 as c{i}' for i in range(3))} from {sql}"


def _between(a: str, b: str) -> np.ndarray:
    return np.linalg.inv(color.to_xyz(b)) @ color.to_xyz(a)


_GRADE = [[f"pow(least(greatest(c{i} * {s} + {o}, 0), 1), {p}::double)" for i, (s, o, p) in enumerate(zip(GRADE.slope, GRADE.offset, GRADE.power, strict=True))], [f"0.2126 * c0 + 0.7152 * c1 + 0.0722 * c2 + (c{i} - (0.2126 * c0 + 0.7152 * c1 + 0.0722 * c2)) * 0.8" for i in range(3)]]
_LIFT = np.array([[0.9, 0, 0.05], [0, 1, 0], [0.1, 0, 0.9]])
_NODE = ("{r} * {r} * (1 - 0.2 * {g})", "0.5 * {g} + 0.3 * {b} * {b}", "{b} * (1 - 0.5 * {r})")


def _tetrahedra() -> str:
    """Six cases by the order of the fractions, as the lattice's formula at their corners."""
    n = SIZE - 1
    cell = ", ".join(f"least(floor(least(greatest(c{i}, 0), 1) * {n}), {n - 1}) as i{i}" for i in range(3))
    out = []
    for node in _NODE:
        at = lambda s, node=node: node.format(**{c: f"((i{k} + {s[k]}) / {n}::double)" for k, c in enumerate("rgb")})
        cases = []
        for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
            step, terms, last = [0, 0, 0], [], "1"
            for k in order:
                terms.append(f"({last} - f{k}) * ({at(step)})")
                last = f"f{k}"
                step[k] = 1
            terms.append(f"{last} * ({at(step)})")
            cases.append(f"when f{order[0]} >= f{order[1]} and f{order[1]} >= f{order[2]} then {' + '.join(terms)}")
        out.append(f"case {' '.join(cases)} end")
    fractions = ", ".join(f"least(greatest(c{i}, 0), 1) * {n} - i{i} as f{i}" for i in range(3))
    values = ", ".join(f"round({v} + 1e-9, 5) + 0.0 as c{i}" for i, v in enumerate(out))
    return f"with {_LINES}, cells as (select *, {cell} from p), parts as (select *, {fractions} from cells) select image_id, y, x, {values} from parts"


def _inverse_1d() -> str:
    rows = [[(k / 5) ** 2 for k in range(6)], [k / 10 + 0.2 for k in range(6)], [(k / 5) ** 3 + k / 50 for k in range(6)]]
    values = []
    for i, row in enumerate(rows):
        cases = " ".join(f"when c{i} <= {b!r} then {k / 5!r} + 0.2 * (c{i} - {a!r}) / {b - a!r}" for k, (a, b) in enumerate(zip(row, row[1:], strict=False)))
        values.append(f"case when c{i} <= {row[0]!r} then 0 {cases} else 1 end")
    return _steps(values)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ociolook": _look, "ociolook_inverse": _look_inverse, "ociodisplay": _display, "ocionamedtransform": _named, "ociofiletransform": _file, "ociofiletransform_joined": _joined, "ociofiletransform_1d": _file_1d,
}
SQL: dict[str, str] = {
    "ociolook": _steps(_times(_between("rec709", "acescg")), *_GRADE, _times(_between("acescg", "rec709")), _times(_LIFT, (0.01, 0.02, 0)), _srgb),
    "ociolook_inverse": _steps(_linear, _times(np.linalg.inv(_LIFT), -np.linalg.inv(_LIFT) @ np.array([0.01, 0.02, 0]))),
    "ociodisplay": _steps(*_GRADE, _times(_between("acescg", "rec709")), _times(_LIFT, (0.01, 0.02, 0)), _times(_between("rec709", "rec2020"))),
    "ocionamedtransform": _steps(lambda c: f"sqrt({c})"),
    "ociofiletransform": _tetrahedra(),
    "ociofiletransform_joined": _tetrahedra(),
    "ociofiletransform_1d": _inverse_1d(),
}
