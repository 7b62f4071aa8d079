"""Images as DataFrames: one row for each pixel, one column for each channel.

The columns are image_id, z, y, x and c0, c1, ...; several images of one shape
share a table.  A pixel of the data window without a row is zero.  Channels are
columns of their own, so that Parquet scans read only those in use and pixel
math stays in generated code.  Windows and channel names are plan-time values.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["image_id", "z", "y", "x"]
#: A driver-made table of more rows than this is joined without a broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Roi:
    """Half-open box of pixels."""

    x0: int
    x1: int
    y0: int
    y1: int
    z0: int = 0
    z1: int = 1

    @property
    def width(self) -> int:
        return self.x1 - self.x0

    @property
    def height(self) -> int:
        return self.y1 - self.y0

    @property
    def depth(self) -> int:
        return self.z1 - self.z0

    @property
    def empty(self) -> bool:
        return min(self.width, self.height, self.depth) <= 0

    @property
    def pixels(self) -> int:
        return 0 if self.empty else self.width * self.height * self.depth

    def union(self, o: Roi) -> Roi:
        return Roi(min(self.x0, o.x0), max(self.x1, o.x1), min(self.y0, o.y0), max(self.y1, o.y1), min(self.z0, o.z0), max(self.z1, o.z1))

    def intersection(self, o: Roi) -> Roi:
        return Roi(max(self.x0, o.x0), min(self.x1, o.x1), max(self.y0, o.y0), min(self.y1, o.y1), max(self.z0, o.z0), min(self.z1, o.z1))

    def shifted(self, dx: int, dy: int, dz: int = 0) -> Roi:
        return Roi(self.x0 + dx, self.x1 + dx, self.y0 + dy, self.y1 + dy, self.z0 + dz, self.z1 + dz)

    def has(self) -> Column:
        return F.col("x").between(self.x0, self.x1 - 1) & F.col("y").between(self.y0, self.y1 - 1) & F.col("z").between(self.z0, self.z1 - 1)


def default_names(n: int) -> list[str]:
    """R, G, B, A, then channel4 and so on; a single channel is Y."""
    return ["Y"] if n == 1 else [*"RGBA", *(f"channel{i}" for i in range(4, n))][:n]


@dataclass(frozen=True)
class Spec:
    """data and display windows, channel names, and attributes of all images in a table."""

    data: Roi
    full: Roi
    names: tuple[str, ...]
    attribs: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.names)

    @property
    def alpha(self) -> int:
        return next((i for i, c in enumerate(self.names) if c.split(".")[-1] in ("A", "Alpha", "alpha")), -1)

    @property
    def zchannel(self) -> int:
        return next((i for i, c in enumerate(self.names) if c.split(".")[-1] in ("Z", "depth", "Depth")), -1)


def every(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions)


def some(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions)


def total(values: list[Column]) -> Column:
    return reduce(operator.add, values)


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def per_channel(values, n: int) -> list[float]:
    """n values, of which the last is repeated if there are fewer."""
    values = [float(v) for v in (values if isinstance(values, list | tuple) else [values])]
    return (values + values[-1:] * n)[:n] if values else [0.0] * n


@dataclass(frozen=True)
class Image:
    """whole says that every pixel of the data window has a row; it is only set where that is sure."""

    df: DataFrame
    spec: Spec
    whole: bool = False

    @property
    def c(self) -> list[Column]:
        return [F.col(f"c{i}") for i in range(self.spec.n)]

    def with_channels(self, values: list[Column], names: list[str] | None = None) -> Image:
        names = tuple(names or self.spec.names[: len(values)])
        cols = [F.col(k) for k in KEYS] + [v.cast("double").alias(f"c{i}") for i, v in enumerate(values)]
        return Image(self.df.select(*cols), replace(self.spec, names=names), self.whole)

    def shown(self, zero_stays: bool) -> Image:
        """The image itself, if an operator makes zero of zero; else with all its pixels, as those without a row change as well."""
        return self if zero_stays else self.dense()

    def within(self, roi: Roi | None, values: list[Column]) -> Image:
        """The values inside roi (all, if None), the present ones elsewhere."""
        if roi is None:
            return self.with_channels(values)
        return self.with_channels([F.when(roi.has(), v).otherwise(c) for v, c in zip(values, self.c, strict=True)])

    def moved(self, x: Column, y: Column, data: Roi, full: Roi | None = None, z: Column | None = None) -> Image:
        df = self.df.select("image_id", (F.col("z") if z is None else z).cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), *self.c)
        return Image(df, replace(self.spec, data=data, full=full or self.spec.full))

    def dense(self, images: DataFrame | None = None) -> Image:
        """With a row for each pixel of the data window of each image; images names those that may have no row, by image_id."""
        if self.whole:
            return self
        d = self.spec.data
        if d.empty:
            return Image(self.df.limit(0), self.spec, True)
        grid = (self.df if images is None else images).select("image_id").distinct()
        for axis, lo, hi in (("z", d.z0, d.z1), ("y", d.y0, d.y1), ("x", d.x0, d.x1)):
            grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
        df = grid.join(self.df, KEYS, "left").select(*KEYS, *[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(self.c)])
        return Image(df, self.spec, True)


def _lattice(spark: SparkSession, roi: Roi) -> DataFrame:
    if roi.empty:
        return spark.createDataFrame([], "z int, y int, x int")
    n = roi.width * roi.height
    return spark.range(roi.pixels).select(
        (F.expr(f"id div {n}") + roi.z0).cast("int").alias("z"), (F.expr(f"(id % {n}) div {roi.width}") + roi.y0).cast("int").alias("y"), (F.col("id") % roi.width + roi.x0).cast("int").alias("x")
    )


def grid(spark: SparkSession, roi: Roi, values: list[Column], names: list[str] | None = None, full: Roi | None = None, image_id: str = "0") -> Image:
    """A dense image whose channels are expressions of z, y and x."""
    df = _lattice(spark, roi).select(F.lit(image_id).alias("image_id"), "z", "y", "x", *[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)])
    return Image(df, Spec(roi, full or roi, tuple(names or default_names(len(values)))), True)


def image(df: DataFrame, data: Roi, names: list[str], full: Roi | None = None) -> Image:
    """A table that has image_id, y, x and c0, ... (and z, else 0)."""
    z = F.col("z").cast("int") if "z" in df.columns else F.lit(0)
    cols = [F.col("image_id").cast("string").alias("image_id"), z.alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")]
    return Image(df.select(*cols, *[F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(len(names))]), Spec(data, full or data, tuple(names)))


def joined(a: Image, b: Image) -> tuple[DataFrame, list[Column], list[Column], Spec]:
    """All pixels of both; the channels of each side, 0 where it has none."""
    right = b.df.select(*KEYS, *[c.alias(f"b{i}") for i, c in enumerate(b.c)])
    df = a.df.join(right, KEYS, "full_outer")
    zero = F.lit(0.0)
    spec = replace(a.spec, data=a.spec.data.union(b.spec.data), full=a.spec.full.union(b.spec.full))
    return df, [F.coalesce(c, zero) for c in a.c], [F.coalesce(F.col(f"b{i}"), zero) for i in range(b.spec.n)], spec


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table, with a broadcast hint only if it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
