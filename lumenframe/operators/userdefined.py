"""User functions on pixels and tiles, in Arrow batches; and sources made of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.core import KEYS, Image, Roi, Spec, default_names, joined
from lumenframe.functions.bluenoise import tile
from lumenframe.operators.arithmetic import _made


def _schema(n: int) -> str:
    return "image_id string, z int, y int, x int, " + ", ".join(f"c{i} double" for i in range(n))


def per_pixel(a: Image, f: Callable[..., np.ndarray], b: Image | None = None, n: int | None = None) -> Image:
    """f(rows x channels of a[, those of b]) -> rows x n, a batch of pixels at a time; absent pixels of either image are zero."""
    n, m, k = n or a.spec.n, a.spec.n, b.spec.n if b else 0
    if b is not None:
        df, x, y, spec = joined(a, b)
        df = df.select(*KEYS, *[c.alias(f"a{i}") for i, c in enumerate(x)], *[c.alias(f"b{i}") for i, c in enumerate(y)])
    else:
        df, spec = a.df.select(*KEYS, *[c.alias(f"a{i}") for i, c in enumerate(a.c)]), a.spec

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inputs = [batch[[f"{s}{i}" for i in range(w)]].to_numpy() for s, w in (("a", m), ("b", k)) if w]
            out = batch[KEYS].copy()
            for i, v in enumerate(np.asarray(f(*inputs)).reshape(len(batch), n).T):
                out[f"c{i}"] = v.astype(float)
            yield out

    names = spec.names if n == spec.n else tuple(default_names(n))
    return Image(df.mapInPandas(run, _schema(n)), replace(spec, names=names))


def per_tile(a: Image, f: Callable[[np.ndarray, Roi], np.ndarray], size: int = 64) -> Image:
    """f(height x width x channels, the tile's window) for each tile of each image, of the same shape."""
    n, d = a.spec.n, a.spec.data
    keyed = a.dense().df.withColumns({"ty": F.floor((F.col("y") - d.y0) / size), "tx": F.floor((F.col("x") - d.x0) / size)})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        roi = Roi(int(rows["x"].min()), int(rows["x"].max()) + 1, int(rows["y"].min()), int(rows["y"].max()) + 1)
        full = np.zeros((roi.height, roi.width, n))
        full[rows["y"] - roi.y0, rows["x"] - roi.x0] = rows[[f"c{i}" for i in range(n)]].to_numpy()
        got = f(full, roi)
        out = rows[KEYS].copy()
        for i in range(n):
            out[f"c{i}"] = got[rows["y"] - roi.y0, rows["x"] - roi.x0, i]
        return out

    return Image(keyed.groupBy("image_id", "z", "ty", "tx").applyInPandas(run, _schema(n)), a.spec)


def bluenoise_image(spark: SparkSession, n: int = 32) -> Image:
    """A four-channel blue-noise tile that repeats without a seam."""
    v = [tile(n, seed) for seed in range(4)]
    rows = [("0", 0, y, x, *[float(t[y, x]) for t in v]) for y in range(n) for x in range(n)]
    roi = Roi(0, n, 0, n)
    return Image(spark.createDataFrame(rows, _schema(4)), Spec(roi, roi, tuple("RGBA")))


def blue_noise(a: Image, low: float = 0.0, high: float = 1.0, n: int = 32) -> Image:
    """Adds blue noise between low and high, the same at (x, y) modulo n."""
    tiles = bluenoise_image(a.df.sparkSession, n).df.select(F.col("y").alias("ny"), F.col("x").alias("nx"), *[F.col(f"c{i}").alias(f"n{i}") for i in range(4)])
    df = a.df.withColumns({"ny": F.pmod("y", F.lit(n)), "nx": F.pmod("x", F.lit(n))}).join(F.broadcast(tiles), ["ny", "nx"])
    return _made(df, [c + low + F.col(f"n{i % 4}") * (high - low) for i, c in enumerate(a.c)], a.spec)
