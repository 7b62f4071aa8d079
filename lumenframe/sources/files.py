"""Image files as DataFrames: Spark lists and reads the files, workers decode them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, Spec, default_names
from lumenframe.session import ship
from lumenframe.sources import codecs

HEADERS = "filename string, width int, height int, channels int, error string"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file; error says why one can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    h, w, n = codecs.decode(bytes(content), name).shape
                    rows.append((name, w, h, n, None))
                except Exception as e:  # a malformed file is a row, not the end of the job
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "width", "height", "channels", "error"])

    return _contents(spark, path).mapInPandas(run, HEADERS)


def read(spark: SparkSession, path: str) -> Image:
    """All decodable files of the path, padded to the largest window and channel count; image_id is the file's path."""
    w, h, n = headers(spark, path).filter("error is null").agg(F.max("width"), F.max("height"), F.max("channels")).first()
    if not w:
        raise FileNotFoundError(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    v = codecs.decode(bytes(content), name)
                except Exception:  # headers() reports it
                    continue
                y, x = np.mgrid[0 : v.shape[0], 0 : v.shape[1]]
                out = pd.DataFrame({"image_id": name, "z": 0, "y": y.ravel(), "x": x.ravel()})
                for i in range(n):
                    out[f"c{i}"] = v[:, :, i].ravel().astype(float) if i < v.shape[2] else 0.0
                yield out

    df = _contents(spark, path).mapInPandas(run, "image_id string, z int, y int, x int, " + ", ".join(f"c{i} double" for i in range(n)))
    roi = Roi(0, w, 0, h)
    return Image(df, Spec(roi, roi, tuple(default_names(n))))


def encoded(a: Image, fmt: str) -> DataFrame:
    """image_id and content: each image as a file of this format."""
    ship(a.df.sparkSession)
    d, n, name = a.spec.data, a.spec.n, fmt

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((d.height, d.width, n))
        full[rows["y"] - d.y0, rows["x"] - d.x0] = rows[[f"c{i}" for i in range(n)]].to_numpy()
        return pd.DataFrame({"image_id": [key[0]], "content": [codecs.by_name(name).encode(full)]})

    return a.df.groupBy("image_id").applyInPandas(run, "image_id string, content binary")
