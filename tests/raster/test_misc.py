import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import session
from lumenframe.core import Roi, image
from lumenframe.operators import statistics as S
from lumenframe.streaming import windows as W


def test_hash_of_pixel_bytes(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(-1, 1, (150, 5, 2)).astype("<f4")
    v[64:128] = 0  # a block without a row
    rows = [("a", y, x, float(v[y, x, 0]), float(v[y, x, 1])) for y in range(150) for x in range(5) if v[y, x].any()]
    a = image(spark.createDataFrame([*rows, ("b", 0, 0, 1e-7, 0.0)], "image_id string, y int, x int, c0 double, c1 double"), Roi(0, 5, 0, 150), ["R", "G"])
    got = {r["image_id"]: r["sha1"] for r in S.pixel_hash(a).collect()}
    blocks = "".join(hashlib.sha1(v[y : y + 64].tobytes()).hexdigest() for y in (0, 64, 128))
    assert got["a"] == hashlib.sha1(blocks.encode()).hexdigest()
    changed = a.with_channels([a.c[0] + F.when(F.col("image_id") == "b", 1e-7).otherwise(0.0), a.c[1]])
    again = {r["image_id"]: r["sha1"] for r in S.pixel_hash(changed).collect()}
    assert again["a"] == got["a"] and again["b"] != got["b"]


def test_late_rows(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    hour = lambda h: start + datetime.timedelta(hours=h)
    for k, hours in enumerate(([0, 1, 1], [9, 10], [10], [11, 1])):  # the last row comes long after its window has closed
        spark.createDataFrame([(hour(h), "k", 1.0) for h in hours], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        file = next((tmp_path / f"part{k}").glob("*.parquet"))
        file.rename(tmp_path / f"events{k}.parquet")
    out = W.run_available(spark, str(tmp_path), "events*.parquet", files=1)
    got = sorted((int((r["begin"] - start).total_seconds() // 3600), r["n"]) for r in out.collect())
    assert got == [(0, 1), (1, 2), (9, 1), (10, 2), (11, 1)]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
