"""Thin wrappers around Spark's Arrow functions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import shared_dir, ship

#: Bytes of text in one chunk of documents that a single Python call takes.
CHUNK_BYTES = 12 << 20


#: Rows of one Arrow batch: texts are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1000


def trim() -> None:
    """Give free memory back: workers live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _trimmed(function: Callable) -> Callable:
    """function of one or two tables, optionally after the key, that gives memory back when it is done."""

    def run(*tables):
        out = function(*tables)
        trim()
        return out

    return {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[function.__code__.co_argcount]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":  # Spark's default, so nobody has chosen it
        df.sparkSession.conf.set(name, str(BATCH_ROWS))

    def run(batches):
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """function(key, table) of each group."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(_trimmed(function), schema)


def cogroup_arrow(a: DataFrame, b: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """function(table of a, table of b) of each key."""
    ship(a.sparkSession)
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(_trimmed(function), schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage, at which Spark drops the shuffles and broadcasts of queries that are done, and give freed native memory back.

    The driver plans many queries one after the other.  Its heap grows before it
    collects, and the C library keeps what each of its threads has freed.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # By the interface's method, as the server's own class is closed to reflection.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM or C library that can't
        pass


def saved(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    settle(df.sparkSession)
    return out


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text and chunk, and the number of chunks: it follows the bytes of all texts.

    A chunk is a function of doc_id and text, so that a lost task gives the same
    again and the rows of one doc_id lie in many chunks; only rows that are equal
    in both share one.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // chunk_bytes) + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(n)).cast("int").alias("chunk"),
    ), n


def remove(spark, folder: str) -> None:
    """Delete a folder of the shared store; one that is not there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
