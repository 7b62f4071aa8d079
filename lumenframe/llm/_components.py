"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._spark import saved


def _least(edges: DataFrame) -> DataFrame:
    """u, v and m: the least of u's neighbours and itself.  An aggregation and a join, so that a hub's edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both(row: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """Two edges u, v of each row, named by its columns.  A union would work out the rows twice."""
    pair = [F.struct(*[F.col(c).alias(name) for name, c in edge.items()]) for edge in (first, second)]
    return row.select(F.explode(F.array(*pair)).alias("edge")).select("edge.u", "edge.v")


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node hangs on two others, or on one that hangs on another itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.hangs").alias("over"), F.min("end.hangs").alias("alone"))
    return bool(nodes.agg(F.max((F.col("over") > 1) | ((F.col("over") > 0) & (F.col("alone") == 0)))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes in the undirected edges u, v.

    Each round ends with edges to smaller nodes; once they are stars, these are the
    components, and no round is spent on finding that nothing changes.
    """
    edges = saved(edges.filter("u != v").select("u", "v").distinct())
    while True:
        large = _least(_both(edges, {"u": "u", "v": "v"}, {"u": "v", "v": "u"})).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
        edges = saved(_both(_least(down), {"u": "v", "v": "m"}, {"u": "u", "v": "m"}).filter("u != v").distinct())
        if not _unfinished(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
