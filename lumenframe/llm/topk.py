"""Exact top-k inner products by a three-phase uniform threshold.

Candidates are dealt to blocks, and the components of all vectors to `slices`
groups; each (block of candidates, slice) is a node with partial scores.  Only
queries travel to the nodes, a candidate is shuffled to its block once a phase.

1. Each node lists its k best candidates by partial score.  Their whole scores
   give, for each query, a score that k candidates reach for certain.
2. A candidate that reaches it has a partial score of at least its share in some
   slice, whatever the signs: this cutoff goes to the nodes with the query, which
   return all entries that reach the share.
3. Bounds from these entries drop candidates that cannot reach the cutoff; the
   rest is resolved exactly from the vectors.

A task streams its block's candidates, then the queries, batch by batch.  Of
candidates with equal vectors in a block only the k + 1 least vec_ids can be among
the k best of any query, so a vector that very many rows share stays k + 1 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._spark import map_arrow, saved

CANDIDATE_BLOCK, SLICES = 32768, 2
#: Cells of the matrix of partial scores that a step makes.
STEP_CELLS = 2 << 20
LISTED = "q long, vec_id long, score long"
ENTRIES = "q long, block int, c long, slice int, part long"
SCORED = "q long, c long, vec_id long, score long"


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v = floor(256 * x) of each component x, for each row that takes part.

    Rows take no part if vec_id or the vector is null, or if a component is null
    or not finite.  Rows that repeat a vec_id are rows of their own.
    """
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return table.filter(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Block:
    """A block's candidates: rows, vec_ids and vectors, by vec_id and row; of equal vectors the `most` first ones."""

    def __init__(self, rows: list[np.ndarray], ids: list[np.ndarray], vectors: list[np.ndarray], most: int):
        row, vec_id, v = np.concatenate(rows), np.concatenate(ids), np.concatenate(vectors)
        order = np.lexsort((row, vec_id))
        row, vec_id, v = row[order], vec_id[order], np.ascontiguousarray(v[order])
        _, which = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(which, kind="stable")
        first = np.searchsorted(which[by], which[by])
        keep = np.sort(by[np.arange(len(by)) - first < most])
        self.row, self.vec_id, self.v = row[keep], vec_id[keep], v[keep]

    def products(self, q: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
        """For each slice the matrix of partial scores, exact."""
        a, b = q, self.v
        if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
            a, b = a.astype(np.float64), b.astype(np.float64)  # products and sums of such integers are exact
        return [(a[:, i:j] @ b[:, i:j].T).astype(np.int64) for i, j in cuts]


def _nodes(stream: DataFrame, k: int, work: Callable[[int, Block, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work(block number, block, some of its queries) over a stream of (block, kind, row, vec_id, v, ...): candidates have kind 0, queries 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        parts: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
                if i == j:
                    continue
                rows = batch.slice(i, j - i)
                if numbers[i] != number:
                    number, block, parts = int(numbers[i]), None, ([], [], [])
                if kinds[i] == 0:
                    for p, x in zip(parts, (rows.column(2).to_numpy(), rows.column(3).to_numpy(), _matrix(rows.column(4))), strict=True):
                        p.append(x)
                    continue
                if not parts[0]:
                    continue
                block = block or Block(*parts, k + 1)
                step = max(1, STEP_CELLS // len(block.row))
                for at in range(0, rows.num_rows, step):
                    yield work(number, block, pa.Table.from_batches([rows.slice(at, step)]))

    return map_arrow(stream, run, schema)


def _record(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query row with all other rows.

    Ties go to the smaller vec_id; with fewer than k other rows all are returned.
    Rows that repeat a vec_id are queries and candidates of their own, so a row's
    copy is a candidate for it.  Shorter vectors count as filled up with zeros.
    vectors has vec_id and v, as integer_vectors() gives them; other columns are
    not read.
    """
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    dims = max(dims, slices)
    ends = np.linspace(0, dims, slices + 1).astype(int).tolist()
    cuts = list(zip(ends[:-1], ends[1:], strict=True))
    blocks = n // CANDIDATE_BLOCK + 1
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    rows = saved(
        vectors.select("vec_id", padded.alias("v"))
        .withColumns({"row": F.monotonically_increasing_id(), "query": F.coalesce(is_query, F.lit(False))})
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    )
    candidates = rows.select("block", F.lit(0).alias("kind"), "row", "vec_id", "v")
    queries = rows.filter("query").select("row", "vec_id", "v")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def stream(asked: DataFrame) -> DataFrame:
        both = candidates.unionByName(asked, allowMissingColumns=True)
        return both.repartition(blocks, "block").sortWithinPartitions("block", "kind", "row")

    def list_best(number: int, block: Block, asked: pa.Table) -> pa.RecordBatch:
        own = asked.column("row").to_numpy()
        parts = block.products(_matrix(asked.column("v").combine_chunks()), cuts)
        mine = own[:, None] == block.row[None, :]
        listed = np.zeros(mine.shape, bool)
        for p in parts:
            p = np.where(mine, -(2**62), p)
            best = np.argpartition(-p, k - 1, 1)[:, :k] if p.shape[1] > k else np.broadcast_to(np.arange(p.shape[1]), p.shape)
            listed[np.arange(len(own))[:, None], best] = True
        i, j = np.nonzero(listed & ~mine)
        return _record(LISTED, own[i], block.vec_id[j], sum(parts)[i, j])

    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = _nodes(stream(queries.select(everywhere, F.lit(1).alias("kind"), "row", "vec_id", "v")), k, list_best, LISTED)
    reached = saved(listed.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k).groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n")))
    # Fewer than k listed: the query's candidates are fewer in all, and none is cut off.
    cutoff = queries.join(reached, queries["row"] == reached["q"]).select("row", "vec_id", "v", F.when(F.col("n") == k, F.col("low")).alias("cut"))

    def sufficient(number: int, block: Block, asked: pa.Table) -> pa.RecordBatch:
        own, cut = asked.column("row").to_numpy(), asked.column("cut")
        share = -(-cut.fill_null(0).to_numpy() // slices)
        every = cut.is_null().to_numpy(zero_copy_only=False)
        found = []
        for s, p in enumerate(block.products(_matrix(asked.column("v").combine_chunks()), cuts)):
            i, j = np.nonzero(((p >= share[:, None]) | every[:, None]) & (own[:, None] != block.row[None, :]))
            found.append((own[i], block.row[j], np.full(len(i), s), p[i, j]))
        q, c, s, p = (np.concatenate(x) for x in zip(*found, strict=True))
        return _record(ENTRIES, q, np.full(len(q), number), c, s, p)

    entries = _nodes(stream(cutoff.select(everywhere, F.lit(1).alias("kind"), "row", "vec_id", "v", "cut")), k, sufficient, ENTRIES)
    # A slice that did not return the candidate holds less than the share.
    less = (slices - F.col("seen")) * (F.ceil(F.col("cut") / slices).cast("long") - 1)
    open_ = (
        entries.groupBy("q", "block", "c").agg(F.sum("part").alias("part"), F.count("*").alias("seen"))
        .join(reached.select("q", F.when(F.col("n") == k, F.col("low")).alias("cut")), "q")
        .filter(F.col("cut").isNull() | (F.col("part") + less >= F.col("cut")))
        .groupBy("q", "block").agg(F.collect_list("c").alias("rows"))
    )

    def resolve(number: int, block: Block, asked: pa.Table) -> pa.RecordBatch:
        order = np.argsort(block.row)
        out = []
        for own, q, rows in zip(asked.column("row").to_pylist(), _matrix(asked.column("v").combine_chunks()), asked.column("rows").to_pylist(), strict=True):
            at = order[np.searchsorted(block.row, np.array(rows), sorter=order)]
            score = (block.v[at] * q).sum(1)
            best = np.lexsort((block.vec_id[at], -score))[:k]
            out.append((np.full(len(best), own), block.row[at[best]], block.vec_id[at[best]], score[best]))
        return _record(SCORED, *(np.concatenate(x) for x in zip(*out, strict=True)))

    asked = open_.join(queries, open_["q"] == queries["row"]).select("block", F.lit(1).alias("kind"), "row", "vec_id", "v", "rows")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "c")
    return (
        _nodes(stream(asked), k, resolve, SCORED)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id")), "q")
        .select("query_id", "rank", "vec_id", "score")
    )
