"""Token ids of all documents in flat binary files, in ascending order of doc_id.

A folder holds, for each part (a range of doc_ids):

    part-00000.ids      the ids of its documents one after the other, little-endian,
                        two bytes each if the vocabulary allows it, else four
    part-00000.offsets  little-endian unsigned 64-bit: for each document the number
                        of ids of all documents before it, in all parts; then the end
    part-00000.docs     little-endian signed 64-bit doc_ids

and ``manifest``, a Parquet table with a row for each part: part, base (ids before
it), docs, tokens, nulls (its last documents, whose doc_id is null), width.

Texts are range-partitioned and encoded once; a task writes its part's ids under a
name of its own and renames the file, so that a lost or repeated task leaves the
same file.  What it gives back is the size of each document; the base of each part
is a prefix sum over the parts' totals, after which the offsets are written.
Readers map the files into memory, so a window of ids costs the pages it touches.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._spark import group_arrow, map_arrow, saved, trim
from lumenframe.llm.packing import STEP, worker_encoder

#: Follows the ids of every document.
END_ID = 1
CHUNKS = "part int, chunk int, docs long, tokens long, nulls long, width int, sizes binary"
MANIFEST = "part int, base long, docs long, tokens long, nulls long, width int"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Documents of one Arrow batch that is read back.
READ_ROWS = 10_000


def _place(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:05d}.{kind}"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Output:
    """A file that has its name only when it is complete."""

    def __init__(self, path: str):
        self.system, self.path = _file_system(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.system.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.path)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where its folder is mounted, else read."""
    system, place = _file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(place, "rb") as file:
            try:
                return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype)
            except ValueError:  # an empty file can't be mapped
                return np.zeros(0, dtype)
    with system.open_input_file(place) as file:
        return np.frombuffer(file.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts of docs to folder, and return the manifest.

    A null or empty text is its end id alone.  Rows without doc_id come last.
    Rows that share a doc_id are documents of their own, ordered by a hash of
    their texts; equal rows are all written.  Of docs only doc_id and text are
    read.  An empty table gives an empty manifest and no other files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, outputs = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            if batch.num_rows and not outputs:
                encoder = worker_encoder(tokenizer)
                width = 2 if max(len(encoder.last) - 2, end_id) < 1 << 16 else 4
                outputs = [_Output(_place(folder, part, kind)) for kind in ("ids", "docs")]
            ids = batch.column(0)
            data, offsets = _text.utf8(batch.column(1))
            for i, j in _text.steps(offsets, STEP):
                every, at = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                every[at[1:] - 1] = end_id
                outputs[0].write(every.astype(f"<u{width}").tobytes())
                outputs[1].write(ids[i:j].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                row = [part, chunk, j - i, len(every), ids[i:j].null_count, width, np.diff(at).astype("<u8").tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(chunk_schema.names, row, strict=True))], chunk_schema)
                chunk += 1
            trim()  # the sort beside this worker needs the memory
        for output in outputs:
            output.close()

    chunk_schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("nulls", pa.int64()), ("width", pa.int32()), ("sizes", pa.binary())])
    order = [F.col("doc_id").asc_nulls_last(), "digest", "copy"]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("copy"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    chunks = saved(map_arrow(ranged, encode, CHUNKS))
    parts = chunks.groupBy("part").agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "nulls")), F.max("width").alias("width"))
    # A row for each part, not for each document: the window's one task has as many rows as there are partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def offsets_of(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        base = table.column("base")[0].as_py()
        sizes = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("sizes").to_pylist()])
        output = _Output(_place(folder, key[0].as_py(), "offsets"))
        output.write((np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64) + np.uint64(base)).astype("<u8").tobytes())
        output.close()
        return table.slice(0, 1).select(["part", "base", "all_docs", "all_tokens", "all_nulls", "width"]).rename_columns(["part", "base", "docs", "tokens", "nulls", "width"])

    totals = bases.select("part", "base", *(F.col(c).alias(f"all_{c}") for c in ("docs", "tokens", "nulls")))
    placed = chunks.select("part", "chunk", "sizes", "width").join(totals, "part")
    group_arrow(placed, ["part"], offsets_of, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each document, as the files have them.

    A task maps the files of a few parts and goes through their documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, starts, names = (mapped(_place(folder, r["part"], kind), dtype) for kind, dtype in (("ids", f"<u{r['width']}"), ("offsets", "<u8"), ("docs", "<i8")))
                at = (starts - np.uint64(r["base"])).astype(np.int64)
                for i in range(0, r["docs"], READ_ROWS):
                    j = min(i + READ_ROWS, r["docs"])
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                    unnamed = np.arange(i, j) >= r["docs"] - r["nulls"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i:j], mask=unnamed), pa.array(starts[i:j].astype(np.int64)), pa.array(np.diff(at[i : j + 1])), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = max(1, manifest.count())
    return map_arrow(manifest.repartitionByRange(parts, "part"), read, DOCUMENTS)


class TokenFiles:
    """Random access for a trainer: document(i) and window(start, n) over all parts, whose files are mapped when they are first needed."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        if not urlparse(folder).scheme:
            folder = f"file://{folder}"
        system, place = _file_system(folder)
        rows = sorted(pq.read_table(f"{place}/manifest", filesystem=system).to_pylist(), key=lambda r: r["part"])
        self.folder, self.rows, self.arrays = folder, rows, {}
        self.bases = np.array([r["base"] for r in rows], np.int64)
        self.docs = np.cumsum([0, *(r["docs"] for r in rows)])
        self.tokens = sum(r["tokens"] for r in rows)

    def _array(self, k: int, kind: str) -> np.ndarray:
        if (k, kind) not in self.arrays:
            dtype = {"ids": f"<u{self.rows[k]['width']}", "offsets": "<u8", "docs": "<i8"}[kind]
            self.arrays[k, kind] = mapped(_place(self.folder, self.rows[k]["part"], kind), dtype)
        return self.arrays[k, kind]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document in order of doc_id."""
        if not 0 <= i < self.docs[-1]:
            raise IndexError(i)
        k = int(np.searchsorted(self.docs, i, "right")) - 1
        at = (self._array(k, "offsets")[i - self.docs[k] : i - self.docs[k] + 2] - np.uint64(self.bases[k])).astype(np.int64)
        return self._array(k, "ids")[at[0] : at[1]]

    def window(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` of all ids on, across documents and parts; fewer at the end."""
        out, k = [], int(np.searchsorted(self.bases, start, "right")) - 1
        while n > 0 and 0 <= k < len(self.rows):
            piece = self._array(k, "ids")[start - self.bases[k] : start - self.bases[k] + n]
            out.append(piece)
            start, n, k = start + len(piece), n - len(piece), k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)
