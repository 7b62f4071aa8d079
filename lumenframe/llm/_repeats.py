"""Which windows of `width` units (bytes or words) occur twice in a corpus.

Each window has a minimiser: the n-gram in it whose hash orders first.  Equal
windows have equal minimisers, so windows are compared only within the group of
one minimiser hash.  Consecutive windows of a text with one minimiser are a run.

1. Each chunk of documents sends its distinct minimisers to shards, which return
   those that occur twice anywhere.  A chunk sends each at most once, so that a
   minimiser of very many documents is not a large group.
2. A minimiser with very many runs is hot: a passage that many documents have
   in different surroundings.  Only for these, the hashes of the runs' windows go
   the same way, and runs are cut down to windows whose hash occurs twice; so
   what differs from document to document stays where it is.
3. Each chunk sends its distinct runs of repeated minimisers, as segments of
   text, to blocks by minimiser.  Equal segments of one chunk go once.
4. A solver (it differs by operator) finds the windows of a block's segments that
   occur twice, on their text; the places go back to the chunks.

Hashes only decide where windows meet: equal windows always do, and what meets is
compared as text.  The texts are shuffled once, by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text
from lumenframe.llm._spark import chunked, cogroup_arrow, group_arrow, map_arrow

#: Units that a solver takes at once, at least; a block ends with a minimiser's group.
BLOCK_UNITS = 400_000
#: Runs of one minimiser from which on it is hot.
HOT_RUNS = 4096
SEGMENTS = "g long, chunk int, times int, places binary, segment binary"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Texts of segments and the width; for each, the starts (in units) of its windows that occur elsewhere among all segments.
Solver = Callable[[list[bytes], int], list[np.ndarray]]


@dataclass(frozen=True)
class Unit:
    """How texts become units: width of a window, and units of an n-gram."""

    words: bool
    width: int
    gram: int

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit hash of each unit, len + 1 offsets of the rows; the text with words joined by a blank, and where each unit begins in it."""
        if not self.words:
            return _text._BYTE[data], offsets, data, np.arange(len(data) + 1)
        starts, ends, first = _text.words(data, offsets)
        size = ends - starts + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.minimum(np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size), max(len(data) - 1, 0))
        joined = data[at]
        joined[begin[1:] - 1] = 0x20
        return _text.word_hashes(data, starts, ends), first, joined, begin

    def cut(self, text: np.ndarray, begin: np.ndarray, lo: int, end: int) -> bytes:
        """The text of the units lo to end."""
        return text[begin[lo] : begin[end] - self.words].tobytes()

    def count(self, segment: bytes) -> int:
        return segment.count(b" ") + 1 if self.words else len(segment)


@dataclass
class Runs:
    """row, lo (in units of the row), n windows, minimiser g, whether it is at several places; text(k, a, b) of run k's windows a to b, and hashes(k) of its windows."""

    row: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    g: np.ndarray
    many: np.ndarray
    text: Callable[[int, int, int], bytes]
    hashes: Callable[[int], np.ndarray]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Runs:
    values, first, text, place = unit.units(data, offsets)
    counts = np.maximum(np.diff(first) - unit.width + 1, 0)
    none = np.zeros(0, np.int64)
    if not counts.sum():
        return Runs(none, none, none, none.astype(np.uint64), none.astype(bool), lambda k, a, b: b"", lambda k: none.astype(np.uint64))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _text.powers(_text._P, len(values)), out=sums[1:])
    inverse = _text.powers(_text._IP, len(sums))
    grams = (sums[unit.gram :] - sums[: -unit.gram]) * inverse[: len(sums) - unit.gram]
    order = ((grams * _SPREAD) >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(order, unit.width - unit.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    at = at[start]
    g = grams[at]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[begin[:-1][counts > 0]] = True
    k = np.flatnonzero(new)
    lo, n = start[k], np.diff(np.append(k, len(g)))
    many = at[k] != at[k + n - 1]
    row = np.searchsorted(first, lo, "right") - 1

    def hashes(i: int) -> np.ndarray:
        s = np.arange(lo[i], lo[i] + n[i])
        return _text.mix((sums[s + unit.width] - sums[s]) * inverse[s])

    return Runs(row, lo - first[row], n, _text.mix(g[k]), many, lambda i, a, b: unit.cut(text, place, lo[i] + a, lo[i] + b - 1 + unit.width), hashes)


def _ordered(table: pa.Table) -> pa.Table:
    """The same order of a chunk's rows each time it is read; rows that tie are equal."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _steps(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = _text.utf8(table.column("text"))
    for i, j in _text.steps(offsets):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


KEYS = "chunk int, keys binary, hot binary"


def by_shard(chunk: int, keys: np.ndarray, shards: int) -> pa.Table:
    """A chunk's distinct keys with how often it has them, for each shard."""
    keys, times = np.unique(keys, return_counts=True)
    home = (keys >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(shards + 1))
    parts = [(h, order[ends[h] : ends[h + 1]]) for h in np.flatnonzero(np.diff(ends)).tolist()]
    return pa.table(
        {
            "shard": pa.array([h for h, _ in parts], pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int32()),
            "keys": pa.array([keys[p].tobytes() for _, p in parts], pa.binary()),
            "times": pa.array([np.minimum(times[p], 65535).astype("<u2").tobytes() for _, p in parts], pa.binary()),
        }
    )


def repeated(sent: DataFrame) -> DataFrame:
    """chunk, keys, hot: of what each chunk has sent the keys that occur at more than one place anywhere, and which of them are hot."""
    most = HOT_RUNS

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(which, np.concatenate([np.frombuffer(x, "<u2") for x in table.column("times").to_pylist()]))[which]
        parts = np.split(times, np.cumsum([len(k) for k in keys])[:-1])
        out = [(k[t > 1].tobytes(), np.packbits(t[t > 1] > most).tobytes()) for k, t in zip(keys, parts, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "keys": pa.array([o[0] for o in out], pa.binary()), "hot": pa.array([o[1] for o in out], pa.binary())})

    return group_arrow(sent, ["shard"], judge, KEYS)


SENT = "shard int, chunk int, keys binary, times binary"


def _minimisers(docs: DataFrame, unit: Unit, shards: int) -> DataFrame:
    def send(key: tuple, table: pa.Table) -> pa.Table:
        found = [runs(data, offsets, unit) for _, data, offsets in _steps(_ordered(table))]
        return by_shard(key[0].as_py(), np.concatenate([g for r in found for g in (r.g, r.g[r.many])]), shards)

    return repeated(group_arrow(docs, ["chunk"], send, SENT))


def wanted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's repeated keys in order, and which are hot."""
    keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
    hot = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("hot").to_pylist(), keys, strict=True)]
    every, flags = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*hot, np.zeros(0, bool)])
    order = np.argsort(every)
    return every[order], flags[order]


def among(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    k = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return k, keys[k] == values


def _hot_windows(docs: DataFrame, keys: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """As _minimisers, for the hashes of all windows whose minimiser is hot."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        if left.num_rows and right.num_rows:
            keys, hot = wanted(right)
            keys = keys[hot]
            for _, data, offsets in _steps(_ordered(left)) if len(keys) else ():
                r = runs(data, offsets, unit)
                found += [r.hashes(k) for k in np.flatnonzero(among(keys, r.g)[1]).tolist()]
        return by_shard(left.column("chunk")[0].as_py() if left.num_rows else -1, np.concatenate(found), shards)

    return repeated(cogroup_arrow(docs, keys, "chunk", send, SENT))


def _segments(docs: DataFrame, keys: DataFrame, unit: Unit) -> DataFrame:
    """keys has kind 0 for minimisers, and 1 for windows of hot ones."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            kind = pc.equal(right.column("kind"), 0)
            known, hot = wanted(right.filter(kind))
            windows, _ = wanted(right.filter(pc.invert(kind)))
            chunk = left.column("chunk")[0].as_py()
            seen: dict[tuple[int, bytes], list] = {}
            for i, data, offsets in _steps(_ordered(left)) if len(known) else ():
                found = runs(data, offsets, unit)
                at, fine = among(known, found.g)
                for x in np.flatnonzero(fine).tolist():
                    parts = [(0, int(found.n[x]))]
                    if hot[at[x]]:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], among(windows, found.hashes(x))[1], [0]]))).tolist()
                        parts = list(zip(edges[::2], edges[1::2], strict=True))
                    for a, b in parts:
                        name = (int(found.g[x]), found.text(x, a, b))
                        seen.setdefault(name, []).append((int(found.row[x]) + i, int(found.lo[x]) + a))
            for (g, segment), places in seen.items():
                for col, v in zip(cols, (g - (g >> 63 << 64), chunk, len(places), np.array(places, "<i4").tobytes(), segment), strict=True):
                    col.append(v)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return cogroup_arrow(docs, keys, "chunk", send, SEGMENTS)


def _solved(segments: DataFrame, unit: Unit, solve: Solver) -> DataFrame:
    """chunk, places, spans: for each segment that has repeated windows, the covered ranges of its units."""
    width, block_units = unit.width, BLOCK_UNITS

    def spans(starts: np.ndarray) -> bytes:
        """Ranges that the windows at these starts cover."""
        gaps = np.flatnonzero(np.diff(starts) > width) + 1
        begin, end = starts[np.concatenate([[0], gaps])], starts[np.concatenate([gaps - 1, [len(starts) - 1]])] + width
        return np.stack([begin, end], 1).astype("<i4").tobytes()

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        times: dict[tuple[int, bytes], int] = {}
        groups: dict[int, int] = {}
        for g, _, n, _, segment in rows:
            if (g, segment) not in times:
                groups[g] = groups.get(g, 0) + 1
            times[g, segment] = times.get((g, segment), 0) + n
        alone = {name for name, n in times.items() if n == 1}
        # A segment that occurs twice is repeated as a whole; the solver is for those that differ or repeat within.
        todo = [name for name in times if groups[name[0]] > 1 or (name in alone and unit.count(name[1]) > width)]
        found = dict(zip(todo, solve([s for _, s in todo], width), strict=True)) if any(n in alone for n in todo) else {}
        out: dict[tuple[int, bytes], bytes] = {}
        for name in times:
            starts = np.arange(unit.count(name[1]) - width + 1) if name not in alone else found.get(name, np.zeros(0, np.int64))
            if len(starts):
                out[name] = spans(starts)
        got = [(chunk, places, out[g, segment]) for g, chunk, _, places, segment in rows if (g, segment) in out]
        cols = list(zip(*got, strict=True)) if got else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["chunk", "places", "spans"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block_units and r[0] != last:
                    yield flush(rows)
                    rows, size = [], 0
                if rows and r[0] == rows[-1][0] and r[4] == rows[-1][4]:
                    r = (*r[:4], rows[-1][4])  # one copy of the text is enough
                else:
                    size += unit.count(r[4])
                rows.append(r)
                last = r[0]
        if rows:
            yield flush(rows)

    return map_arrow(segments.repartition("g").sortWithinPartitions("g", "segment"), blocks, "chunk int, places binary, spans binary")


def covered(table: pa.Table, spans: pa.Table) -> tuple[pa.Table, list[list[tuple[int, int]]]]:
    """A chunk's rows in order, and for each the merged ranges of its units that repeated windows cover."""
    table = _ordered(table)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(table.num_rows)]
    for places, own in zip(spans.column("places").to_pylist(), spans.column("spans").to_pylist(), strict=True):
        parts = np.frombuffer(own, "<i4").reshape(-1, 2).tolist()
        for row, lo in np.frombuffer(places, "<i4").reshape(-1, 2).tolist():
            ranges[row] += [(lo + a, lo + b) for a, b in parts]
    merged = []
    for r in ranges:
        out: list[tuple[int, int]] = []
        for a, b in sorted(r):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        merged.append(out)
    return table, merged


def remove_repeats(docs: DataFrame, unit: Unit, solve: Solver, finish: Callable[[pa.Table, list], pa.Table], schema: str) -> DataFrame:
    """finish(rows, ranges) of each chunk of docs, which has doc_id and text."""
    texts, chunks = chunked(docs)
    keys = _minimisers(texts, unit, chunks)
    windows = _hot_windows(texts, keys, unit, chunks)
    both = keys.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    solved = _solved(_segments(texts, both, unit), unit, solve)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(*covered(left, right))

    return cogroup_arrow(texts, solved, "chunk", last, schema)
